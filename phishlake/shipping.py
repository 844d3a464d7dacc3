"""Send the packages that Python workers import along with the job."""

from __future__ import annotations

import os
import tempfile
import zipfile

from pyspark.sql import SparkSession

_shipped: set[str] = set()


def ship(spark: SparkSession, root: str, packages: list[str]) -> None:
    """Zip the ``packages`` found under ``root`` and add them to the session's Python path.

    Workers may run where neither the driver's folder nor its path exists. Done once per
    application; folders that are absent are left out.
    """
    context = spark.sparkContext
    if context.applicationId in _shipped:
        return
    path = os.path.join(tempfile.mkdtemp(prefix="packages-"), "packages.zip")
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as out:
        for package in packages:
            for folder, _, names in os.walk(os.path.join(root, package)):
                for name in sorted(names):
                    if name.endswith(".py"):
                        full = os.path.join(folder, name)
                        out.write(full, os.path.relpath(full, root))
    context.addPyFile(path)
    _shipped.add(context.applicationId)

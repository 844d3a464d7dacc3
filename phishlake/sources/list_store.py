"""Versioned lists: rows of replaced lists in one folder per refresh, and a manifest that says which refresh holds each list.

A refresh writes the rows of lists whose version changed, reads them back and compares, then writes
the next manifest. Readers go by the newest finished manifest or by one they name, so they see
whole refreshes only; a refresh that dies leaves rows that no manifest names. A list that fails its checks
or was not written as sent keeps its old version. Two refreshes at once: the second manifest of a
number is refused. Everything is joins over rows, however many lists there are.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from phishlake.sources.lists import refresh_plan

MANIFEST = "list_name string, version string, refresh int, rows long"


def committed(spark: SparkSession, base: str) -> list[int]:
    """Numbers of the finished refreshes: one small file per refresh is listed."""
    done = spark._jvm.org.apache.hadoop.fs.Path(f"{base}/manifests/*/_SUCCESS")
    found = done.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(done)
    return sorted(int(f.getPath().getParent().getName().removeprefix("number=")) for f in found or [])


def manifest(spark: SparkSession, base: str, number: int | None = None) -> DataFrame:
    """(list_name, version, refresh, rows) as of a refresh, the newest if none is named; empty before the first."""
    numbers = committed(spark, base)
    number = max(numbers, default=0) if number is None else number
    if number == 0:
        return spark.createDataFrame([], MANIFEST)
    if number not in numbers:
        raise ValueError(f"refresh {number} was not finished")
    return spark.read.schema(MANIFEST).parquet(f"{base}/manifests/number={number}")


def _summary(rows: DataFrame) -> DataFrame:
    """Per list, its number of rows and a sum over their hashes: equal for equal rows in any order."""
    content = F.xxhash64(*[c for c in rows.columns if c != "list_name"]).cast("decimal(38,0)")
    return rows.groupBy("list_name").agg(F.count(F.lit(1)).alias("rows"), F.sum(content).alias("digest"))


def refresh(spark: SparkSession, base: str, incoming: DataFrame, bad: Column) -> int:
    """Take the lists of ``incoming`` (list_name, version and entry columns) whose version is new; returns the refresh's number.

    A list with a row that is ``bad``, or with rows of several versions, is left as it is.
    """
    old = manifest(spark, base)
    number = max(committed(spark, base), default=0) + 1
    lists = incoming.groupBy("list_name").agg(
        F.max("version").alias("version"),
        (F.coalesce(F.bool_or(F.coalesce(bad, F.lit(True))), F.lit(False))
         | (F.count_distinct(F.coalesce("version", F.lit(""))) > 1)).alias("failed"))
    plan = refresh_plan(old.select("list_name", "version"), lists.where("NOT failed").select("list_name", "version"))
    taken = plan.where("replace").select("list_name")
    # one folder of rows per refresh and try: a number that was tried before in vain is written anew
    path = f"{base}/rows/refresh={number}"
    sent = incoming.join(taken, "list_name", "left_semi")
    sent.write.mode("overwrite").parquet(path)
    wanted = _summary(sent)
    held = _summary(spark.read.schema(sent.schema).parquet(path))
    good = wanted.join(held, ["list_name", "rows", "digest"], "left_semi").select("list_name", "rows")
    replaced = lists.select("list_name", "version").join(good, "list_name").select(
        "list_name", "version", F.lit(number).alias("refresh"), "rows")
    kept = old.join(replaced, "list_name", "left_anti")
    replaced.unionByName(kept).write.mode("error").parquet(f"{base}/manifests/number={number}")
    return number


def lists_as_of(spark: SparkSession, base: str, number: int | None = None) -> DataFrame:
    """Rows of all lists as of a refresh; files of refreshes that no list is in are not read."""
    now = manifest(spark, base, number)
    used = [r.refresh for r in now.select("refresh").distinct().collect()]  # at most one per refresh
    folders = [f"{base}/rows/refresh={n}" for n in used] or [f"{base}/rows"]
    rows = spark.read.option("basePath", f"{base}/rows").parquet(*folders)
    return rows.join(now.select("list_name", "refresh"), ["list_name", "refresh"], "left_semi").drop("refresh")

"""Known-bad list from a text feed of URLs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from phishlake.functions.hosts import ANY_HOST_SCHEMES, strip_www, with_canonical_host


def read_feed(spark: SparkSession, path: str) -> DataFrame:
    """Feed lines in file order: (ord, line).

    The id grows with the position inside a file; files are taken in name order.
    """
    return spark.read.text(path).select(
        F.struct(F.input_file_name().alias("file"), F.monotonically_increasing_id().alias("pos"))
        .alias("ord"),
        F.col("value").alias("line"),
    )


def build_known_bad(feed: DataFrame, cap: int | None = None) -> DataFrame:
    """Distinct hosts of the feed, sorted.

    ``cap`` keeps the first ones in feed order, for lists that must stay as small as
    ``fixed_values.KNOWN_BAD_CAP``; without it no host is left out.
    """
    df = with_canonical_host(feed, "line", "_host", ANY_HOST_SCHEMES)
    hosts = df.select("ord", strip_www(F.col("_host")).alias("host"))
    first = (
        hosts.filter(F.coalesce(F.col("host").contains("."), F.lit(False)))
        .groupBy("host").agg(F.min("ord").alias("ord"))
    )
    if cap is not None:
        first = first.orderBy("ord").limit(cap)
    return first.select("host").orderBy("host")


def next_version(version: Column) -> Column:
    """Patch number plus one; a missing version counts as 1.0.0."""
    parts = F.split(F.coalesce(F.nullif(version, F.lit("")), F.lit("1.0.0")), "[.]")

    def number(i: int) -> Column:
        return F.get(parts, F.lit(i))

    patch = F.coalesce(number(2).try_cast("int"), F.lit(0)) + 1
    return F.concat_ws(".", number(0), number(1), patch.cast("string"))

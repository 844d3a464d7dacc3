"""Counts over verdict tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from phishlake.functions import bands


def verdict_counts(df: DataFrame, verdict: str = "verdict") -> DataFrame:
    return (
        df.groupBy(F.col(verdict).alias("verdict")).agg(F.count(F.lit(1)).alias("n"))
        .withColumn("action", bands.action_of(F.col("verdict")))
    )


def top_reasons(df: DataFrame, reasons: str = "reasons", k: int = 10) -> DataFrame:
    """The k most frequent reason codes; ties by code."""
    return (
        df.select(F.explode_outer(reasons).alias("reason")).filter("reason IS NOT NULL")
        .groupBy("reason")
        .agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "reason").limit(k)
    )

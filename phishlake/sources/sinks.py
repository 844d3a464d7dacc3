"""Verdict tables and report rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def write_verdicts(df: DataFrame, path: str, partition_by: tuple[str, ...] = ("verdict",),
                   mode: str = "append") -> None:
    """Parquet, partitioned (by default per verdict)."""
    df.write.mode(mode).partitionBy(*partition_by).parquet(path)


def report_text(kind: Column, address: Column, sender: Column, verdict: Column,
                reasons: Column) -> Column:
    """Report lines of a false positive; lines without a value are left out."""
    def line(label: str, value: Column) -> Column:
        return F.when(F.coalesce(value, F.lit("")) != "", F.concat(F.lit(f"{label}: "), value))

    listed = F.array_join(reasons, ",")
    return F.array_join(F.array_compact(F.array(
        F.concat(F.lit("kind: "), kind), line("address", address), line("sender", sender),
        line("verdict", verdict), line("reasons", listed))), "\n")


def fp_reports(df: DataFrame) -> DataFrame:
    """(kind, address, sender, verdict, reasons) -> plus title and report text."""
    title = F.when(F.col("kind") == "message", "message flagged by mistake").otherwise(
        "site flagged by mistake")
    return df.withColumn("title", title).withColumn("report", report_text(
        *[F.col(c) for c in ("kind", "address", "sender", "verdict", "reasons")]))

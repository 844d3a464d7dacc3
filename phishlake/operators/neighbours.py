"""Previous or next row of a key, without putting a whole key into one task.

A plain ``lag`` over a key sorts all its rows in one task. Here the window runs
per key and time bucket; only one edge row per bucket crosses bucket borders.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def with_neighbour(df: DataFrame, keys: list[str], ts: str, columns: list[str], out: str,
                   ahead: bool, tie: list[str] | None = None,
                   bucket_seconds: int = 3_600) -> DataFrame:
    """Add struct ``out`` with ``columns`` of the next (or previous) row by time.

    NULL where there is none. ``tie`` orders rows of equal time.
    """
    tie = tie or []
    order = [ts, *tie]
    row = F.struct(*columns)
    rank = F.struct(*order)
    df = df.withColumn("_bucket", F.floor(F.unix_seconds(F.col(ts)) / bucket_seconds))
    inside = W.partitionBy(*keys, "_bucket").orderBy(*order)
    near = F.lead(row).over(inside) if ahead else F.lag(row).over(inside)
    edge = F.min_by(row, rank) if ahead else F.max_by(row, rank)
    chain = W.partitionBy(*keys).orderBy("_bucket")
    edges = df.groupBy(*keys, "_bucket").agg(edge.alias("_edge"))
    beyond = F.lead("_edge").over(chain) if ahead else F.lag("_edge").over(chain)
    edges = edges.select(*keys, "_bucket", beyond.alias("_beyond"))
    return (
        df.withColumn("_near", near)
        .join(edges, [*keys, "_bucket"], "left")
        .withColumn(out, F.coalesce("_near", "_beyond"))
        .drop("_near", "_beyond", "_bucket")
    )

"""Connected components of a link table, by alternating star contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from llm.frames import materialised


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """One contraction step (Kiveris et al. 2014) over edges a > b, both directions by large."""
    a, b = F.col("a"), F.col("b")
    ways = edges.unionByName(edges.select(b.alias("a"), a.alias("b"))) if large else edges
    least = ways.groupBy("a").agg(F.min("b").alias("low")).withColumn("low", F.least("low", "a"))
    near = ways.join(least, "a")
    out = near.where("b > a") if large else near.where("b < a")
    out = out.select(b.alias("a"), F.col("low").alias("b"))
    if not large:
        out = out.unionByName(least.select("a", F.col("low").alias("b")))
    return out.where("a <> b").select(
        F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()


def components(links: DataFrame) -> DataFrame:
    """(id, root) for every id of (id, other): root is the smallest id it is linked to.

    Rounds are written to the shared folder, which cuts lineage; an edge table that no round
    changes is a set of stars around the roots. Ids with no link are absent; nulls are ignored.
    """
    ends = links.toDF("x", "y").where("x <> y")
    edges = materialised(ends.select(
        F.greatest("x", "y").alias("a"), F.least("x", "y").alias("b")).distinct(), "edges")
    state = None
    while True:
        edges = materialised(_star(_star(edges, True), False), "edges")
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == state:
            break
        state = now
    roots = edges.select(F.col("b").alias("id"), F.col("b").alias("root")).distinct()
    return edges.select(F.col("a").alias("id"), F.col("b").alias("root")).unionByName(roots)

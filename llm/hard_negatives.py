"""Hard-negative mining: rows of another label whose score lies in a window under a positive's.

Rows are dealt to cells around at most ``PIVOTS`` sampled rows, cells to shards of about ``shard_rows``;
every shard becomes cover trees (``llm/cover_tree.py``), one per label with many rows in it and one for
the others, written once. The index holds every row and the search is exact. Anchors are asked in
blocks of at most about ``BLOCK``, which bounds what is broadcast and brought to the driver: first
for their best rows of the same label, then, one window per positive, for the best rows of other
labels. A task keeps the best few of each query over all its trees, so what is shuffled is small.

Defined cases: rows with a null id, label or vector, a null or non-finite component, or a squared length
of 2^62 or more (scores would not fit into a long) take no part. Vectors of different lengths are
filled up with zeros. Ties go to the smaller id. Rows that share an id are rows of their own, but
none is another's positive or negative; an anchor that occurs twice is answered twice. A window over
a negative score is empty. An empty table gives an empty result. Other columns play no part.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from llm.cover_tree import CoverTree, Found
from phishlake.sources.workdir import materialised, work_dir

PIVOTS = 1024
SHARD_ROWS = 8192
#: A label with so many rows in a shard has a tree of its own.
OWN_TREE = 256
BLOCK = 16_384


def whole_vectors(rows: DataFrame, scale: int = 256, key: str = "vec_id", label: str = "label", vector: str = "embedding",
                  relabel: Column | None = None) -> DataFrame:
    """(id, label, vector): components floor(scale * x) of the rows that take part, labels by ``relabel`` if given."""
    kept = rows.select(F.col(key).alias("id"), (F.col(label) if relabel is None else relabel).cast("long").alias("label"),
                       F.col(vector).cast("array<double>").alias("vector"))
    finite = F.forall("vector", lambda x: F.coalesce(F.abs(x) < float("inf"), F.lit(False)) & ~F.isnan(x))
    kept = kept.where("id is not null and label is not null and vector is not null").where(finite)
    kept = kept.withColumn("vector", F.transform("vector", lambda x: F.floor(x * scale).cast("double")))
    square = F.aggregate("vector", F.lit(0.0), lambda total, x: total + x * x)
    return kept.where(square < 2.0**62).select("id", "label", F.col("vector").cast("array<int>").alias("vector"))


def _matrix(column, width: int) -> np.ndarray:
    """Vectors of an Arrow list column as rows, filled up with zeros."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    sizes = column.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    out = np.zeros((len(column), width), np.int64)
    out[np.arange(width) < sizes[:, None]] = column.flatten().to_numpy(zero_copy_only=False)
    return out


def _shards(rows: DataFrame, n: int, width: int, top: int, shard_rows: int) -> DataFrame:
    """Rows with ``shard``: the cell of the nearest pivot, split by its count."""
    spark = rows.sparkSession
    pivots = rows.orderBy(F.xxhash64("id"), "id").limit(min(PIVOTS, -(-n // shard_rows))).select("vector").toArrow()
    centres = _matrix(pivots.column("vector"), width).astype(np.float64)
    sent = spark.sparkContext.broadcast(np.concatenate([centres, np.sqrt(np.maximum(top - (centres**2).sum(1), 0))[:, None]], 1))

    def run(batches):
        for batch in batches:
            points = _matrix(batch.column("vector"), width).astype(np.float64)
            points = np.concatenate([points, np.sqrt(np.maximum(top - (points**2).sum(1), 0))[:, None]], 1)
            cell = (points @ sent.value.T).argmax(1)  # all of one length: nearest is largest product
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell.astype(np.int32))], [*batch.schema.names, "cell"])

    dealt = materialised(rows.mapInArrow(run, "id long, label long, vector array<int>, cell int"), "cells")
    parts = dealt.groupBy("cell").agg(F.ceil(F.count(F.lit(1)) / shard_rows).alias("parts"))  # one row per pivot
    return dealt.join(F.broadcast(parts), "cell").select(
        "id", "label", "vector", F.struct("cell", F.pmod(F.xxhash64("id", F.monotonically_increasing_id()), "parts")).alias("shard"))


def index(rows: DataFrame, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """Cover trees of all ``rows`` (id, label, vector), one per row of the returned table: label or null, tree."""
    square = F.aggregate("vector", F.lit(0).cast("long"), lambda total, x: total + x.cast("long") * x)
    n, width, top = rows.agg(F.count(F.lit(1)), F.max(F.size("vector")), F.max(square)).first()
    width, top = width or 0, top or 0
    kind = "label long, top long, tree binary"
    if n == 0:
        return rows.sparkSession.createDataFrame([], kind)

    def build(shard: pa.Table) -> pa.Table:
        vectors = _matrix(shard.column("vector"), width).astype(np.int32)
        ids, labels = (shard.column(c).to_numpy() for c in ("id", "label"))
        names, at, counts = np.unique(labels, return_inverse=True, return_counts=True)
        out = [(names[k], at == k) for k in np.flatnonzero(counts >= OWN_TREE)]
        out.append((None, counts[at] < OWN_TREE))
        out = [(label, some) for label, some in out if some.any()]
        trees = [CoverTree.build(vectors[some], ids[some], labels[some], top).to_bytes() for _, some in out]
        return pa.table({"label": pa.array([x for x, _ in out], pa.int64()), "top": pa.array([top] * len(out), pa.int64()),
                         "tree": pa.array(trees, pa.binary())})

    sharded = _shards(rows.select(F.col("id").cast("long").alias("id"), "label", "vector"), n, width, top, shard_rows)
    return materialised(sharded.groupBy("shard").applyInArrow(build, kind), "cover-trees")


def _best(trees: DataFrame, asked: dict, k: int, same: bool) -> DataFrame:
    """(query, id, score, rank): the best ``k`` rows of every query over all trees."""
    sent = trees.sparkSession.sparkContext.broadcast(asked)

    def run(batches):
        q = sent.value
        found = Found(q["vectors"], q["ids"], q["labels"], k, same, q.get("low"), q.get("high"), q["top"])
        for batch in batches:
            for label, tree in zip(batch.column("label").to_pylist(), batch.column("tree"), strict=True):
                tree = CoverTree.from_bytes(tree.as_py())
                if label is None:
                    tree.search(found)
                    continue
                # a tree of one label: only the queries that want it
                mine = np.flatnonzero((q["labels"] == label) == same)
                part = found.of(mine)
                tree.search(part)
                found.put(mine, part)
        query, row, score = found.rows()
        yield pa.RecordBatch.from_arrays([pa.array(query), pa.array(row), pa.array(score)], ["query", "id", "score"])

    order = W.partitionBy("query").orderBy(F.desc("score"), "id")
    rows = trees.select("label", "tree").mapInArrow(run, "query long, id long, score long")
    return rows.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def mine(rows: DataFrame, anchors: DataFrame, positives: int = 5, negatives: int = 3, low: int = 50, high: int = 95,
         shard_rows: int = SHARD_ROWS, block: int = BLOCK) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score).

    ``rows`` and ``anchors`` as from ``whole_vectors``; a negative's score is from ``low`` to ``high`` per cent of
    its positive's. Every block of anchors is two jobs over the trees and one folder of the result.
    """
    spark = rows.sparkSession
    rows = materialised(rows, "vectors")
    trees = index(rows, shard_rows)
    square = F.aggregate("vector", F.lit(0).cast("long"), lambda total, x: total + x.cast("long") * x)
    n, width, top = anchors.agg(F.count(F.lit(1)), F.max(F.size("vector")), F.max(square)).first()
    most = rows.agg(F.max(F.size("vector"))).first()[0]
    width = max(width or 0, most or 0)
    blocks = -(-n // block)
    path = work_dir(spark, "negatives")
    kind = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
    spark.createDataFrame([], kind).write.parquet(f"{path}/block=-1")
    dealt = anchors.withColumn("_block", F.pmod(F.xxhash64("id"), F.lit(blocks)))
    for number in range(blocks):
        some = dealt.where(F.col("_block") == number).select("id", "label", "vector").toArrow()
        if not some.num_rows:
            continue
        asked = {"vectors": _matrix(some.column("vector"), width), "ids": some.column("id").to_numpy().astype(np.int64),
                 "labels": some.column("label").to_numpy(), "top": top}
        best = _best(trees, asked, positives, True).toArrow()  # at most ``positives`` rows per anchor of the block
        query, positive, score = (best.column(c).to_numpy() for c in ("query", "id", "score"))
        windows = {"vectors": asked["vectors"][query], "ids": asked["ids"][query], "labels": asked["labels"][query], "top": top,
                   "low": _share(score, low, up=True), "high": _share(score, high, up=False)}
        names = spark.createDataFrame(pa.table({
            "query": np.arange(len(query)), "anchor_id": asked["ids"][query], "positive_id": positive, "positive_score": score}))
        out = _best(trees, windows, negatives, False).join(F.broadcast(names), "query").select(
            "anchor_id", "positive_id", "rank", F.col("id").alias("negative_id"), "positive_score",
            F.col("score").alias("negative_score"))
        out.write.parquet(f"{path}/block={number}")
    return spark.read.schema(kind).parquet(path).select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


def _share(score: np.ndarray, percent: int, up: bool) -> np.ndarray:
    """``percent`` of every score, to the next whole number up or down."""
    if up:
        return -_share(-score, percent, False)
    return score // 100 * percent + score % 100 * percent // 100

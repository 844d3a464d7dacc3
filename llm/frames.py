"""Small DataFrame helpers that several operators share."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from phishlake.sources.workdir import materialised


def table(spark, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def with_twin(docs: DataFrame, key: str, text: str, out: str = "twin") -> DataFrame:
    """Add int ``out`` that tells rows of one ``key`` with different texts apart.

    0 for every row where keys are unique (the usual case: one narrow count, no shuffle of
    texts). Else texts of a repeated key are numbered by their hash; equal rows share a number.
    """
    repeated = docs.groupBy(key).count().where("count > 1").select(key)
    if repeated.isEmpty():
        return docs.withColumn(out, F.lit(0))
    mark = docs.select(key, F.xxhash64(text).alias("_mark"))
    ranks = (
        mark.join(repeated, key, "left_semi").distinct()
        .withColumn(out, (F.row_number().over(W.partitionBy(key).orderBy("_mark")) - 1).cast("int"))
        .withColumnRenamed(key, "_key")
    )
    ranks = materialised(ranks, "twins")
    joined = docs.withColumn("_here", F.xxhash64(text)).join(
        ranks, (F.col(key) == F.col("_key")) & (F.col("_here") == F.col("_mark")), "left")
    return joined.withColumn(out, F.coalesce(out, F.lit(0))).drop("_key", "_here", "_mark")


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, rows: int, key: str = "doc_id",
                    text: str = "text") -> DataFrame:
    """(key, label, text) of the ``rows`` labelled ids with the smallest hash.

    ``rows`` bounds the training set and therefore what is broadcast here; null labels and ids
    do not count, an id with several labels takes the largest.
    """
    some = (
        labels.where(F.col(label).isNotNull() & F.col(key).isNotNull())
        .groupBy(F.col(key).alias("_id")).agg(F.max(label).alias("label"))
        .orderBy(F.xxhash64("_id"), "_id").limit(rows)
    )
    return docs.select(F.col(key).alias("key"), F.col(text).alias("text")).join(
        F.broadcast(some), F.col("key") == F.col("_id")).select("key", "label", "text")

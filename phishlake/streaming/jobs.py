"""Streaming forms of the jobs.

Scoring is stateless per row but uses joins with distinct hosts, so it runs per
micro-batch with ``foreachBatch``; lists are asked for again for every batch.
Streams with state of their own are in ``stateful.py``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

WATERMARK = "10 minutes"


def with_event_time(df: DataFrame, ts: str = "ts", delay: str = WATERMARK) -> DataFrame:
    """Event time as timestamp, with the watermark that bounds late data."""
    return df.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, delay)


def score_stream(stream: DataFrame, score_batch: Callable[[DataFrame], DataFrame], out: str,
                 checkpoint: str, **trigger) -> StreamingQuery:
    """Score every micro-batch and append it under its batch number.

    A batch that is replayed after a failure replaces its own folder, so results
    are written exactly once.
    """
    def write(batch: DataFrame, batch_id: int) -> None:
        score_batch(batch).write.mode("overwrite").parquet(f"{out}/batch={batch_id}")

    return (
        stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
        .trigger(**(trigger or {"availableNow": True})).start()
    )


def windowed_counts(stream: DataFrame, ts: str, width: str, *keys: str) -> DataFrame:
    return (
        stream.groupBy(F.window(ts, width).alias("w"), *keys).agg(F.count(F.lit(1)).alias("n"))
        .select(F.col("w.start").alias("window_start"), *keys, "n")
    )


def write_counts(counts: DataFrame, out: str, checkpoint: str, **trigger) -> StreamingQuery:
    """Write the windows that a micro-batch changes under its batch number; ``merged_counts`` reads them.

    Only changed windows are written, open ones included, and a window's state ends when the
    watermark has passed it. A replayed batch replaces its own folder.
    """
    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/batch={batch_id}")

    return (
        counts.writeStream.outputMode("update").foreachBatch(write)
        .option("checkpointLocation", checkpoint)
        .trigger(**(trigger or {"availableNow": True})).start()
    )


def merged_counts(spark: SparkSession, out: str, *keys: str) -> DataFrame:
    """The newest count of every window of ``write_counts``, merged on read (partial newest per file, then one shuffle)."""
    return spark.read.parquet(out).groupBy("window_start", *keys).agg(F.max_by("n", "batch").alias("n"))


def write_closed_windows(counts: DataFrame, out: str, checkpoint: str, **trigger) -> StreamingQuery:
    """Append each window once, when the watermark has passed its end; later rows
    of a closed window are dropped."""
    return (
        counts.writeStream.outputMode("append").format("parquet").option("path", out)
        .option("checkpointLocation", checkpoint)
        .trigger(**(trigger or {"availableNow": True})).start()
    )

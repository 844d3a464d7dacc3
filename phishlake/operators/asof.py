"""As-of join with expiry.

The value of a key at a moment is its latest snapshot, if that has not expired.
Snapshots become intervals that do not overlap, each interval is filed under the
time buckets it touches, and the join is an equality on key and bucket plus a
range check: one match at most per row, no window over the big side, and a hot
key is spread over its buckets and salted. Filed intervals and the hot keys are
written once, so neither the snapshots nor the rows are worked out again.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from phishlake.operators.lookups import hot_keys, salted_join
from phishlake.operators.neighbours import with_neighbour
from phishlake.sources.workdir import materialised

BUCKET_SECONDS = 86_400
SNAPSHOT_BUCKET_SECONDS = 30 * 86_400


def snapshot_intervals(snapshots: DataFrame, key: str, ttl: Column) -> DataFrame:
    """(key, value, fetched_at) -> plus half-open [valid_from, valid_to)."""
    snapshots = with_neighbour(
        snapshots, [key], "fetched_at", ["fetched_at"], "_next", ahead=True,
        bucket_seconds=SNAPSHOT_BUCKET_SECONDS)
    later = F.col("_next.fetched_at")
    end = F.col("fetched_at") + F.make_dt_interval(secs=ttl)
    return snapshots.withColumn("valid_from", F.col("fetched_at")).withColumn(
        "valid_to", F.least(end, later)).drop("_next")


def asof_ttl_join(events: DataFrame, snapshots: DataFrame, key: str, ts: str, value: str,
                  ttl_seconds: int, failed_ttl_seconds: int, out: str,
                  bucket_seconds: int = BUCKET_SECONDS, rows: DataFrame | None = None) -> DataFrame:
    """Add ``out`` (value or NULL) and ``out_known`` (a live snapshot existed).

    A snapshot with a NULL value lives only for the shorter time. Hot keys are counted
    on ``rows``, if given: the same rows before earlier joins.
    """
    ttl = F.when(F.col(value).isNull(), F.lit(failed_ttl_seconds)).otherwise(F.lit(ttl_seconds))
    spans = snapshot_intervals(snapshots.select(key, value, "fetched_at"), key, ttl)
    spans = spans.filter(F.col("valid_to") > F.col("valid_from"))

    def bucket(c: Column) -> Column:
        return F.floor(F.unix_seconds(c) / bucket_seconds)

    filed = spans.select(
        key, F.struct("valid_from", "valid_to", F.col(value).alias(out)).alias("_live"),
        F.explode(F.sequence(bucket(F.col("valid_from")), bucket(F.col("valid_to")))).alias("_b"),
    )
    inside = (F.col("_live.valid_from") <= F.col(ts)) & (F.col(ts) < F.col("_live.valid_to"))
    filed = materialised(filed, "snapshots")
    counted = (events if rows is None else rows).select(key, bucket(F.col(ts)).alias("_b"))
    hot = materialised(hot_keys(counted, [key, "_b"]), "hot")
    df = salted_join(events.withColumn("_b", bucket(F.col(ts))), filed, [key, "_b"], hot=hot, where=inside)
    return (
        df.withColumn(out, F.col(f"_live.{out}"))
        .withColumn(f"{out}_known", F.col("_live").isNotNull())
        .drop("_live", "_b")
    )

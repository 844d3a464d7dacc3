"""Stateful streams: rate limit, mail scans, session overrides, licences.

State lives in RocksDB under the query's checkpoint, a few values per key, and ends: by a time to
live, by timers, by a watermark, or with what it stands for. Rows of a micro-batch reach a key's
processor in order: the shuffle that deals the keys also sorts them, so no key is gathered in memory.
Processors sit on rows one by one; one key is one task, all keys of a batch are spread.
"""

from __future__ import annotations

from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from phishlake import fixed_values as fv
from phishlake.operators.licences import event_effect
from phishlake.streaming.processors import LastScan, Limiter, Subscription

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
#: Processing time after which an untouched rate counter is dropped. Far over the counter's own life, so
#: that a slow replay does not lose a counter that is alive in event time.
COUNTER_TTL_MS = 3_600_000
#: Event time after which the last scan of an idle mailbox is forgotten.
SCAN_MEMORY_DAYS = 30
#: Event time for which an override holds.
SESSION_LIFE = "30 days"


@contextmanager
def stream_settings(spark: SparkSession, **settings: str):
    """Settings that a query copies at its start, put back afterwards."""
    names = {f"spark.sql.streaming.{k.replace('__', '.')}": v for k, v in settings.items()}
    before = {k: spark.conf.get(k, None) for k in names}
    try:
        for name, value in names.items():
            spark.conf.set(name, value)
        yield
    finally:
        for name, value in before.items():
            if value is None:
                spark.conf.unset(name)
            else:
                spark.conf.set(name, value)


def start_stateful(rows: DataFrame, out: str, checkpoint: str, idle_batches: bool = True, **trigger) -> StreamingQuery:
    """Append ``rows`` to Parquet files.

    The check of unsupported operations is off at the start, as it refuses every sort: ``in_order`` sorts a
    micro-batch within its partitions only. ``idle_batches`` runs batches without data when the watermark
    moves; a query in processing time has no end to them under an available-now trigger.
    """
    settings = {"stateStore__providerClass": ROCKSDB, "unsupportedOperationCheck": "false",
                "noDataMicroBatches__enabled": str(idle_batches).lower()}
    with stream_settings(rows.sparkSession, **settings):
        return (
            rows.writeStream.outputMode("append").format("parquet").option("path", out)
            .option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()
        )


def in_order(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Rows dealt by ``keys`` and sorted by keys and ``order``: what the stateful operator asks for, so it adds no exchange."""
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return rows.repartition(n, *keys).sortWithinPartitions(*keys, *order)


# --- rate limit ---------------------------------------------------------------

def limit_calls(calls: DataFrame, out: str, checkpoint: str, ttl_ms: int = COUNTER_TTL_MS, **trigger) -> StreamingQuery:
    """(key, call_id, ts) stream -> files of key, call_id, micros, allowed.

    Each accepted call sets the counter's life to 60 seconds again; refused calls do not. That
    differs from a tumbling window of 60 seconds. Calls of a micro-batch count by time, whatever files
    they came in; a call in a later batch than younger ones is judged as the counter stands, so
    every call gets an answer. A counter goes when no call was accepted for ``ttl_ms``.
    """
    calls = in_order(calls.select("key", "call_id", F.unix_micros("ts").alias("micros")), ["key"], ["micros", "call_id"])
    taken = calls.groupBy("key").transformWithState(
        Limiter(fv.RATE_LIMIT_CALLS, fv.RATE_LIMIT_TTL_SECONDS * 1_000_000, ttl_ms), "key string, call_id long, micros long, allowed boolean", "Append", "ProcessingTime")
    return start_stateful(taken, out, checkpoint, idle_batches=False, **trigger)


# --- session overrides --------------------------------------------------------

def not_overridden(nav: DataFrame, overrides: DataFrame, life: str = SESSION_LIFE, session: str = "session_id",
                   host: str = "host", ts: str = "ts") -> DataFrame:
    """Navigations that no override of the same session and host covers: two streams, an outer interval join.

    Both streams need watermarks. An override holds from its time on, for ``life``. A navigation waits until
    the watermark has passed it, then its state ends; an override's state ends ``life`` later.
    """
    marks = overrides.select(F.col(session).alias("_session"), F.col(host).alias("_host"), F.col(ts).alias("_from"))
    covers = (
        (F.col(session) == F.col("_session")) & (F.col(host) == F.col("_host"))
        & (F.col("_from") <= F.col(ts)) & (F.col("_from") >= F.col(ts) - F.expr(f"interval {life}"))
    )
    return nav.join(marks, covers, "left_outer").where("_from IS NULL").drop("_session", "_host", "_from")


# --- mail scans -----------------------------------------------------------------

def bursts(views: DataFrame, quiet_ms: int = fv.MAIL_DEBOUNCE_MS) -> DataFrame:
    """(mailbox, ts, view_id, signature) stream with a watermark -> last view of every burst that is over.

    Session windows that touch are one; a view just after the quiet time is a new burst, so the gap is a microsecond less.
    """
    gap = F.session_window("ts", f"{quiet_ms * 1000 - 1} microseconds")
    last = F.max(F.struct("ts", "view_id", "signature"))
    return views.groupBy("mailbox", gap.alias("w")).agg(last.alias("last")).select(
        "mailbox", F.window_time("w").alias("closed"), F.unix_micros("last.ts").alias("micros"), "last.view_id", "last.signature")


def scans(views: DataFrame, quiet_ms: int = fv.MAIL_DEBOUNCE_MS, memory_days: int = SCAN_MEMORY_DAYS) -> DataFrame:
    """Views that are scanned: the last of a burst, unless its signature is that of the scan before.

    Two stateful operators in a row: the session windows pass their closed bursts and their watermark on
    to the memory of the last signature, which ends by a timer. The second deals by the mailbox as text:
    two stateful operators may not share a task.
    """
    calm = bursts(views, quiet_ms).withColumn("owner", F.col("mailbox").cast("string"))
    calm = in_order(calm, ["owner"], ["micros", "view_id"])
    return calm.groupBy("owner").transformWithState(
        LastScan(memory_days), "mailbox long, micros long, view_id long, signature string", "Append", "EventTime")


# --- licences -------------------------------------------------------------------

def licence_changes(events: DataFrame) -> DataFrame:
    """(ts, event_type, status, subscription_id, licence_key) stream -> (licence_key, subscription_id, status) changes.

    As ``operators.licences.licence_state``: an end closes the key opened last before it. Events of
    a micro-batch count by time, batches as they come. State is one key per open subscription and
    goes when it is closed; a second end finds nothing, as before the first checkout.
    """
    told = events.withColumn("effect", event_effect(F.col("event_type"), F.col("status"))).where("effect IS NOT NULL")
    # a key without a subscription is a group of its own: no end can reach it
    owner = F.when(F.col("subscription_id").isNotNull(), F.concat(F.lit("s"), "subscription_id")).otherwise(
        F.concat(F.lit("k"), F.coalesce("licence_key", F.lit(""))))
    told = told.where("effect = 'open' OR subscription_id IS NOT NULL").select(
        owner.alias("owner"), F.unix_micros("ts").alias("micros"), "effect", "licence_key", "subscription_id")
    told = in_order(told, ["owner"], ["micros", "effect", "licence_key"])
    return told.groupBy("owner").transformWithState(
        Subscription(), "licence_key string, subscription_id string, status string", "Append", "None")


def licences_now(changes: DataFrame) -> DataFrame:
    """State of every key from the changes so far: once inactive, always inactive."""
    return changes.groupBy("licence_key", "subscription_id").agg(
        F.when(F.max((F.col("status") == "inactive").cast("int")) == 1, "inactive").otherwise("active").alias("status"))

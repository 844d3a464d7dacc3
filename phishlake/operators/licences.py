"""Subscription state from billing events, and key checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from phishlake import fixed_values as fv
from phishlake.operators.lookups import salted_join
from phishlake.operators.neighbours import with_neighbour


def event_effect(event_type: Column, status: Column) -> Column:
    """'open', 'close' or NULL for events that change nothing."""
    ended = F.coalesce(status.isin(list(fv.ENDED_SUBSCRIPTION_STATES)), F.lit(False))
    return (
        F.when(event_type == "checkout.session.completed", "open")
        .when(event_type == "customer.subscription.deleted", "close")
        .when((event_type == "customer.subscription.updated") & ended, "close")
    )


def licence_state(events: DataFrame) -> DataFrame:
    """(ts, event_type, status, subscription_id, licence_key) -> key, status.

    Every completed checkout opens its own key; a later end of the subscription
    closes only the key opened last before it, so an older key stays active. An
    end without an earlier checkout is dropped. A key without a subscription can
    never be closed.
    """
    e = events.withColumn("effect", event_effect(F.col("event_type"), F.col("status"))).filter(
        "effect IS NOT NULL")
    # nothing can close a key without a subscription: those rows need no order
    free = e.filter("subscription_id IS NULL AND effect = 'open'").select(
        "licence_key", "subscription_id", F.lit("active").alias("status"))
    # the event after an opening decides: the next open or close of the subscription
    e = with_neighbour(
        e.filter("subscription_id IS NOT NULL").select(
            "subscription_id", "licence_key", "effect", "ts"), ["subscription_id"], "ts",
        ["effect"], "_next", ahead=True, tie=["effect", "licence_key"],
        bucket_seconds=30 * 86_400)
    closed = F.coalesce(F.col("_next.effect") == "close", F.lit(False))
    return e.filter("effect = 'open'").select(
        "licence_key", "subscription_id",
        F.when(closed, "inactive").otherwise("active").alias("status")).unionByName(free)


def verify_keys(keys: DataFrame, state: DataFrame, prefix: str, key: str = "key") -> DataFrame:
    """Add ``clean_key, valid, status``; unknown or malformed keys are 'unknown'."""
    df = keys.withColumn("clean_key", F.upper(F.trim(F.col(key))))
    shaped = F.coalesce(
        F.col("clean_key").rlike(f"^{prefix}{fv.LICENCE_KEY_GROUPS}$"), F.lit(False))
    known = state.select(F.col("licence_key").alias("clean_key"), F.col("status").alias("_status"))
    df = salted_join(df, known, ["clean_key"])
    status = F.when(shaped, F.coalesce("_status", F.lit("unknown"))).otherwise("unknown")
    return df.withColumn("status", status).withColumn(
        "valid", F.col("status") == "active").drop("_status")

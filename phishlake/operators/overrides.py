"""Session overrides, mail-scan debounce."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from phishlake import fixed_values as fv
from phishlake.operators.lookups import salted_join
from phishlake.operators.neighbours import with_neighbour


def drop_overridden(nav: DataFrame, overrides: DataFrame, session: str = "session_id",
                    host: str = "host", ts: str = "ts") -> DataFrame:
    """Navigations not covered by an earlier override of the same session and host."""
    first = overrides.groupBy(session, host).agg(F.min(ts).alias("_from"))
    df = salted_join(nav, first, [session, host])
    covered = F.coalesce(F.col("_from") <= F.col(ts), F.lit(False))
    return df.filter(~covered).drop("_from")


def debounced(events: DataFrame, box: str, ts: str, tie: list[str],
              quiet_ms: int = fv.MAIL_DEBOUNCE_MS) -> DataFrame:
    """Last event of every burst: nothing follows it within the quiet time."""
    df = with_neighbour(events, [box], ts, [ts], "_next", ahead=True, tie=tie)
    gap = F.unix_micros(F.col(f"_next.{ts}")) - F.unix_micros(F.col(ts))
    return df.filter(F.col("_next").isNull() | (gap >= quiet_ms * 1000)).drop("_next")


def mail_scans(events: DataFrame, box: str, ts: str, signature: str,
               tie: list[str]) -> DataFrame:
    """Debounced views, those with the signature of the scan before dropped."""
    calm = debounced(events, box, ts, tie)
    df = with_neighbour(calm, [box], ts, [signature], "_prev", ahead=False, tie=tie)
    same = F.col(f"_prev.{signature}").eqNullSafe(F.col(signature)) & F.col("_prev").isNotNull()
    return df.filter(~same).drop("_prev")

"""Scores, verdict bands and sensitivity."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from phishlake import fixed_values as fv

VERDICTS = ("safe", "low", "medium", "high")
ACTIONS = {"high": "block", "medium": "banner", "low": "badge", "safe": "none"}


def capped(score: Column) -> Column:
    return F.least(score, F.lit(fv.SCORE_CAP)).cast("int")


def band(score: Column) -> Column:
    return (
        F.when(score >= fv.BAND_HIGH, "high")
        .when(score >= fv.BAND_MEDIUM, "medium")
        .when(score >= fv.BAND_LOW, "low")
        .otherwise("safe")
    )


def verdict_rank(verdict: Column) -> Column:
    return (
        F.when(verdict == "high", 3).when(verdict == "medium", 2)
        .when(verdict == "low", 1).otherwise(0)
    )


def shift_score(score: Column, sensitivity: Column) -> Column:
    """Add the sensitivity shift and clamp to 0..100."""
    shift = F.lit(0)
    for name, value in fv.SENSITIVITY_SHIFT.items():
        shift = F.when(sensitivity == name, value).otherwise(shift)
    return F.greatest(F.lit(0), F.least(F.lit(fv.SCORE_CAP), score + shift)).cast("int")


def floored_verdict(adjusted: Column, raw_verdict: Column, sensitivity: Column) -> Column:
    """Band of the shifted score, never below the raw verdict unless permissive."""
    banded = band(adjusted)
    keep_raw = (sensitivity != "permissive") & (
        verdict_rank(raw_verdict) > verdict_rank(banded)
    )
    return F.when(keep_raw, raw_verdict).otherwise(banded)


def action_of(verdict: Column) -> Column:
    out = F.lit("none")
    for name, action in ACTIONS.items():
        out = F.when(verdict == name, action).otherwise(out)
    return out


def fired_codes(*flags: tuple[Column, str]) -> Column:
    """Reason codes of the flags that hold, in the given order."""
    return F.array_compact(F.array(*[
        F.when(F.coalesce(f, F.lit(False)), F.lit(code)) for f, code in flags
    ]))


def flag_sum(*flags: tuple[Column, int]) -> Column:
    total = F.lit(0)
    for f, weight in flags:
        total = total + F.when(F.coalesce(f, F.lit(False)), weight).otherwise(0)
    return total

"""Enrichment of borderline pages: domain age and confirmed-phish snapshots."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from phishlake import fixed_values as fv
from phishlake.functions import bands
from phishlake.operators.asof import asof_ttl_join

REGISTRY_SCHEMA = "events array<struct<eventAction:string,eventDate:string>>"
PHISH_SCHEMA = "results struct<in_database:boolean,verified:boolean,valid:boolean>"


def domain_age_days(payload: Column, now: Column) -> Column:
    """Whole days since the first registration event of a registry answer."""
    events = F.from_json(payload, REGISTRY_SCHEMA)["events"]
    first = F.get(F.filter(events, lambda e: e["eventAction"] == "registration"), F.lit(0))
    born = F.try_to_timestamp(F.nullif(first["eventDate"], F.lit("")))
    return F.floor((F.unix_micros(now) - F.unix_micros(born)) / (86_400 * 1_000_000)).cast("int")


def phish_answer(payload: Column) -> Column:
    """struct(in_database, verified, valid) or NULL when the answer is unusable."""
    r = F.from_json(payload, PHISH_SCHEMA)["results"]
    no = F.lit(False)
    return F.when(r.isNotNull(), F.struct(
        F.coalesce(r["in_database"], no).alias("in_database"),
        F.coalesce(r["verified"], no).alias("verified"),
        F.coalesce(r["valid"], no).alias("valid")))


def needs_lookup(score: Column, entitled: Column) -> Column:
    """Only entitled users and borderline scores are enriched."""
    return entitled & (score >= fv.BAND_LOW) & (score < fv.BAND_HIGH)


def young_domain(age_days: Column, claims_institution: Column) -> Column:
    return F.coalesce((age_days < fv.YOUNG_DOMAIN_DAYS) & claims_institution, F.lit(False))


def is_confirmed_phish(answer: Column) -> Column:
    return F.coalesce(answer["in_database"] & answer["valid"], F.lit(False))


def enrich(scored: DataFrame, ages: DataFrame, phish: DataFrame, ts: str = "ts",
           host: str = "host", url: str = "url", score: str = "score",
           reasons: str = "reasons") -> DataFrame:
    """Raise borderline scores from snapshots; other rows never reach the joins.

    Pass a written verdict table: the gate is then a filter on its scan, and
    scoring is not repeated for the two branches.
    ``scored`` needs ``entitled, phish_opt_in, claims_institution`` flags besides
    time, host, URL, score and reasons. ``ages`` is (host, value, fetched_at) with
    days; ``phish`` is (url, in_database, valid, fetched_at).
    """
    gate = needs_lookup(F.col(score), F.col("entitled"))
    border, rest = scored.filter(gate), scored.filter(~F.coalesce(gate, F.lit(False)))
    df = asof_ttl_join(border, ages.withColumnRenamed("host", host), host, ts, "value",
                       fv.AGE_TTL_SECONDS, fv.FAILED_LOOKUP_TTL_SECONDS, "age_days")
    answers = phish.select(
        F.col("url").alias(url), "fetched_at",
        F.when(F.col("in_database").isNotNull(), F.struct("in_database", "valid")).alias("answer"))
    df = asof_ttl_join(df, answers, url, ts, "answer", fv.PHISH_TTL_SECONDS,
                       fv.FAILED_LOOKUP_TTL_SECONDS, "phish", rows=border)
    young = young_domain(F.col("age_days"), F.col("claims_institution"))
    listed = F.col("phish_opt_in") & is_confirmed_phish(F.col("phish"))
    codes = bands.fired_codes((young, "young_domain"), (listed, "confirmed_phish"))
    df = (
        df.withColumn("_extra", bands.flag_sum((young, fv.YOUNG_DOMAIN_WEIGHT)))
        .withColumn(reasons, F.array_union(F.col(reasons), codes))
        .withColumn(score, F.when(listed, fv.SCORE_CAP)
                    .otherwise(bands.capped(F.col(score) + F.col("_extra"))).cast("int"))
    )
    return df.select(*scored.columns).unionByName(rest)

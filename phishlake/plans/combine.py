"""URL and page verdicts combined into one verdict and action."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from phishlake.functions import bands


def needs_page_score(verdict: Column, institution: Column, reasons: Column,
                     trust_user_list: bool = False) -> Column:
    """Pages of verified institutions are not content-scored.

    A host the user trusts has no institution name, so by default its page is
    still scored; ``trust_user_list`` skips it as well.
    """
    verified = (verdict == "safe") & (F.coalesce(institution, F.lit("")) != "")
    if trust_user_list:
        verified = verified | F.array_contains(reasons, "user_allowed")
    return ~verified


def merged_reasons(first: Column, second: Column) -> Column:
    """Ordered union, first list first, repeats dropped."""
    none = F.array().cast("array<string>")
    return F.array_distinct(F.concat(F.coalesce(first, none), F.coalesce(second, none)))


def combine_scores(url_score: Column, page_score: Column) -> Column:
    return bands.capped(url_score + F.coalesce(page_score, F.lit(0)))


def with_final_verdict(df: DataFrame, raw_score: str, raw_verdict: str,
                       sensitivity: Column) -> DataFrame:
    """Add ``adjusted_score, final_verdict, action``."""
    return (
        df.withColumn("adjusted_score", bands.shift_score(F.col(raw_score), sensitivity))
        .withColumn("final_verdict", bands.floored_verdict(
            F.col("adjusted_score"), F.col(raw_verdict), sensitivity))
        .withColumn("action", bands.action_of(F.col("final_verdict")))
    )


def combined_layers(url_verdicts: DataFrame, page_verdicts: DataFrame, key: str,
                    trust_user_list: bool = False) -> DataFrame:
    """Join both layers on the page key: ``combined_score, all_reasons``.

    Verified institutions are dropped: they get no page-level verdict.
    """
    wanted = url_verdicts.filter(needs_page_score(
        F.col("verdict"), F.col("institution_name"), F.col("reasons"), trust_user_list))
    df = wanted.join(page_verdicts.select(
        key, "content_score", "content_reasons", "categories_hit"), key, "left")
    df = df.withColumn("combined_score", combine_scores(F.col("score"), F.col("content_score")))
    return df.withColumn("all_reasons", merged_reasons(F.col("reasons"), F.col("content_reasons")))


def combine(url_verdicts: DataFrame, page_verdicts: DataFrame, key: str,
            sensitivity: Column, trust_user_list: bool = False) -> DataFrame:
    """Both layers on the page key with the final verdict, without enrichment."""
    df = combined_layers(url_verdicts, page_verdicts, key, trust_user_list)
    return with_final_verdict(df, "combined_score", "verdict", sensitivity)

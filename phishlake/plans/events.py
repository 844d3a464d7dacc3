"""The page event end to end: URL score, page score, enrichment, sensitivity, floor, action."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from phishlake.plans.combine import combined_layers, with_final_verdict
from phishlake.plans.enrich import enrich
from phishlake.sources.workdir import materialised


def page_events(url_verdicts: DataFrame, page_verdicts: DataFrame, key: str, ages: DataFrame,
                phish: DataFrame, sensitivity: Column, claim_category: str,
                trust_user_list: bool = False) -> DataFrame:
    """Both layers combined, borderline scores enriched, final verdict and action.

    ``url_verdicts`` needs ``ts, url, host, entitled, phish_opt_in`` besides the verdict. A page
    claims an institution by a hit in ``claim_category`` or by the institution its URL names.
    The combined rows are written once: enrichment filters and joins them more than once.
    """
    df = combined_layers(url_verdicts, page_verdicts, key, trust_user_list)
    claims = F.coalesce(F.array_contains("categories_hit", claim_category), F.lit(False)) | (
        F.coalesce(F.col("institution_name"), F.lit("")) != "")
    scored = materialised(df.withColumn("claims_institution", claims), "page-events")
    out = enrich(scored, ages, phish, score="combined_score", reasons="all_reasons")
    return with_final_verdict(out, "combined_score", "verdict", sensitivity)

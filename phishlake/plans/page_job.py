"""Page verdicts: capped keyword categories plus form-field checks."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from phishlake import fixed_values as fv
from phishlake.functions import bands
from phishlake.functions.hosts import ANY_HOST_SCHEMES, with_canonical_host
from phishlake.functions.settle import settled
from phishlake.functions.text import (
    any_term, distinct_terms, ends_with_any, host_under, matched_terms, text_or_empty,
)
from phishlake.sources.lists import Category


@dataclass(frozen=True)
class PageConfig:
    credential_category: str = "credential_harvesting"
    payment_hosts: tuple[str, ...] = fv.PAYMENT_HOSTS
    check_national_id: bool = True
    is_payment_page: bool = False


def haystack(title: str = "title", meta: str = "meta_description", text: str = "text") -> Column:
    parts = [text_or_empty(F.col(c)) for c in (title, meta, text)]
    return F.lower(F.concat(parts[0], F.lit("\n"), parts[1], F.lit("\n"), parts[2]))


def category_terms(category: Category) -> list[str]:
    """Both languages always count; the same spelling counts once."""
    return distinct_terms((*category.terms, *category.terms_fr))


def category_hits(hay: Column, category: Category) -> Column:
    return F.size(matched_terms(hay, category_terms(category)))


def category_score(hits: Column, category: Category) -> Column:
    total = hits * F.lit(category.weight or 0)
    return total if category.cap is None else F.least(total, F.lit(category.cap))


def _descriptor(f: Column) -> Column:
    return F.lower(F.concat_ws(" ", *[
        text_or_empty(f[k]) for k in ("name", "id", "placeholder", "label_text")]))


def field_flags(credential: Category | None, config: PageConfig, host: Column,
                fields: Column, is_https: Column) -> dict[str, Column]:
    """National id, password over http and card-code checks, each at most once."""
    fields = F.coalesce(fields, F.array().cast(
        "array<struct<name:string,id:string,placeholder:string,type:string,"
        "autocomplete:string,label_text:string>>"))
    sin_terms = credential.sin_terms if credential else ()
    cvv_terms = credential.cvv_terms if credential else ()
    gov = credential.gov_suffixes if credential else fv.GOV_SUFFIXES
    pay = F.lit(False)
    for entry in config.payment_hosts:
        pay = pay | host_under(host, entry)
    off = F.lit(False)
    sin = F.exists(fields, lambda f: any_term(_descriptor(f), sin_terms)) & ~ends_with_any(host, gov)
    password = ~F.coalesce(is_https, F.lit(False)) & F.exists(
        fields, lambda f: F.lower(text_or_empty(f["type"])) == "password")
    card = ~pay & F.exists(fields, lambda f: (
        F.lower(text_or_empty(f["autocomplete"])) == fv.CARD_CODE_AUTOCOMPLETE
    ) | any_term(_descriptor(f), cvv_terms))
    return {
        "national_id_field": sin if config.check_national_id and sin_terms else off,
        "password_over_http": password,
        "card_code_field": off if config.is_payment_page else card,
    }


def score_pages(features: DataFrame, categories: list[Category],
                config: PageConfig = PageConfig()) -> DataFrame:
    """Add ``content_score, content_verdict, content_reasons, categories_hit``."""
    inputs = features.columns
    credential = next((c for c in categories if c.name == config.credential_category), None)
    weight = fv.CREDENTIAL_WEIGHT
    if credential is not None and credential.weight is not None:
        weight = credential.weight
    plain = [c for c in categories if not c.structural and category_terms(c)]

    df = with_canonical_host(features, "url", "_page_host", ANY_HOST_SCHEMES)
    df = df.withColumn("_host", text_or_empty(F.col("_page_host"))).withColumn("_hay", haystack())
    flags = field_flags(credential, config, F.col("_host"), F.col("fields"), F.col("is_https"))
    df = df.withColumns({
        **{f"_n{i}": category_hits(F.col("_hay"), c) for i, c in enumerate(plain)},
        **{f"_{name}": flag for name, flag in flags.items()},
    })

    fired = [(F.col(f"_n{i}") > 0, c) for i, c in enumerate(plain)]
    total = F.lit(0)
    for i, c in enumerate(plain):
        total = total + category_score(F.col(f"_n{i}"), c)
    total = total + bands.flag_sum(*[(F.col(f"_{n}"), weight) for n in flags])
    any_field = F.col("_national_id_field") | F.col("_password_over_http") | F.col("_card_code_field")
    df = (
        df.withColumn("content_score", bands.capped(total))
        .withColumn("content_verdict", bands.band(F.col("content_score")))
        .withColumn("content_reasons", bands.fired_codes(
            *[(f, f"terms:{c.name}") for f, c in fired],
            *[(F.col(f"_{n}"), n) for n in flags]))
        .withColumn("categories_hit", bands.fired_codes(
            *[(f, c.name) for f, c in fired], (any_field, config.credential_category)))
    )
    out = ["content_score", "content_verdict", "content_reasons", "categories_hit"]
    return settled(df.select(*inputs, *out), out)

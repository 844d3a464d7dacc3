"""URL verdicts.

Host facts are worked out once per distinct host (the aggregation combines
map-side, so a host holding a third of all rows costs one row per task) and
joined back with hot hosts salted. Only the fake-government check needs the path
and stays on the row.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from phishlake import fixed_values as fv
from phishlake.functions import bands
from phishlake.functions.hosts import (
    fold_lookalikes, has_fake_gov, has_risky_tld, hyphen_count, is_ip_host, label_runs,
    with_hosts,
)
from phishlake.functions.settle import settled
from phishlake.operators.lookalike import (
    close_enough, host_keys, lookalike_targets, target_keys, target_shapes,
)
from phishlake.operators.lookups import (
    ListTable, hot_keys, local_frame, longest_suffix_join, lookup_join, salted_join,
)
from phishlake.sources.workdir import materialised

HOST_KEYS = ["host", "raw_host"]
_JOIN_KEYS = {"host": "_host_key", "raw_host": "_raw_host_key"}


@dataclass(frozen=True)
class UrlConfig:
    risky_tlds: tuple[str, ...] = fv.RISKY_TLDS
    gov_keywords: tuple[str, ...] = fv.GOV_KEYWORDS
    gov_suffixes: tuple[str, ...] = fv.GOV_SUFFIXES
    min_lookalike_len: int = 0


def _probe_keys(allow: ListTable, shapes: list[int]) -> Column:
    """Join keys of one unlisted host: label runs, look-alike pieces, and itself.

    The last one (kind 'self') keeps the host alive when nothing else matches.
    """
    def key(kind, m, no, piece):
        return F.struct(F.lit(kind).alias("kind"), m.alias("m"), no.alias("no"),
                        piece.alias("piece"))

    zero = F.lit(0)
    runs = F.transform(label_runs(F.col("host"), allow.depths),
                       lambda r: key("run", zero, zero, r))
    pieces = F.transform(F.array_distinct(host_keys("_folded", shapes)),
                         lambda k: key("alike", k["m"], k["no"], k["piece"]))
    myself = F.array(key("self", zero, zero, F.lit("")))
    return F.when(F.col("allow").isNull() & ~F.col("blocked"),
                  F.concat(myself, runs, pieces)).otherwise(myself)


def _probe_targets(allow: ListTable, min_len: int) -> DataFrame:
    runs = allow.df.select(
        F.lit("run").alias("kind"), F.lit(0).alias("m"), F.lit(0).alias("no"),
        F.col("domain").alias("piece"), F.col("domain").alias("_target"),
        F.lit(None).cast("string").alias("folded"), F.col("ord").alias("_ord"),
    )
    alike = target_keys(lookalike_targets(allow, min_len)).select(
        F.lit("alike").alias("kind"), "m", "no", "piece",
        F.col("domain").alias("_target"), "folded", F.col("ord").alias("_ord"),
    )
    myself = local_frame(
        allow.df.sparkSession, [("self", 0, 0, "", None, None, None)],
        "kind string, m int, no int, piece string, _target string, folded string, _ord int")
    return runs.unionByName(alike).unionByName(myself)


def host_facts(hosts: DataFrame, allow: ListTable, block: ListTable,
               config: UrlConfig = UrlConfig()) -> DataFrame:
    """Facts per (host, raw_host): allow entry, block flag, look-alike, spoof.

    One straight pipeline: listed hosts leave early; for the rest the embedded
    -domain and fuzzy checks share one equality join, and only matches reach the
    (already co-partitioned) aggregation per host.
    """
    df = longest_suffix_join(hosts.select(*HOST_KEYS), "host", allow, "allow",
                             ["official_url", "name"])
    df = longest_suffix_join(df, "host", block, "_block")
    df = (
        df.withColumn("blocked", F.col("_block").isNotNull() & F.col("allow").isNull())
        .drop("_block")
        .withColumn("_folded", fold_lookalikes(F.col("raw_host")))
    )
    keep = [*HOST_KEYS, "allow", "blocked", "_folded"]
    df = df.select(*keep, F.explode_outer(_probe_keys(allow, target_shapes(allow, config.min_lookalike_len))).alias("_k")).select(*keep, "_k.*")
    df = lookup_join(df, _probe_targets(allow, config.min_lookalike_len),
                     ["kind", "m", "no", "piece"], allow.small, "inner")
    target = F.col("_target")
    spoof = (F.col("kind") == "run") & ~F.col("host").endswith(target)
    alike = (
        (F.col("kind") == "alike") & (target != F.col("raw_host"))
        & close_enough(F.col("_folded"), F.col("folded"))
    )
    df = (
        df.groupBy(*HOST_KEYS, "allow", "blocked")
        .agg(F.max(F.coalesce(spoof, F.lit(False))).alias("spoof"),
             F.min(F.when(alike, F.col("_ord"))).alias("_ord"))
    )
    named = allow.df.filter("high_value").select(
        F.col("ord").alias("_ord"), F.struct("domain", "official_url", "name").alias("lookalike"))
    return (
        lookup_join(df, named, ["_ord"], allow.small).drop("_ord")
        .withColumn("risky_tld", has_risky_tld(F.col("host"), config.risky_tlds))
        .withColumn("hyphens", hyphen_count(F.col("host")))
        .withColumn("ip_host", is_ip_host(F.col("host")))
        .withColumn("encoded", F.col("host").contains("xn--"))
    )


def with_host_facts(parsed: DataFrame, allow: ListTable, block: ListTable,
                    config: UrlConfig = UrlConfig()) -> DataFrame:
    """Join host facts to parsed URL rows."""
    # filter on the cheap flag only: a filter on host would be pushed down and
    # would repeat the whole host expression at the scan
    hosts = (
        parsed.filter(F.col("is_web"))
        .groupBy(*HOST_KEYS).agg(F.count(F.lit(1)).alias("_rows"))
    )
    facts = host_facts(hosts, allow, block, config).withColumnsRenamed(_JOIN_KEYS)
    hot = hot_keys(hosts, HOST_KEYS, count="_rows").withColumnsRenamed(_JOIN_KEYS)
    # rows that are no web address have no facts: a null key spreads them over all tasks
    keyed = parsed.withColumns({
        k: F.when(F.col("is_web"), F.col(c)) for c, k in _JOIN_KEYS.items()})
    return salted_join(keyed, facts, list(_JOIN_KEYS.values()), hot=hot).drop(*_JOIN_KEYS.values())


def _with_user_flags(df: DataFrame, user_lists: ListTable, tenant: str) -> DataFrame:
    """Flags from the tenant's own allow and block lists.

    Lists too long to broadcast are resolved once per distinct (tenant, host), from a
    written table of those pairs, so their joins never repeat what led to the rows.
    """
    if user_lists.small:
        return _user_flags(df, user_lists, tenant)
    pairs = materialised(
        df.groupBy(tenant, "host", "idna_failed").agg(F.count(F.lit(1)).alias("_rows")), "tenant-hosts")
    flags = _user_flags(pairs, user_lists, tenant)
    hot = hot_keys(pairs, [tenant, "host"], count="_rows").groupBy(tenant, "host").agg(
        F.sum("_salts").cast("int").alias("_salts"))
    flags = flags.groupBy(tenant, "host").agg(
        F.max("user_allow").alias("user_allow"), F.max("user_block").alias("user_block"))
    found = salted_join(df, flags, [tenant, "host"], hot=hot)
    return found.withColumns({
        c: F.coalesce(c, F.lit(False)) & ~F.col("idna_failed") for c in ("user_allow", "user_block")})


def _user_flags(df: DataFrame, user_lists: ListTable, tenant: str) -> DataFrame:
    for kind, flag in (("allow", "user_allow"), ("block", "user_block")):
        part = ListTable(
            user_lists.df.filter(F.col("kind") == kind)
            .select(F.col("tenant").alias(tenant), "domain"),
            user_lists.local_rows, user_lists.broadcast_rows,
        )
        df = longest_suffix_join(df, "host", part, "_user", by=[tenant])
        df = df.withColumn(flag, F.col("_user").isNotNull() & ~F.col("idna_failed")).drop("_user")
    return df


def score_urls(urls: DataFrame, allow: ListTable, block: ListTable,
               config: UrlConfig = UrlConfig(), url: str = "url",
               user_lists: ListTable | None = None, tenant: str = "tenant",
               keep_flags: bool = False) -> DataFrame:
    """Add ``verdict, score, reasons, official_url, institution_name`` per row.

    Give rows an id or time column: rows of hot hosts are spread by a hash of
    their other columns.
    """
    inputs = urls.columns
    parsed = with_hosts(urls, url)
    df = with_host_facts(parsed, allow, block, config)
    if user_lists is not None:
        df = _with_user_flags(df, user_lists, tenant)
    else:
        df = df.withColumn("user_allow", F.lit(False)).withColumn("user_block", F.lit(False))

    scored = F.col("is_web") & (F.col("host") != "")
    alike = F.col("lookalike").isNotNull()
    gov = has_fake_gov(F.col("host"), F.col("path"), config.gov_keywords, config.gov_suffixes)
    failed = F.col("idna_failed") & ~F.col("encoded")
    signals = (
        (alike, fv.WEIGHT_LOOKALIKE, "lookalike_domain"),
        (gov, fv.WEIGHT_FAKE_GOV, "fake_government"),
        (F.col("risky_tld"), fv.WEIGHT_RISKY_TLD, "risky_tld"),
        (F.col("hyphens") >= fv.MIN_HYPHENS, fv.WEIGHT_HYPHENS, "many_hyphens"),
        (F.col("ip_host"), fv.WEIGHT_IP_HOST, "ip_host"),
        (F.col("encoded"), fv.WEIGHT_ENCODED_HOST, "encoded_host"),
        (failed, fv.WEIGHT_ENCODED_HOST, "broken_host"),
        (F.col("spoof"), fv.WEIGHT_SUBDOMAIN_SPOOF, "subdomain_spoof"),
    )
    total = bands.capped(bands.flag_sum(*[(f, w) for f, w, _ in signals]))
    codes = bands.fired_codes(*[(f, c) for f, _, c in signals])
    none = F.array().cast("array<string>")
    safe, listed, blocked = ~scored, F.col("allow").isNotNull(), F.col("blocked")
    df = df.withColumn(
        "score",
        F.when(safe | F.col("user_allow"), 0).when(F.col("user_block"), fv.SCORE_CAP)
        .when(listed, 0).when(blocked, fv.SCORE_CAP).otherwise(total).cast("int"),
    ).withColumn(
        "reasons",
        F.when(F.col("user_allow"), F.array(F.lit("user_allowed")))
        .when(F.col("user_block"), F.array(F.lit("user_blocked")))
        .when(safe, none)
        .when(listed, F.array(F.lit("allow_listed")))
        .when(blocked, F.array(F.lit("known_bad"))).otherwise(codes),
    )
    named = ~F.col("user_allow") & ~F.col("user_block")
    entry = F.when(named, F.when(listed, F.struct("allow.official_url", "allow.name"))
                   .otherwise(F.struct("lookalike.official_url", "lookalike.name")))
    df = (
        df.withColumn("verdict", bands.band(F.col("score")))
        .withColumn("_entry", entry)
        .withColumn("official_url", F.col("_entry.official_url"))
        .withColumn("institution_name", F.col("_entry.name"))
    )
    out = [*inputs, "verdict", "score", "reasons", "official_url", "institution_name"]
    if keep_flags:
        out += ["host", "raw_host", "path", "idna_failed"]
    return settled(df.select(*out), out[len(inputs):len(inputs) + 5])

"""Message verdicts.

Everything that reads a body is worked out on the row. Host checks also stay on the
row while the allow-list is within its size bound; beyond it the narrow results are
written once, hosts are exploded, resolved per distinct host and folded back per row.
Both ways give each row its own flags: the key that they come back by is a hash of the
whole input row, so neither repeated nor null ids mix rows.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from phishlake.functions import bands
from phishlake.functions.message_parts import with_message_parts
from phishlake.functions.reputation import sender_signals
from phishlake.functions.settle import settled
from phishlake.operators.lookalike import lookalike_pairs
from phishlake.operators.lookups import (
    ListTable, contained_domain_hosts, longest_suffix_join, salted_join,
)
from phishlake.operators.rules import (
    COUNT_KEY, FIRED_TYPE, Context, HostLists, alias_claims, explanation, fire_in_order,
    fired_struct, host_flags, is_structural, org_of_sender, rule_condition, split_rules,
)
from phishlake.operators.term_join import term_hits
from phishlake.sources.lists import Org, Rule
from phishlake.sources.workdir import materialised

ROW_LOCAL_DOMAINS = 5_000
ROW_KEY = "_row"


@dataclass(frozen=True)
class MessageConfig:
    auth_checks: bool = False
    lang: str = "en"
    id_col: str = "msg_id"


def bounded_host_lists(allow: ListTable, bound: int = ROW_LOCAL_DOMAINS) -> HostLists | None:
    """The allow-list for row-local use, or None when it is too long for that."""
    if allow.rows is None or len(allow.rows) > bound:
        return None
    rows = sorted(allow.rows, key=lambda r: r.ord)
    return HostLists(tuple(r.domain for r in rows),
                     tuple(r.domain for r in rows if r.high_value))


def joined_host_flags(parts: DataFrame, allow: ListTable, id_col: str) -> DataFrame:
    """The flags of :func:`host_flags` for an allow-list of any size.

    ``parts`` needs id, sender, link_hosts, all_hosts, anchor_hosts, display_hay.
    Hosts are resolved once per distinct host; only ids and hosts are shuffled.
    """
    role = "role"

    def rows(array: Column, name: str) -> DataFrame:
        return parts.select(id_col, F.explode(array).alias("host")).select(
            id_col, "host", F.lit(name).alias(role))

    pairs = (
        rows(F.array_compact(F.array("sender.domain")), "from")
        .unionByName(rows(F.col("link_hosts"), "link"))
        .unionByName(rows(F.array_compact(F.transform("anchor_hosts", lambda a: a["text"])), "text"))
        .distinct()
    )
    hosts = pairs.select("host").distinct()
    facts = longest_suffix_join(hosts, "host", allow, "_allow")
    facts = facts.select("host", F.col("_allow").isNotNull().alias("in_allow"))
    alike = lookalike_pairs(hosts, "host", allow).select(
        "host", F.lit(True).alias("alike")).distinct()
    holds = contained_domain_hosts(hosts, "host", allow).withColumn("holds", F.lit(True))
    facts = facts.join(alike, "host", "left").join(holds, "host", "left")
    known = salted_join(pairs, facts, ["host"])

    def any_of(condition: Column) -> Column:
        return F.coalesce(F.bool_or(F.coalesce(condition, F.lit(False))), F.lit(False))

    mail = F.col(role).isin("from", "link")
    named = term_hits(parts, id_col, "display_hay", allow.df.select(
        F.lit("allow").alias("group"), F.col("domain").alias("term"))).select(
        id_col, F.lit(True).alias("names_allow_domain")).distinct()
    flags = known.groupBy(id_col).agg(
        any_of((F.col(role) == "from") & F.col("in_allow")).alias("from_in_allow"),
        any_of((F.col(role) == "link") & ~F.col("in_allow")).alias("link_outside_allow"),
        any_of(mail & ~F.col("in_allow")).alias("host_outside_allow"),
        any_of((F.col(role) == "text") & F.col("in_allow")).alias("text_in_allow"),
        any_of(mail & F.col("holds")).alias("holds_allow_domain"),
        any_of(mail & F.col("alike") & ~F.col("in_allow")).alias("is_lookalike"),
    )
    return flags.join(named, id_col, "full")


def with_predicate_inputs(messages: DataFrame, allow: ListTable, orgs: list[Org],
                          config: MessageConfig) -> tuple[DataFrame, Context]:
    """Message parts, organisation claims and host flags as columns."""
    lists = bounded_host_lists(allow)
    ctx = Context(tuple(orgs), lists or HostLists(), config.auth_checks)
    if lists is None:
        columns = [F.col(c) for c in messages.columns]
        messages = messages.withColumn(ROW_KEY, F.struct(
            F.xxhash64(*columns).alias("a"), F.xxhash64(F.lit(1), *columns).alias("b")))
    df = with_message_parts(messages).withColumns({
        "claimed_orgs": alias_claims(ctx), "sender_orgs": org_of_sender(ctx)})
    if lists is not None:
        return df.withColumns({
            name: F.coalesce(flag, F.lit(False)) for name, flag in host_flags(ctx).items()}), ctx
    parts = materialised(df.select(
        ROW_KEY, "sender", "link_hosts", "all_hosts", "anchor_hosts", "display_hay"),
        "message-hosts")
    flags = joined_host_flags(parts, allow, ROW_KEY)
    df = df.join(flags, ROW_KEY, "left").drop(ROW_KEY)
    return df.withColumns({n: F.coalesce(n, F.lit(False)) for n in host_flags(ctx)}), ctx


def official_contact(claimed: Column, orgs: list[Org]) -> Column:
    """Contact of the first claimed organisation; its name falls back to the id."""
    none = "struct<name:string,url:string,phone:string>"
    first = F.get(claimed, F.lit(0))
    out = F.lit(None).cast(none)
    for o in orgs:
        out = F.when(first == o.org_id, F.struct(
            F.lit(o.name or o.org_id).alias("name"),
            F.lit(o.contact_url or None).cast("string").alias("url"),
            F.lit(o.phone or None).cast("string").alias("phone"),
        ).cast(none)).otherwise(out)
    return out


def score_messages(messages: DataFrame, allow: ListTable, orgs: list[Org], rules: list[Rule],
                   config: MessageConfig = MessageConfig()) -> DataFrame:
    """One verdict row per message: id, score, verdict, fired rules, links, sender, contact."""
    df, ctx = with_predicate_inputs(messages, allow, orgs, config)
    lang = F.lit(config.lang)
    df = df.withColumn("sender_verified", F.coalesce(
        F.col("sender.domain").isNotNull()
        & (F.col("from_in_allow") | (F.size("sender_orgs") > 0)), F.lit(False)))
    plain, counting = split_rules(rules)
    names = [f"_rule{i}" for i in range(len(rules))]
    gates = [F.lit(True) if is_structural(r) else ~F.col("sender_verified")
             for r in plain + counting]
    signals = sender_signals(F.col("sender.domain"), F.col("sender.local"))
    df = df.withColumns({
        **{n: g & rule_condition(ctx, r) for n, g, r in zip(names, gates, plain + counting)},
        **{f"_sig_{code}": ~F.col("sender_verified") & flag for code, _, flag in signals},
    })

    rows = [fired_struct(r.rule_id, r.weight, explanation(r, lang)) for r in plain + counting]
    fired = F.array_compact(F.array(*[
        F.when(F.col(n), row) for n, row in zip(names, rows[:len(plain)])
    ])).cast(FIRED_TYPE) if plain else F.array().cast(FIRED_TYPE)
    steps = []
    for n, r, row in zip(names[len(plain):], counting, rows[len(plain):]):
        need = r.match[COUNT_KEY]
        ok = F.col(n) if isinstance(need, (int, float)) else F.lit(False)
        steps.append((ok, int(need) if isinstance(need, (int, float)) else 0, row))
    reputation = F.array_compact(F.array(*[
        F.when(F.col(f"_sig_{code}"), fired_struct(code, weight, F.lit(code)))
        for code, weight, _ in signals
    ])).cast(FIRED_TYPE)
    df = (
        df.withColumn("_fired", fire_in_order(fired, steps))
        .withColumn("fired_rules", F.concat(F.col("_fired"), reputation))
        .withColumn("score", bands.capped(F.aggregate(
            "fired_rules", F.lit(0), lambda a, x: a + x["weight"])))
        .withColumn("verdict", bands.band(F.col("score")))
        .withColumn("official_contact", official_contact(F.col("claimed_orgs"), orgs))
    )
    df = df.select(
        config.id_col, "score", "verdict", "fired_rules", F.col("links").alias("extracted_links"),
        F.col("sender.domain").alias("sender_domain"), "sender_verified", "official_contact",
    )
    return settled(df, ["score", "verdict", "fired_rules", "sender_verified", "official_contact"])


def localised(fired: DataFrame, rules: DataFrame, lang: str) -> DataFrame:
    """Long form: (id, rule_id) joined with the rule table for its explanation."""
    text = F.coalesce(
        F.when(F.lit(lang) == "fr", F.nullif("user_explanation_fr", F.lit(""))),
        F.nullif("user_explanation", F.lit("")), F.col("rule_id"))
    return fired.join(rules, "rule_id", "left").withColumn("explanation", text).drop(
        "user_explanation", "user_explanation_fr")



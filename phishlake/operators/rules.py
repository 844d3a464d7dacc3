"""Weighted message rules compiled to boolean columns.

A rule is the AND of its predicates. Each predicate is a small function from the
message columns and its argument to a Column; unknown names and malformed
arguments give a predicate that never fires.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column
from pyspark.sql import functions as F

from phishlake import fixed_values as fv
from phishlake.functions.hosts import IP_PATTERN, close_enough_hosts, host_tails_in
from phishlake.functions.message_parts import (
    extract_amounts, extract_emails, has_phone,
)
from phishlake.functions.text import (
    SPACE, WORD_END, WORD_START, any_term, claimed_groups, ends_with_any, host_under,
)
from phishlake.sources.lists import Org, Rule

COUNT_KEY = "other_rules_triggered_count_gte"
NINE_DIGITS = "[0-9]{3}[- ]?[0-9]{3}[- ]?[0-9]{3}"
EXT_KEY, LOCKED_KEY = "attachment_extension_in", "or_password_protected_archive"


@dataclass(frozen=True)
class HostLists:
    """Allow-list of bounded size for row-local host checks."""

    allow: tuple[str, ...] = ()
    high_value: tuple[str, ...] = ()


@dataclass(frozen=True)
class Context:
    """What predicates may refer to besides the message columns."""

    orgs: tuple[Org, ...] = ()
    hosts: HostLists = field(default_factory=HostLists)
    auth_checks: bool = False


def c(name: str) -> Column:
    return F.col(name)


def _domain_known() -> Column:
    return c("sender.domain").isNotNull()


def _member(col: Column, arg) -> Column:
    # a text argument means substring, a list means membership
    return F.lit(arg).contains(col) if isinstance(arg, str) else col.isin(list(arg))


def _strings(arg) -> list[str]:
    if not isinstance(arg, (list, tuple)):
        raise TypeError("list expected")
    return [str(x) for x in arg]


def _terms(arg) -> list[str]:
    return _strings(arg) if isinstance(arg, (list, tuple)) else []


def in_allow(host: Column, lists: HostLists) -> Column:
    return host_tails_in(host, lists.allow)


def lookalike_of_high_value(host: Column, lists: HostLists) -> Column:
    return ~in_allow(host, lists) & close_enough_hosts(host, lists.high_value)


def holds_allow_domain(host: Column, lists: HostLists) -> Column:
    if not lists.allow:
        return F.lit(False)
    table = F.array(*map(F.lit, lists.allow))
    return F.exists(table, lambda d: host.contains(d) & ~(
        (host == d) | host.endswith(F.concat(F.lit("."), d))))


def org_of_sender(ctx: Context) -> Column:
    """Ids of the organisations that send from the sender's domain."""
    d = c("sender.domain")
    hits = [
        F.when(_any(host_under(d, s) for s in o.sending_domains), F.lit(o.org_id))
        for o in ctx.orgs if o.sending_domains
    ]
    return F.array_compact(F.array(*hits)) if hits else F.array().cast("array<string>")


def _any(columns) -> Column:
    out = F.lit(False)
    for x in columns:
        out = out | x
    return out


def alias_claims(ctx: Context) -> Column:
    """Ids of the organisations named in the display name or body, in list order."""
    return claimed_groups(c("display_hay"), [(o.org_id, list(o.aliases)) for o in ctx.orgs])


def host_flags(ctx: Context) -> dict[str, Column]:
    """Allow-list facts per message, computed on the row (bounded lists)."""
    lists = ctx.hosts
    return {
        "from_in_allow": _domain_known() & in_allow(c("sender.domain"), lists),
        "link_outside_allow": F.exists("link_hosts", lambda h: ~in_allow(h, lists)),
        "host_outside_allow": F.exists("all_hosts", lambda h: ~in_allow(h, lists)),
        "text_in_allow": F.exists("anchor_hosts", lambda a: in_allow(a["text"], lists)),
        "holds_allow_domain": F.exists("all_hosts", lambda h: holds_allow_domain(h, lists)),
        "is_lookalike": F.exists("all_hosts", lambda h: lookalike_of_high_value(h, lists)),
        "names_allow_domain": any_term(c("display_hay"), lists.allow),
    }


def _amount_in_range(arg) -> Column:
    low, high = float(arg[0]), float(arg[1])
    return F.exists(extract_amounts(c("body")), lambda a: (a >= low) & (a <= high))


def _all_of(groups) -> Column:
    out = F.lit(True)
    for g in groups if isinstance(groups, (list, tuple)) else [()]:
        out = out & any_term(c("body_lower"), _terms(g))
    return out


def _extension(arg) -> Column:
    exts = [x.lower() for x in _strings(arg)]
    pattern = "|".join(x.replace(".", r"\.", 1) for x in exts)
    match = c("body").rlike(rf"(?i)[^{SPACE}](?:{pattern})(?:[^a-z0-9]|$)")
    if all(x.replace(".", "", 1).isalnum() for x in exts):
        match = _any(c("body_lower").contains(x) for x in exts) & match
    return match


def _free_mail_target(ctx, arg) -> Column:
    return F.exists(
        extract_emails(c("body")),
        lambda e: F.lower(F.get(F.split(e, "@"), F.lit(1))).isin(list(fv.FREE_MAIL_HOSTS))
        & ~e.eqNullSafe(c("sender.email")),
    )


def _not_sending_for(ctx: Context, arg) -> Column:
    ids = _strings(arg)
    known = [o for o in ctx.orgs if o.org_id in ids]
    d = c("sender.domain")
    return _domain_known() & ~_any(host_under(d, s) for o in known for s in o.sending_domains)


PREDICATES: dict[str, Callable[[Context, object], Column]] = {
    # sender domain
    "from_domain_in": lambda ctx, a: _domain_known() & _member(c("sender.domain"), a),
    "from_domain_contains_any": lambda ctx, a: _domain_known() & _any(
        c("sender.domain").contains(s) for s in _strings(a)),
    "from_domain_starts_with": lambda ctx, a: _domain_known() & c("sender.domain").startswith(str(a)),
    "from_domain_tld_in": lambda ctx, a: _domain_known() & ends_with_any(
        c("sender.domain"), _strings(a)),
    "from_domain_not_ends_with": lambda ctx, a: _domain_known() & ~ends_with_any(
        c("sender.domain"), _strings(a)),
    "from_domain_in_whitelist": lambda ctx, a: c("from_in_allow"),
    "from_domain_not_in_whitelist": lambda ctx, a: _domain_known() & ~c("from_in_allow"),
    "from_domain_not_in_known_sender_domains_for": _not_sending_for,
    "reply_to_domain_in": lambda ctx, a: c("reply_domain").isNotNull() & _member(
        c("reply_domain"), a),
    # texts
    "body_contains_any": lambda ctx, a: any_term(c("body_lower"), _terms(a)),
    "body_contains_any_secondary": lambda ctx, a: any_term(c("body_lower"), _terms(a)),
    "subject_or_body_contains_any": lambda ctx, a: any_term(c("subject_hay"), _terms(a)),
    "body_or_display_contains_any": lambda ctx, a: any_term(c("display_hay"), _terms(a)),
    "body_or_display_claims_institution": lambda ctx, a: F.size("claimed_orgs") > 0,
    "body_contains_all_of": lambda ctx, a: _all_of(a),
    "body_contains_phone_number": lambda ctx, a: has_phone(c("body")),
    "body_contains_sin_pattern": lambda ctx, a: c("body").rlike(NINE_DIGITS) & c("body").rlike(
        WORD_START + NINE_DIGITS + WORD_END),
    "body_dollar_amount_in_range": lambda ctx, a: _amount_in_range(a),
    "body_appears_ai_polished": lambda ctx, a: F.lit(False),
    # links
    "link_present": lambda ctx, a: F.size("links") > 0,
    "link_domain_not_in_whitelist": lambda ctx, a: c("link_outside_allow"),
    "link_domains_contain_any": lambda ctx, a: F.exists(
        "link_hosts", lambda h: _any(host_under(h, d) for d in _strings(a))),
    "link_url_is_ip_address": lambda ctx, a: F.exists(
        "link_hosts", lambda h: h.rlike(IP_PATTERN)),
    "link_text_domain_differs_from_href_domain": lambda ctx, a: F.exists(
        "anchor_hosts", lambda x: (x["href"] != "") & (x["text"] != "") & (x["href"] != x["text"])),
    "link_text_in_whitelist": lambda ctx, a: c("text_in_allow"),
    "registrable_domain_not_in_whitelist": lambda ctx, a: c("host_outside_allow"),
    "subdomain_contains_institution_name": lambda ctx, a: c("holds_allow_domain"),
    "lookalike_of_high_value_whitelist": lambda ctx, a: c("is_lookalike"),
    # the rest
    EXT_KEY: lambda ctx, a: _extension(a),
    LOCKED_KEY: lambda ctx, a: c("body").rlike(
        rf"(?i)password[- ]?protected[{SPACE}]+(zip|archive|rar|file)"),
    "email_body_contains_html_form": lambda ctx, a: c("body").contains("<") & c("body").rlike(
        rf"(?i)<form{WORD_END}"),
    "target_email_on_free_provider": _free_mail_target,
    "spf_or_dkim_or_dmarc_failed": lambda ctx, a: F.lit(ctx.auth_checks) & F.coalesce(
        c("auth_results"), F.lit("")).rlike(rf"(?i)(spf|dkim|dmarc)[{SPACE}]*=[{SPACE}]*fail"),
    "claimed_brand_in_whitelist": lambda ctx, a: (F.size("claimed_orgs") > 0) | c(
        "names_allow_domain"),
}


def predicate(ctx: Context, name: str, arg) -> Column:
    """One predicate as a never-null boolean; anything not understood is false."""
    make = PREDICATES.get(name)
    if make is None:
        return F.lit(False)
    try:
        return F.coalesce(make(ctx, arg), F.lit(False))
    except (TypeError, ValueError, IndexError, KeyError, AttributeError):
        return F.lit(False)


def rule_condition(ctx: Context, rule: Rule) -> Column:
    """AND of a rule's predicates, the rule-count predicate left out.

    An archive predicate pairs with the extension predicate as an OR. A rule
    without predicates always fires.
    """
    match = rule.match if isinstance(rule.match, dict) else {}
    out = F.lit(True)
    rest = [k for k in match if k != COUNT_KEY]
    if LOCKED_KEY in match:
        pair = predicate(ctx, LOCKED_KEY, match[LOCKED_KEY])
        if EXT_KEY in match:
            if not isinstance(match[EXT_KEY], (list, tuple)):
                return F.lit(False)  # a malformed list drops the whole rule
            pair = pair | predicate(ctx, EXT_KEY, match[EXT_KEY])
        out = out & pair
        rest = [k for k in rest if k not in (LOCKED_KEY, EXT_KEY)]
    for k in rest:
        out = out & predicate(ctx, k, match[k])
    return out


def is_structural(rule: Rule) -> bool:
    return any(k in fv.STRUCTURAL_PREDICATES for k in (rule.match or {}))


def split_rules(rules: list[Rule]) -> tuple[list[Rule], list[Rule]]:
    """Rules on their own first, then those that count other fired rules."""
    counting = [r for r in rules if COUNT_KEY in (r.match or {})]
    return [r for r in rules if r not in counting], counting


def explanation(rule: Rule, lang: Column) -> Column:
    """French text if asked for and present, else English, else the rule id."""
    en = rule.explanation or rule.rule_id
    return F.when(lang == "fr", F.lit(rule.explanation_fr or en)).otherwise(F.lit(en))


def fired_struct(rule_id: str, weight: int, text: Column) -> Column:
    return F.struct(F.lit(rule_id).alias("id"), F.lit(weight).alias("weight"),
                    text.alias("explanation"))


FIRED_TYPE = "array<struct<id:string,weight:int,explanation:string>>"


def fire_in_order(fired: Column, counting: list[tuple[Column, int, Column]]) -> Column:
    """Add counting rules one after the other, each seeing all earlier fires."""
    if not counting:
        return fired
    steps = F.array(*[
        F.struct(ok.alias("ok"), F.lit(need).alias("need"), row.alias("row"))
        for ok, need, row in counting
    ])
    return F.aggregate(
        steps, fired,
        lambda acc, s: F.when(
            s["ok"] & (F.size(acc) >= s["need"]), F.concat(acc, F.array(s["row"]))
        ).otherwise(acc),
    )

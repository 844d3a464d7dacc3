"""Message layer: M1-M15, the 35 predicates, R1-R9."""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from checks import seeds
from checks.inputs import MESSAGES_SQL, URLS_SQL, messages, table, urls
from checks.seeds import sql_list, sql_str, sql_values
from checks.url_checks import ALLOW_SQL, _UNDER, fold_sql, host_ctes
from phishlake import fixed_values as fv
from phishlake.functions import message_parts as M
from phishlake.functions import reputation as R
from phishlake.functions.hosts import with_hosts
from phishlake.operators import rules as RU
from phishlake.operators.lookups import local_frame
from phishlake.plans.message_job import (
    MessageConfig, localised, score_messages, with_predicate_inputs,
)
from phishlake.sources.lists import Rule

CONFIG = MessageConfig(auth_checks=True)

# --- SQL side -------------------------------------------------------------------


def term_sql(hay: str, term: str) -> str:
    body = r"\s+".join(re.sub(r"([^a-z0-9 ])", r"\\\1", w) for w in term.lower().split())
    return f"regexp_matches({hay}, {sql_str('(?:^|[^a-z0-9])' + body + '(?:[^a-z0-9]|$)')})"


def any_sql(hay: str, terms) -> str:
    return "(" + " OR ".join(term_sql(hay, t) for t in terms) + ")" if terms else "FALSE"


_MAIL = r"""[^\s"'<>]+@[^\s"'<>]+""".replace("'", "''")
_ANGLED = r"^(.*?)<\s*([^<>\s]+@[^<>\s]+)\s*>$"
_QUOTES = r"""^["']|["']$""".replace("'", "''")
_ANCHOR = r"""(?i)<a[^>]*href=["']([^"']+)["'][^>]*>([^<]*)</a>""".replace("'", "''")
_LINK = r"""(?i)https?://[^\s<>"')\]]+""".replace("'", "''")


def _sender_sql(text: str, p: str) -> str:
    angled = f"regexp_matches({text}, '{_ANGLED}')"
    bare = f"regexp_extract({text}, '{_MAIL}')"
    email = f"CASE WHEN {angled} THEN regexp_extract({text}, '{_ANGLED}', 2) ELSE nullif({bare}, '') END"
    return f"""{email} AS {p}email,
        CASE WHEN {angled} THEN regexp_replace(trim(regexp_extract({text}, '{_ANGLED}', 1)), '{_QUOTES}', '', 'g')
             WHEN {bare} <> '' THEN regexp_replace(trim(concat(
                substr({text}, 1, strpos({text}, {bare}) - 1),
                substr({text}, strpos({text}, {bare}) + len({bare})))), '{_QUOTES}', '', 'g')
             ELSE {text} END AS {p}display,
        nullif(lower(string_split({email}, '@')[2]), '') AS {p}domain,
        string_split({email}, '@')[1] AS {p}local"""


_ORG_CLAIM = "list_filter([" + ", ".join(
    f"CASE WHEN {any_sql('dh', o.aliases)} THEN '{o.org_id}' END" for o in seeds.ORGS
) + "], lambda x: x IS NOT NULL)"
_ORG_SENDS = "(" + " OR ".join(
    _UNDER.format(h="domain", d=sql_str(d)) for o in seeds.ORGS for d in o.sending_domains) + ")"
_ALLOW_DOMAINS = [d for d, *_ in seeds.ALLOW]

PARTS_SQL = f"""{MESSAGES_SQL}, {ALLOW_SQL},
ms AS (SELECT *, trim(coalesce(nullif(from_hdr, ''),
        regexp_extract(body, '(?im)^from:\\s*(.+)$', 1))) AS ft, trim(reply_to) AS rt FROM messages),
mp AS (SELECT *, {_sender_sql('ft', '')},
        CASE WHEN coalesce(rt, '') <> '' THEN nullif(lower(string_split(
            CASE WHEN regexp_matches(rt, '{_ANGLED}') THEN regexp_extract(rt, '{_ANGLED}', 2)
                 ELSE regexp_extract(rt, '{_MAIL}') END, '@')[2]), '') END AS reply_domain,
        regexp_extract_all(body, '{_LINK}') AS links,
        regexp_extract_all(body, '{_ANCHOR}', 1) AS hrefs,
        regexp_extract_all(body, '{_ANCHOR}', 2) AS texts FROM ms),
mq AS (SELECT *, lower(body) AS bl, lower(concat(coalesce(subject, ''), chr(10), body)) AS sh,
        lower(concat(display, chr(10), body)) AS dh FROM mp),
ml AS (SELECT msg_id, UNNEST(range(1, len(links) + 1)) AS pos, UNNEST(links) AS url FROM mp),
{host_ctes('ml', name='linked')},
ma AS (SELECT msg_id, UNNEST(range(1, len(hrefs) + 1)) AS pos, UNNEST(hrefs) AS url FROM mp),
{host_ctes('ma', 'https?|ftp|wss?', 'hrefed')},
mt AS (SELECT msg_id, UNNEST(range(1, len(texts) + 1)) AS pos, trim(UNNEST(texts)) AS url FROM mp),
{host_ctes('mt', 'https?|ftp|wss?', 'texted')},
anch AS (SELECT a.msg_id, regexp_replace(a.canon, '^www[.]', '') AS hh,
        regexp_replace(coalesce(t.canon, CASE WHEN regexp_matches(t.url, '(?i)^[a-z0-9.-]+\\.[a-z]{{2,}}$')
            THEN lower(t.url) END), '^www[.]', '') AS th
    FROM hrefed a JOIN texted t USING (msg_id, pos)),
mh AS (SELECT msg_id, 'link' AS role, canon AS h FROM linked WHERE canon IS NOT NULL
       UNION ALL SELECT msg_id, 'from', domain FROM mp WHERE domain IS NOT NULL
       UNION ALL SELECT msg_id, 'text', th FROM anch WHERE coalesce(th, '') <> ''),
hf AS (SELECT h, bool_or({_UNDER.format(h='h', d='domain')}) AS ok,
        bool_or(contains(h, domain) AND NOT {_UNDER.format(h='h', d='domain')}) AS holds,
        bool_or(high_value AND h <> domain AND levenshtein({fold_sql('h')}, {fold_sql('domain')}) <= 2) AS alike
    FROM (SELECT DISTINCT h FROM mh) CROSS JOIN allow GROUP BY h),
mf AS (SELECT msg_id, bool_or(role = 'from' AND ok) AS from_allow, bool_or(role = 'link' AND NOT ok) AS link_out,
        bool_or(role <> 'text' AND NOT ok) AS host_out, bool_or(role = 'text' AND ok) AS text_allow,
        bool_or(role <> 'text' AND holds) AS holds, bool_or(role <> 'text' AND alike AND NOT ok) AS alike,
        bool_or(role = 'link' AND regexp_matches(h, '^[0-9]{{1,3}}([.][0-9]{{1,3}}){{3}}$')) AS ip_link,
        list(h) FILTER (role = 'link') AS lhosts
    FROM mh JOIN hf USING (h) GROUP BY msg_id),
md AS (SELECT msg_id, bool_or(hh <> '' AND th <> '' AND hh <> th) AS differs FROM anch GROUP BY msg_id),
m AS (SELECT mq.*, coalesce(from_allow, FALSE) AS from_allow, coalesce(link_out, FALSE) AS link_out,
        coalesce(host_out, FALSE) AS host_out, coalesce(text_allow, FALSE) AS text_allow,
        coalesce(holds, FALSE) AS holds, coalesce(alike, FALSE) AS alike,
        coalesce(ip_link, FALSE) AS ip_link, coalesce(lhosts, []) AS lhosts,
        coalesce(differs, FALSE) AS differs, {_ORG_CLAIM} AS claims,
        domain IS NOT NULL AND (coalesce(from_allow, FALSE) OR coalesce({_ORG_SENDS}, FALSE)) AS verified
    FROM mq LEFT JOIN mf USING (msg_id) LEFT JOIN md USING (msg_id))"""


def _or(parts) -> str:
    parts = list(parts)
    return "(" + " OR ".join(parts) + ")" if parts else "FALSE"


def _ends(x, sfx):
    return _or(f"ends_with({x}, {sql_str(s)})" for s in sfx)


def _not_org(ids):
    doms = [d for o in seeds.ORGS if o.org_id in ids for d in o.sending_domains]
    return f"domain IS NOT NULL AND NOT {_or(_UNDER.format(h='domain', d=sql_str(d)) for d in doms)}"


_SIN = r"\b\d{3}[- ]?\d{3}[- ]?\d{3}\b"
_PHONE = r"(?:\+?1[-. ]?)?\(?\d{3}\)?[-. ]\d{3}[-. ]\d{4}"
_DOLLARS = r"\$\s?(\d[\d,]*(?:\.\d{2})?)"
_EMAILS = r"(?i)[a-z0-9._%+-]+@[a-z0-9.-]+\.[a-z]{2,}"

PREDICATE_SQL = {
    "from_domain_in": lambda a: f"domain IN ({', '.join(map(sql_str, a))})",
    "from_domain_contains_any": lambda a: _or(f"contains(domain, {sql_str(s)})" for s in a),
    "from_domain_starts_with": lambda a: f"starts_with(domain, {sql_str(a)})",
    "from_domain_tld_in": lambda a: _ends("domain", a),
    "from_domain_not_ends_with": lambda a: f"domain IS NOT NULL AND NOT {_ends('domain', a)}",
    "from_domain_in_whitelist": lambda a: "from_allow",
    "from_domain_not_in_whitelist": lambda a: "domain IS NOT NULL AND NOT from_allow",
    "from_domain_not_in_known_sender_domains_for": _not_org,
    "reply_to_domain_in": lambda a: f"reply_domain IN ({', '.join(map(sql_str, a))})",
    "body_contains_any": lambda a: any_sql("bl", a),
    "body_contains_any_secondary": lambda a: any_sql("bl", a),
    "subject_or_body_contains_any": lambda a: any_sql("sh", a),
    "body_or_display_contains_any": lambda a: any_sql("dh", a),
    "body_or_display_claims_institution": lambda a: "len(claims) > 0",
    "body_contains_all_of": lambda a: "(" + " AND ".join(any_sql("bl", g) for g in a) + ")",
    "body_contains_phone_number": lambda a: f"regexp_matches(body, '{_PHONE}')",
    "body_contains_sin_pattern": lambda a: f"regexp_matches(body, '{_SIN}')",
    "body_dollar_amount_in_range": lambda a: f"""len(list_filter(regexp_extract_all(body, '{_DOLLARS}', 1),
        lambda x: CAST(replace(x, ',', '') AS DOUBLE) BETWEEN {a[0]} AND {a[1]})) > 0""",
    "body_appears_ai_polished": lambda a: "FALSE",
    "link_present": lambda a: "len(links) > 0",
    "link_domain_not_in_whitelist": lambda a: "link_out",
    "link_domains_contain_any": lambda a: "len(list_filter(lhosts, lambda x: "
        + _or(_UNDER.format(h="x", d=sql_str(d)) for d in a) + ")) > 0",
    "link_url_is_ip_address": lambda a: "ip_link",
    "link_text_domain_differs_from_href_domain": lambda a: "differs",
    "link_text_in_whitelist": lambda a: "text_allow",
    "registrable_domain_not_in_whitelist": lambda a: "host_out",
    "subdomain_contains_institution_name": lambda a: "holds",
    "lookalike_of_high_value_whitelist": lambda a: "alike",
    "attachment_extension_in": lambda a: "regexp_matches(body, '(?i)\\S(" + "|".join(
        re.escape(x) for x in a) + ")([^a-z0-9]|$)')",
    "or_password_protected_archive": lambda a:
        "regexp_matches(body, '(?i)password[- ]?protected\\s+(zip|archive|rar|file)')",
    "email_body_contains_html_form": lambda a: "regexp_matches(body, '(?i)<form\\b')",
    "target_email_on_free_provider": lambda a: f"""len(list_filter(regexp_extract_all(body, '{_EMAILS}'),
        lambda x: lower(string_split(x, '@')[2]) IN ({', '.join(map(sql_str, fv.FREE_MAIL_HOSTS))})
            AND x IS DISTINCT FROM email)) > 0""",
    "spf_or_dkim_or_dmarc_failed": lambda a:
        "regexp_matches(coalesce(auth_results, ''), '(?i)(spf|dkim|dmarc)\\s*=\\s*fail')",
    "claimed_brand_in_whitelist": lambda a: f"(len(claims) > 0 OR {any_sql('dh', _ALLOW_DOMAINS)})",
}

ARGS = {
    "from_domain_in": ["gmail.com", "x.example"],
    "from_domain_contains_any": ["mail", "999"],
    "from_domain_starts_with": "thth",
    "from_domain_tld_in": [".id", ".org"],
    "from_domain_not_ends_with": [".com", ".id"],
    "from_domain_not_in_known_sender_domains_for": ["o1", "o2", "nobody"],
    "reply_to_domain_in": ["gmail.com"],
    "body_contains_any": ["gift card", "license", "der"],
    "body_contains_any_secondary": ["wire transfer", "token"],
    "subject_or_body_contains_any": ["your license", "hello"],
    "body_or_display_contains_any": ["token desk", "bank"],
    "body_contains_all_of": [["the", "der"], ["gift card", "report.scr"]],
    "body_dollar_amount_in_range": [199, 1250.5],
    "link_domains_contain_any": ["example.com"],
    "attachment_extension_in": [".exe", ".scr"],
}


def cond_sql(rule: Rule) -> str:
    parts = []
    match = dict(rule.match)
    match.pop(RU.COUNT_KEY, None)
    if RU.LOCKED_KEY in match:
        pair = [PREDICATE_SQL[k](match.pop(k)) for k in (RU.LOCKED_KEY, RU.EXT_KEY) if k in match]
        parts.append(_or(f"coalesce({x}, FALSE)" for x in pair))
    for k, a in match.items():
        parts.append(f"coalesce({PREDICATE_SQL[k](a)}, FALSE)" if k in PREDICATE_SQL else "FALSE")
    gate = "TRUE" if any(k in fv.STRUCTURAL_PREDICATES for k in rule.match) else "NOT verified"
    return " AND ".join([gate, *parts])


_PLAIN, _COUNTING = RU.split_rules(list(seeds.RULES))
_NEVER = "(" + "|".join(fv.NEVER_ENGLISH_PAIRS) + ")"


def letters_sql(x):
    return f"regexp_replace(lower(coalesce({x}, '')), '[^a-z]', '', 'g')"


def english_sql(s):
    return f"""CASE WHEN len({s}) < 4 THEN 1.0 ELSE len(list_filter(range(1, len({s})),
        lambda i: list_contains({sql_list(fv.COMMON_LETTER_PAIRS)}, substr({s}, i, 2)))) / (len({s}) - 1) END"""


def run_sql(s):
    return f"list_max(list_transform(string_split_regex({s}, '[aeiouy]'), lambda w: len(w)))"


def ratio_sql(s):
    return f"CASE WHEN len({s}) = 0 THEN 0.0 ELSE len(regexp_replace({s}, '[^aeiou]', '', 'g')) / len({s}) END"


def random_sql(s):
    return f"""(len({s}) >= 8 AND (regexp_matches({s}, '{_NEVER}') OR {run_sql(s)} >= 6 OR {ratio_sql(s)} = 0
        OR CAST({run_sql(s)} >= 5 AS INTEGER) + CAST({ratio_sql(s)} < 0.25 AS INTEGER)
         + CAST({english_sql(s)} < 0.30 AS INTEGER) + CAST(regexp_matches({s}, 'q[^u]') AS INTEGER) >= 2))"""


_LABELS = "list_filter(string_split(lower(coalesce({h}, '')), '.'), lambda x: x <> '')"


def gibberish_sql(h):
    lab = _LABELS.format(h=h)
    # labels are only letters, digits and hyphens here
    inner = random_sql("regexp_replace(x, '[^a-z]', '', 'g')")
    return f"""len(list_filter({lab}, lambda x, i: NOT (i = len({lab}) AND len(x) <= 3) AND {inner})) > 0"""


def local_sql(x):
    roles = _or(f"contains({letters_sql(x)}, '{w}')" for w in fv.ROLE_MAILBOX_WORDS)
    return f"(NOT {roles} AND {random_sql(letters_sql(x))})"


def digit_sql(h):
    lab = _LABELS.format(h=h)
    return f"""len(list_filter({lab}, lambda x, i: i < len({lab}) AND regexp_matches(x, '[a-z]')
        AND regexp_matches(x, '[0-9]') AND len(x) >= 5)) > 0"""


SIGNALS_SQL = [
    ("random_sender_domain", 30, gibberish_sql("domain")),
    ("random_sender_local_part", 25, local_sql("local")),
    ("deep_subdomain_chain_sender", 20, f"len({_LABELS.format(h='domain')}) >= 5"),
    ("abused_sender_tld", 25, _ends("domain", fv.ABUSED_SUFFIXES)),
    ("digit_mixed_sender_domain", 10, digit_sql("domain")),
]
VERDICT_SQL = f"""{PARTS_SQL},
r1 AS (SELECT *, list_filter([{', '.join(
    f"CASE WHEN {cond_sql(r)} THEN '{r.rule_id}' END" for r in _PLAIN)}], lambda x: x IS NOT NULL) AS f0,
    list_filter([{', '.join(f"CASE WHEN NOT verified AND domain IS NOT NULL AND {q} THEN '{n}' END"
                            for n, _, q in SIGNALS_SQL)}], lambda x: x IS NOT NULL) AS sig FROM m),
r2 AS (SELECT *, CASE WHEN {cond_sql(_COUNTING[0])} AND len(f0) >= {_COUNTING[0].match[RU.COUNT_KEY]}
    THEN list_append(f0, '{_COUNTING[0].rule_id}') ELSE f0 END AS f1 FROM r1),
r3 AS (SELECT *, CASE WHEN {cond_sql(_COUNTING[1])} AND len(f1) >= {_COUNTING[1].match[RU.COUNT_KEY]}
    THEN list_append(f1, '{_COUNTING[1].rule_id}') ELSE f1 END AS f2 FROM r2),
weights(id, weight, en, fr) AS ({sql_values(
    [(r.rule_id, r.weight, r.explanation or r.rule_id, r.explanation_fr or r.explanation or r.rule_id)
     for r in seeds.RULES] + [(n, w, n, n) for n, w, _ in SIGNALS_SQL])}),
fired AS (SELECT msg_id, UNNEST(range(1, len(list_concat(f2, sig)) + 1)) AS pos,
          UNNEST(list_concat(f2, sig)) AS id FROM r3),
tot AS (SELECT msg_id, least(100, sum(weight)) AS score, string_agg(id, ',' ORDER BY pos) AS ids,
               string_agg(fr, '|' ORDER BY pos) AS texts_fr, string_agg(en, '|' ORDER BY pos) AS texts_en
        FROM fired JOIN weights USING (id) GROUP BY msg_id),
v AS (SELECT r3.*, CAST(coalesce(score, 0) AS INTEGER) AS score, coalesce(ids, '') AS ids,
             coalesce(texts_fr, '') AS texts_fr, coalesce(texts_en, '') AS texts_en
      FROM r3 LEFT JOIN tot USING (msg_id))"""
_BAND = ("CASE WHEN score >= 80 THEN 'high' WHEN score >= 55 THEN 'medium' WHEN score >= 30 "
         "THEN 'low' ELSE 'safe' END")

# --- Spark side -------------------------------------------------------------------


def _parts(spark, sf):
    return M.with_message_parts(messages(spark, sf))


def _column(make):
    def run(spark, sf):
        return _parts(spark, sf).select("msg_id", *make())
    return run


def _text(c):
    return F.coalesce(c, F.lit(""))


def _pred(name):
    def run(spark, sf):
        df, ctx = with_predicate_inputs(
            messages(spark, sf), seeds.allow_list(spark), list(seeds.ORGS), CONFIG)
        return df.select("msg_id", RU.predicate(ctx, name, ARGS.get(name, True)).cast("int")
                         .alias("fired"))
    return run


def _scored(spark, sf, lang="en"):
    return score_messages(
        messages(spark, sf), seeds.allow_list(spark), list(seeds.ORGS), list(seeds.RULES),
        MessageConfig(auth_checks=True, lang=lang))


def p35(spark, sf):
    rules = [r for r in seeds.RULES if RU.COUNT_KEY not in r.match]
    rules.append(Rule("enough", 1, {RU.COUNT_KEY: 2}))
    df = score_messages(messages(spark, sf), seeds.allow_list(spark), list(seeds.ORGS), rules, CONFIG)
    return df.select("msg_id", F.exists("fired_rules", lambda r: r["id"] == "enough").cast("int").alias("fired"))


def m09(spark, sf):
    rules = [*_PLAIN, Rule("always", 1, {})]
    df, ctx = with_predicate_inputs(
        messages(spark, sf), seeds.allow_list(spark), list(seeds.ORGS), CONFIG)
    return df.select("msg_id", F.array_join(F.array_compact(F.array(*[
        F.when(RU.rule_condition(ctx, r), F.lit(r.rule_id)) for r in rules])), ",").alias("fired"))


def _m09_sql():
    rules = [*_PLAIN, Rule("always", 1, {})]

    def ungated(r):
        return cond_sql(r).replace("NOT verified", "TRUE", 1) if r.match else "TRUE"
    items = ", ".join(f"CASE WHEN {ungated(r)} THEN '{r.rule_id}' END" for r in rules)
    return f"""WITH {PARTS_SQL} SELECT msg_id, array_to_string(list_filter([{items}],
        lambda x: x IS NOT NULL), ',') AS fired FROM m"""


def m10(spark, sf):
    return _scored(spark, sf).select("msg_id", F.array_join(F.transform(F.filter(
        "fired_rules", lambda r: ~r["id"].isin([n for n, _, _ in SIGNALS_SQL])),
        lambda r: r["id"]), ",").alias("fired"))


def m12(spark, sf):
    return _scored(spark, sf).select("msg_id", F.array_join(F.transform(F.filter(
        "fired_rules", lambda r: r["id"].isin([n for n, _, _ in SIGNALS_SQL])),
        lambda r: r["id"]), ",").alias("signals"))


def m14(spark, sf):
    c = F.col("official_contact")
    return _scored(spark, sf).select(
        "msg_id", _text(c["name"]).alias("name"), _text(c["url"]).alias("url"),
        _text(c["phone"]).alias("phone"))


_CONTACT = {
    "name": [o.name or o.org_id for o in seeds.ORGS], "url": [o.contact_url for o in seeds.ORGS],
    "phone": [o.phone for o in seeds.ORGS],
}


def _contact_sql(f):
    cases = " ".join(f"WHEN claims[1] = '{o.org_id}' THEN {sql_str(v or '')}"
                     for o, v in zip(seeds.ORGS, _CONTACT[f]))
    return f"CASE {cases} ELSE '' END AS {f}"


def m15(spark, sf):
    return _scored(spark, sf, "fr").select("msg_id", F.array_join(F.transform(F.filter(
        "fired_rules", lambda r: ~r["id"].isin([n for n, _, _ in SIGNALS_SQL])),
        lambda r: r["explanation"]), "|").alias("texts"))


def m15_long(spark, sf):
    fired = _scored(spark, sf).select("msg_id", F.explode("fired_rules").alias("r")).select(
        "msg_id", F.col("r.id").alias("rule_id"))
    rules = local_frame(
        spark, [(r.rule_id, r.explanation, r.explanation_fr) for r in seeds.RULES],
        "rule_id string, user_explanation string, user_explanation_fr string")
    return localised(fired, rules, "fr").select("msg_id", "rule_id", "explanation")


def _words(spark, sf):
    return table(spark, sf, "documents").select(
        F.explode(F.split("text", r"[ \t\n\r\f]+")).alias("word")).distinct()


WORDS_SQL = "words AS (SELECT DISTINCT UNNEST(string_split_regex(text, '[ \\t\\n\\r\\f]+')) AS word FROM documents)"


def _word(make, name):
    def run(spark, sf):
        return _words(spark, sf).select("word", make(F.col("word")).alias(name))
    return run


def _word_sql(expr, name, cast):
    return (f"WITH {WORDS_SQL}, w AS (SELECT word, {letters_sql('word')} AS s FROM words) "
            f"SELECT word, CAST({expr} AS {cast}) AS {name} FROM w")


def _senders(spark, sf):
    return with_hosts(urls(spark, sf)).select("row_id", F.concat(
        F.element_at(F.array(F.lit(""), F.lit("bqzxkjvw.test999."), F.lit("qwrtplkj.")),
                     (F.col("row_id") % 3 + 1).cast("int")), "host",
        F.element_at(F.array(F.lit(""), F.lit(".biz.id")), (F.col("page_id") % 2 + 1).cast("int")),
    ).alias("h"))


SENDERS_SQL = f"""{URLS_SQL}, {host_ctes()}, senders AS (SELECT row_id, concat(
    ['', 'bqzxkjvw.test999.', 'qwrtplkj.'][row_id % 3 + 1], host, ['', '.biz.id'][page_id % 2 + 1]) AS h FROM hosted)"""


def r07(spark, sf):
    return _senders(spark, sf).select("row_id", R.has_gibberish_label(F.col("h")).cast("int").alias("gibberish"))


def r09(spark, sf):
    h = F.col("h")
    return _senders(spark, sf).select(
        "row_id", R.label_count(h).alias("labels"), R.has_abused_suffix(h).cast("int").alias("abused"),
        R.has_digit_mixed_label(h).cast("int").alias("digit_mixed"))


def _msql(columns: str) -> str:
    return f"WITH {PARTS_SQL} SELECT msg_id, {columns} FROM m"


CHECKS = {
    "m01_from_header": (
        lambda spark, sf: messages(spark, sf).select(
            "msg_id", M.trim_space(M.sender_text(F.col("from_hdr"), F.col("body"))).alias("from_text")),
        _msql("ft AS from_text")),
    "m02_sender_parse": (
        _column(lambda: [F.col("sender.display_name").alias("display_name"), *[
            _text(F.col(f"sender.{c}")).alias(c) for c in ("email", "domain", "local")]]),
        _msql("display AS display_name, coalesce(email, '') AS email, "
                    "coalesce(domain, '') AS domain, coalesce(local, '') AS local")),
    "m03_links": (
        _column(lambda: [F.array_join("links", " ").alias("links"),
                         F.array_join(F.array_sort("link_hosts"), " ").alias("link_hosts")]),
        _msql("array_to_string(links, ' ') AS links, "
                    "array_to_string(list_sort(lhosts), ' ') AS link_hosts")),
    "m04_phone_numbers": (
        _column(lambda: [F.array_join(M.extract_phones(F.col("body")), "|").alias("phones")]),
        _msql(f"array_to_string(regexp_extract_all(body, '{_PHONE}'), '|') AS phones")),
    "m05_anchors": (
        lambda spark, sf: messages(spark, sf).select("msg_id", F.array_join(F.transform(
            M.extract_anchors(F.col("body")), lambda a: F.concat(a["href"], F.lit(">"), a["text"])), "|")
            .alias("anchors")),
        _msql("array_to_string(list_transform(range(1, len(hrefs) + 1), "
                    "lambda i: concat(hrefs[i], '>', trim(texts[i]))), '|') AS anchors")),
    "m06_candidate_hosts": (
        _column(lambda: [F.array_join(F.array_sort("all_hosts"), " ").alias("hosts")]),
        _msql("array_to_string(list_sort(list_concat(lhosts, CASE WHEN domain IS NULL "
                    "THEN [] ELSE [domain] END)), ' ') AS hosts")),
    "m07_body_addresses": (
        _column(lambda: [F.array_join(M.extract_emails(F.col("body")), " ").alias("emails")]),
        _msql(f"array_to_string(regexp_extract_all(body, '{_EMAILS}'), ' ') AS emails")),
    "m08_dollar_amounts": (
        _column(lambda: [
            F.size(M.extract_amounts(F.col("body"))).alias("n"),
            F.aggregate(M.extract_amounts(F.col("body")), F.lit(0.0), lambda a, x: a + x).alias("total")]),
        _msql(f"CAST(len(regexp_extract_all(body, '{_DOLLARS}', 1)) AS INTEGER) AS n, "
                    f"coalesce(list_sum(list_transform(regexp_extract_all(body, '{_DOLLARS}', 1), "
                    "lambda x: CAST(replace(x, ',', '') AS DOUBLE))), 0.0) AS total")),
    "m09_rule_compiler": (m09, _m09_sql()),
    "m10_dependent_rules": (m10, f"WITH {VERDICT_SQL} SELECT msg_id, array_to_string(f2, ',') AS fired FROM v"),
    "m11_verified_sender": (
        lambda spark, sf: _scored(spark, sf).select(
            "msg_id", F.col("sender_verified").cast("int").alias("verified")),
        _msql("CAST(verified AS INTEGER) AS verified")),
    "m12_sender_reputation": (m12, f"WITH {VERDICT_SQL} SELECT msg_id, array_to_string(sig, ',') AS signals FROM v"),
    "m13_message_score": (
        lambda spark, sf: _scored(spark, sf).select("msg_id", "score", "verdict"),
        f"WITH {VERDICT_SQL} SELECT msg_id, score, {_BAND} AS verdict FROM v"),
    "m14_official_contact": (m14, _msql(", ".join(map(_contact_sql, _CONTACT)))),
    "m15_localised_explanation": (m15, f"""WITH {VERDICT_SQL}, fx AS (
        SELECT msg_id, pos, fr FROM fired JOIN weights USING (id) WHERE id NOT IN
        ({', '.join(sql_str(n) for n, _, _ in SIGNALS_SQL)}))
        SELECT msg_id, coalesce(string_agg(fr, '|' ORDER BY pos), '') AS texts
        FROM v LEFT JOIN fx USING (msg_id) GROUP BY msg_id"""),
    "m15_explanation_join": (m15_long, f"""WITH {VERDICT_SQL}
        SELECT msg_id, id AS rule_id, fr AS explanation FROM fired JOIN weights USING (id)"""),
    **{
        f"p{i:02d}_{name}": (_pred(name), _msql(
            f"CAST(coalesce({PREDICATE_SQL[name](ARGS.get(name, True))}, FALSE) AS INTEGER) AS fired"))
        for i, name in enumerate(PREDICATE_SQL, 1)
    },
    "p35_other_rules_triggered_count_gte": (p35, f"""WITH {VERDICT_SQL}
        SELECT msg_id, CAST(NOT verified AND len(f0) >= 2 AS INTEGER) AS fired FROM v"""),
    "r01_letters_only": (_word(R.letters_only, "letters"), _word_sql("s", "letters", "VARCHAR")),
    "r02_english_score": (
        _word(lambda c: F.round(R.english_score(c), 6), "score"),
        _word_sql(f"round({english_sql('s')}, 6)", "score", "DOUBLE")),
    "r03_consonant_run": (_word(R.consonant_run, "longest"), _word_sql(run_sql("s"), "longest", "INTEGER")),
    "r04_vowel_ratio": (
        _word(lambda c: F.round(R.vowel_ratio(c), 6), "ratio"),
        _word_sql(f"round({ratio_sql('s')}, 6)", "ratio", "DOUBLE")),
    "r05_rare_pairs": (
        _word(lambda c: R.has_never_english_pair(c).cast("int") * 2 + R.has_q_without_u(c).cast("int"), "signs"),
        _word_sql(f"CAST(regexp_matches(s, '{_NEVER}') AS INTEGER) * 2 + "
                  "CAST(regexp_matches(s, 'q[^u]') AS INTEGER)", "signs", "INTEGER")),
    "r06_looks_random": (
        _word(lambda c: R.looks_random(c).cast("int"), "random"), _word_sql(random_sql("s"), "random", "INTEGER")),
    "r07_gibberish_host": (r07, f"WITH {SENDERS_SQL} SELECT row_id, "
                                f"CAST({gibberish_sql('h')} AS INTEGER) AS gibberish FROM senders"),
    "r08_random_local_part": (
        _word(lambda c: R.is_random_local_part(c).cast("int"), "random"),
        _word_sql(local_sql("word"), "random", "INTEGER")),
    "r09_host_shape": (r09, f"""WITH {SENDERS_SQL} SELECT row_id,
        CAST(len({_LABELS.format(h='h')}) AS INTEGER) AS labels,
        CAST({_ends('lower(h)', fv.ABUSED_SUFFIXES)} AS INTEGER) AS abused,
        CAST({digit_sql('h')} AS INTEGER) AS digit_mixed FROM senders"""),
}

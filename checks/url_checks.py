"""URL layer: U1-U17."""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from checks import seeds
from checks.inputs import PAGE_URLS_SQL, URLS_SQL, page_urls, table, urls
from checks.punycode_sql import ascii_label
from checks.seeds import sql_values
from phishlake import fixed_values as fv
from phishlake.functions import hosts as H
from phishlake.operators.lookalike import lookalike_pairs
from phishlake.operators.lookups import ListTable, local_frame, longest_suffix_join
from phishlake.operators.reports import verdict_counts
from phishlake.plans.url_job import HOST_KEYS, host_facts, score_urls
from phishlake.sources.lists import clean_user_lists

_WIDE = "".join(chr(c) for c in range(fv.FULLWIDTH_FIRST, fv.FULLWIDTH_LAST + 1))
_NARROW = "".join(chr(ord(c) - fv.FULLWIDTH_SHIFT) for c in _WIDE).replace("'", "''")
_FOLD_FROM = _WIDE + "".join(fv.LOOKALIKE_LETTERS)
_FOLD_TO = _NARROW + "".join(fv.LOOKALIKE_LETTERS.values())


ASCII_LABEL = ascii_label("x")


def fold_sql(x: str) -> str:
    return f"translate(lower({x}), '{_FOLD_FROM}', '{_FOLD_TO}')"


def host_ctes(source: str = "urls", schemes: str = "https?", name: str = "hosted") -> str:
    """hosted: source rows plus is_web, raw_host, canon, host, idna_failed, path."""
    text = rf"""h1 AS (
    SELECT *, coalesce(regexp_matches(url, '(?i)^https?://'), FALSE) AS is_web,
        coalesce(regexp_replace(lower(regexp_extract(url, '(?i)^https?://([^/?#:@\[\]]+)', 1)),
            '^www[.]', ''), '') AS raw_host,
        regexp_replace(url, '[\t\n\r]|^[\x00-\x20]+|[\x00-\x20]+$', '', 'g') AS cut
    FROM {source}),
h2 AS (
    SELECT *, regexp_extract(cut, '(?i)^(?:{schemes}):[/\\]*(?:[^/\\?#]*@)?([^/\\?#@]*)', 1) AS hp,
        regexp_extract(cut, '(?i)^https?:[/\\]*[^/\\?#]*([^?#]*)', 1) AS tail
    FROM h1),
h3 AS (
    SELECT *, lower(translate(url_decode(regexp_extract(hp, '^(\[[^\]]*\]|[^:]*)', 1)),
            '{_WIDE}', '{_NARROW}')) AS name,
        regexp_extract(hp, '^(?:\[[^\]]*\]|[^:]*):?(.*)$', 1) AS port
    FROM h2),
h4 AS (
    SELECT *, string_split(regexp_replace(name, '[.]$', ''), '.') AS parts,
        regexp_matches(name, '(?:^|[.])(?:[0-9]+|0x[0-9a-f]*)[.]?$') AS numeric
    FROM h3),
h5 AS (
    SELECT *, CASE WHEN numeric THEN list_transform(parts, lambda x: CASE
        WHEN regexp_matches(x, '^0x[0-9a-f]*$') THEN list_reduce(list_prepend(CAST(0 AS BIGINT),
            list_transform(range(3, len(x) + 1), lambda i: CAST(
                strpos('0123456789abcdef', substr(x, i, 1)) - 1 AS BIGINT))), lambda a, d: a * 16 + d)
        WHEN regexp_matches(x, '^0[0-7]*$') THEN list_reduce(list_prepend(CAST(0 AS BIGINT),
            list_transform(range(1, len(x) + 1), lambda i: CAST(substr(x, i, 1) AS BIGINT))),
            lambda a, d: a * 8 + d)
        WHEN regexp_matches(x, '^[1-9][0-9]*$') THEN CAST(x AS BIGINT) END) END AS nums
    FROM h4),
h6 AS (
    SELECT *, len(nums) AS k, CASE WHEN numeric AND len(nums) <= 4
        AND len(list_filter(nums, lambda v: v IS NULL)) = 0
        AND len(list_filter(nums[1:len(nums) - 1], lambda v: v > 255)) = 0
        AND nums[-1] < power(256, 5 - len(nums))
        THEN nums[-1] + CASE WHEN len(nums) > 1 THEN nums[1] * 16777216 ELSE 0 END
            + CASE WHEN len(nums) > 2 THEN nums[2] * 65536 ELSE 0 END
            + CASE WHEN len(nums) > 3 THEN nums[3] * 256 ELSE 0 END END AS ip
    FROM h5),
h7 AS (
    SELECT *, CASE
        WHEN name = '' OR NOT regexp_matches(port, '^[0-9]*$')
            OR coalesce(TRY_CAST(port AS BIGINT), 0) > 65535 THEN NULL
        WHEN name[1] = '[' THEN CASE WHEN regexp_matches(name, '^\[[0-9a-f:.]+\]$') THEN name END
        WHEN regexp_matches(name, '[\x00-\x20#/:<>?@\[\\\]^|%\x7F]') THEN NULL
        WHEN numeric THEN CASE WHEN ip IS NOT NULL THEN concat((ip // 16777216) % 256, '.',
            (ip // 65536) % 256, '.', (ip // 256) % 256, '.', ip % 256) END
        WHEN regexp_matches(name, '[^\x00-\x7F]') THEN array_to_string(list_transform(
            string_split(name, '.'), lambda x: CASE WHEN regexp_matches(x, '[^\x00-\x7F]')
                THEN {ASCII_LABEL} ELSE x END), '.')
        ELSE name END AS canon
    FROM h6),
hosted AS (
    SELECT * EXCLUDE (cut, hp, tail, name, port, parts, numeric, nums, k, ip),
        canon IS NULL AS idna_failed,
        coalesce(regexp_replace(canon, '^www[.]', ''), raw_host) AS host,
        CASE WHEN canon IS NULL THEN '' WHEN tail = '' THEN '/'
             ELSE replace(tail, chr(92), '/') END AS path
    FROM h7)"""
    if name != "hosted":
        text = re.sub(r"\bh([1-7])\b", rf"{name}\1", text).replace("hosted AS", f"{name} AS")
    return text


ALLOW_SQL = "allow(domain, name, official_url, high_value, ord) AS (" + sql_values(seeds.ALLOW) + ")"
BLOCK_SQL = "block(domain) AS (" + sql_values([(d,) for d in seeds.BLOCK]) + ")"


def _endings(x: str, suffixes) -> str:
    return "(" + " OR ".join(f"ends_with({x}, '{s}')" for s in suffixes) + ")"


_C = seeds.URL_CONFIG
_GOV = ("(" + " OR ".join(f"contains(lower(concat(host, path)), '{k}')" for k in _C.gov_keywords)
        + f") AND NOT {_endings('host', _C.gov_suffixes)}")
_RISKY = _endings("host", _C.risky_tlds)
_HYPHENS = """len(regexp_replace(CASE WHEN len(string_split(host, '.')) <= 2
    THEN string_split(host, '.')[1]
    ELSE array_to_string(string_split(host, '.')[1:-3], '.') END, '[^-]', '', 'g'))"""
_IP = "regexp_matches(host, '^[0-9]{1,3}([.][0-9]{1,3}){3}$')"
_UNDER = "({h} = {d} OR ends_with({h}, concat('.', {d})))"


def verdict_ctes(source_cte: str, source: str = "urls") -> str:
    """scored: every source row with verdict, score, reasons, official_url, institution_name."""
    return f"""{source_cte}, {ALLOW_SQL}, {BLOCK_SQL}, {host_ctes(source)},
hs AS (SELECT DISTINCT host, raw_host FROM hosted WHERE is_web AND host <> ''),
al AS (
    SELECT host, raw_host, arg_max(struct_pack(d := domain, u := official_url, n := name),
        len(domain)) AS a
    FROM hs JOIN allow ON {_UNDER.format(h='host', d='domain')} GROUP BY ALL),
bl AS (SELECT DISTINCT host, raw_host FROM hs JOIN block
       ON {_UNDER.format(h='host', d='domain')}),
lk AS (
    SELECT host, raw_host, arg_min(struct_pack(d := domain, u := official_url, n := name), ord) AS l
    FROM hs JOIN allow ON high_value AND raw_host <> domain
        AND levenshtein({fold_sql('raw_host')}, {fold_sql('domain')}) <= 2 GROUP BY ALL),
sp AS (SELECT DISTINCT host, raw_host FROM hs JOIN allow
       ON contains(concat('.', host), concat('.', domain, '.')) AND NOT ends_with(host, domain)),
flagged AS (
    SELECT s.*, a, l, bl.host IS NOT NULL AS blocked, sp.host IS NOT NULL AS spoof,
        {_GOV} AS gov, {_RISKY} AS risky, {_HYPHENS} >= 3 AS many, {_IP} AS ip,
        contains(host, 'xn--') AS enc
    FROM hosted s LEFT JOIN al USING (host, raw_host) LEFT JOIN bl USING (host, raw_host)
        LEFT JOIN lk USING (host, raw_host) LEFT JOIN sp USING (host, raw_host)),
summed AS (
    SELECT *, CASE WHEN NOT is_web OR host = '' THEN 0 WHEN a IS NOT NULL THEN 0
        WHEN blocked THEN 100 ELSE least(100,
            CASE WHEN l IS NOT NULL THEN 60 ELSE 0 END + CASE WHEN gov THEN 50 ELSE 0 END
            + CASE WHEN risky THEN 30 ELSE 0 END + CASE WHEN many THEN 20 ELSE 0 END
            + CASE WHEN ip THEN 40 ELSE 0 END + CASE WHEN enc OR idna_failed THEN 40 ELSE 0 END
            + CASE WHEN spoof THEN 45 ELSE 0 END) END AS score
    FROM flagged),
scored AS (
    SELECT *, CASE WHEN score >= 80 THEN 'high' WHEN score >= 55 THEN 'medium'
        WHEN score >= 30 THEN 'low' ELSE 'safe' END AS verdict,
        CASE WHEN NOT is_web OR host = '' THEN CAST([] AS VARCHAR[])
            WHEN a IS NOT NULL THEN ['allow_listed'] WHEN blocked THEN ['known_bad']
            ELSE list_filter([CASE WHEN l IS NOT NULL THEN 'lookalike_domain' END,
                CASE WHEN gov THEN 'fake_government' END, CASE WHEN risky THEN 'risky_tld' END,
                CASE WHEN many THEN 'many_hyphens' END, CASE WHEN ip THEN 'ip_host' END,
                CASE WHEN enc THEN 'encoded_host' END,
                CASE WHEN idna_failed AND NOT enc THEN 'broken_host' END,
                CASE WHEN spoof THEN 'subdomain_spoof' END], lambda x: x IS NOT NULL) END AS reasons,
        CASE WHEN NOT is_web OR host = '' OR (blocked AND a IS NULL) THEN '' ELSE coalesce(a.u, l.u, '') END AS official_url,
        CASE WHEN NOT is_web OR host = '' OR (blocked AND a IS NULL) THEN '' ELSE coalesce(a.n, l.n, '') END AS institution_name
    FROM summed)"""


def _hosted(spark, sf):
    return H.with_hosts(urls(spark, sf))


def _flag(make, name):
    def run(spark, sf):
        return _hosted(spark, sf).select("row_id", make().alias(name))
    return run


def _flag_sql(expr, name, cast="INTEGER"):
    return f"WITH {URLS_SQL}, {host_ctes()} SELECT row_id, CAST({expr} AS {cast}) AS {name} FROM hosted"


def u01(spark, sf):
    return _hosted(spark, sf).select(
        "row_id", F.col("is_web").cast("int").alias("is_web"), "raw_host", "host", "path")


def u02(spark, sf):
    df = H.with_canonical_host(urls(spark, sf), "url", "canon")
    return df.select("row_id", F.coalesce("canon", F.lit("")).alias("canon"),
                     F.col("canon").isNull().cast("int").alias("failed"))


def u03(spark, sf):
    return _hosted(spark, sf).select("row_id", F.array_join(
        H.suffix_candidates(F.col("host")), "|").alias("candidates"))


def _suffix(which):
    def run(spark, sf):
        df = _hosted(spark, sf).filter("is_web")
        if which == "allow":
            out = longest_suffix_join(df, "host", seeds.allow_list(spark), "m",
                                      ["official_url", "name"])
            return out.select("row_id", F.coalesce("m.domain", F.lit("")).alias("domain"),
                              F.coalesce("m.official_url", F.lit("")).alias("official_url"),
                              F.coalesce("m.name", F.lit("")).alias("name"))
        out = longest_suffix_join(df, "host", seeds.block_list(spark), "m")
        return out.select("row_id", F.coalesce("m.domain", F.lit("")).alias("domain"))
    return run


def u06(spark, sf):
    hosts = _hosted(spark, sf).select("raw_host").distinct()
    return (
        lookalike_pairs(hosts, "raw_host", seeds.allow_list(spark))
        .groupBy("raw_host").agg(F.min("ord").alias("target_ord"), F.count(F.lit(1)).alias("n_targets"))
    )


def u13(spark, sf):
    hosts = _hosted(spark, sf).filter("is_web").select(*HOST_KEYS).distinct()
    return host_facts(hosts, seeds.allow_list(spark), seeds.block_list(spark), _C).select(
        "host", "raw_host", F.col("spoof").cast("int").alias("spoof"))


def _score(spark, sf, source=urls):
    return score_urls(source(spark, sf), seeds.allow_list(spark), seeds.block_list(spark), _C)


def u14(spark, sf):
    return _score(spark, sf).select("row_id", "score", "verdict")


def u15(spark, sf):
    return _score(spark, sf).select(
        "row_id", F.array_join("reasons", ",").alias("reasons"),
        F.coalesce("official_url", F.lit("")).alias("official_url"),
        F.coalesce("institution_name", F.lit("")).alias("institution_name"))


def flagship(spark, sf):
    """Verdict counts of all page URLs."""
    return verdict_counts(_score(spark, sf, page_urls))


def u16(spark, sf):
    raw = local_frame(spark, list(seeds.USER_LISTS), "tenant string, kind string, entry string")
    lists = ListTable(clean_user_lists(raw))
    rows = page_urls(spark, sf).withColumn("tenant", F.concat(F.lit("t"), (F.col("page_id") % 4).cast("string")))
    df = score_urls(rows, seeds.allow_list(spark), seeds.block_list(spark), _C, user_lists=lists)
    return df.select("row_id", "tenant", "score", "verdict", F.array_join("reasons", ",").alias("reasons"))


def u17(spark, sf):
    raw = urls(spark, sf).select(
        F.concat(F.lit("t"), (F.col("page_id") % 3).cast("string")).alias("tenant"),
        F.when(F.col("page_id") % 2 == 0, "allow").otherwise("block").alias("kind"),
        F.concat(F.lit(" "), "url").alias("entry"))
    return clean_user_lists(raw)


_ENTRY = ("regexp_extract(regexp_replace(regexp_replace(lower(trim({x})), '^https?://', ''),"
          " '^www[.]', ''), '^([^/?#]*)', 1)")
_USER_SQL = ("ul AS (SELECT DISTINCT tenant, kind, domain FROM (SELECT tenant, kind, "
             + _ENTRY.format(x="entry") + " AS domain FROM (" + sql_values(seeds.USER_LISTS)
             + ") AS t(tenant, kind, entry)) WHERE regexp_matches(domain, '^[a-zA-Z0-9.-]+\\.[a-zA-Z]{2,}$'))")


_WORD = "regexp_extract(text, '[a-z]*[à-öø-ÿ][a-zà-öø-ÿ]*', 0)"


def u02_scripts(spark, sf):
    """Hosts named after words of the documents, most with other letters."""
    named = table(spark, sf, "documents").select("doc_id", F.concat(
        F.lit("https://"), F.expr(_WORD), F.lit(".x"), F.col("doc_id") % 7, F.lit(".example/")).alias("url"))
    df = H.with_canonical_host(named, "url", "canon")
    return df.select("doc_id", F.coalesce("canon", F.lit("-")).alias("canon"))


U02_SCRIPTS_SQL = f"""WITH w AS (SELECT doc_id, {_WORD} AS x FROM documents)
SELECT doc_id, concat(CASE WHEN x = '' THEN '' ELSE {ASCII_LABEL} END, '.x', doc_id % 7, '.example') AS canon FROM w"""

CHECKS = {
    "u02_other_scripts": (u02_scripts, U02_SCRIPTS_SQL),
    "u01_host_extraction": (u01, f"""WITH {URLS_SQL}, {host_ctes()}
        SELECT row_id, CAST(is_web AS INTEGER) AS is_web, raw_host, host, path FROM hosted"""),
    "u02_canonical_host": (u02, f"""WITH {URLS_SQL}, {host_ctes()}
        SELECT row_id, coalesce(canon, '') AS canon, CAST(canon IS NULL AS INTEGER) AS failed FROM hosted"""),
    "u03_suffix_candidates": (u03, f"""WITH {URLS_SQL}, {host_ctes()}
        SELECT row_id, array_to_string(list_transform(range(1, len(string_split(host, '.')) + 1),
            lambda i: array_to_string(string_split(host, '.')[i:], '.')), '|') AS candidates FROM hosted"""),
    "u04_allow_suffix_join": (_suffix("allow"), f"""WITH {URLS_SQL}, {ALLOW_SQL}, {host_ctes()},
        m AS (SELECT row_id, arg_max(struct_pack(d := domain, u := official_url, n := name), len(domain)) AS a
              FROM hosted JOIN allow ON {_UNDER.format(h='host', d='domain')} GROUP BY row_id)
        SELECT row_id, coalesce(a.d, '') AS domain, coalesce(a.u, '') AS official_url, coalesce(a.n, '') AS name
        FROM hosted LEFT JOIN m USING (row_id) WHERE is_web"""),
    "u05_block_suffix_join": (_suffix("block"), f"""WITH {URLS_SQL}, {BLOCK_SQL}, {host_ctes()},
        m AS (SELECT row_id, arg_max(domain, len(domain)) AS d
              FROM hosted JOIN block ON {_UNDER.format(h='host', d='domain')} GROUP BY row_id)
        SELECT row_id, coalesce(d, '') AS domain FROM hosted LEFT JOIN m USING (row_id) WHERE is_web"""),
    "u06_fuzzy_lookalike_join": (u06, f"""WITH {URLS_SQL}, {ALLOW_SQL}, {host_ctes()},
        hs AS (SELECT DISTINCT raw_host FROM hosted)
        SELECT raw_host, CAST(min(ord) AS INTEGER) AS target_ord, count(*) AS n_targets FROM hs JOIN allow
        ON high_value AND raw_host <> domain AND levenshtein({fold_sql('raw_host')}, {fold_sql('domain')}) <= 2
        GROUP BY raw_host"""),
    "u07_homoglyph_fold": (
        _flag(lambda: H.fold_lookalikes(F.col("raw_host")), "folded"),
        _flag_sql(fold_sql("raw_host"), "folded", "VARCHAR")),
    "u08_fake_government": (
        _flag(lambda: H.has_fake_gov(F.col("host"), F.col("path"), _C.gov_keywords, _C.gov_suffixes)
              .cast("int"), "fake_gov"), _flag_sql(_GOV, "fake_gov")),
    "u09_risky_tld": (
        _flag(lambda: H.has_risky_tld(F.col("host"), _C.risky_tlds).cast("int"), "risky_tld"),
        _flag_sql(_RISKY, "risky_tld")),
    "u10_hyphen_count": (
        _flag(lambda: H.hyphen_count(F.col("host")), "hyphens"), _flag_sql(_HYPHENS, "hyphens")),
    "u11_ip_host": (_flag(lambda: H.is_ip_host(F.col("host")).cast("int"), "ip_host"),
                    _flag_sql(_IP, "ip_host")),
    "u12_encoded_or_broken_host": (
        _flag(lambda: F.when(F.col("host").contains("xn--"), "encoded").when(
            F.col("idna_failed"), "broken").otherwise("plain"), "form"),
        _flag_sql("CASE WHEN contains(host, 'xn--') THEN 'encoded' WHEN idna_failed THEN 'broken' "
                  "ELSE 'plain' END", "form", "VARCHAR")),
    "u13_subdomain_spoof": (u13, f"""WITH {verdict_ctes(URLS_SQL)}
        SELECT DISTINCT host, raw_host, CAST(spoof AND a IS NULL AND NOT blocked AS INTEGER) AS spoof
        FROM scored WHERE is_web"""),
    "u14_url_score": (u14, f"""WITH {verdict_ctes(URLS_SQL)}
        SELECT row_id, CAST(score AS INTEGER) AS score, verdict FROM scored"""),
    "u15_url_reasons": (u15, f"""WITH {verdict_ctes(URLS_SQL)}
        SELECT row_id, array_to_string(reasons, ',') AS reasons, official_url, institution_name FROM scored"""),
    "u16_user_lists_first": (u16, f"""WITH {verdict_ctes(PAGE_URLS_SQL)}, {_USER_SQL},
        t AS (SELECT *, concat('t', page_id % 4) AS tenant FROM scored),
        f AS (SELECT row_id, bool_or(kind = 'allow') AS ua, bool_or(kind = 'block') AS ub
              FROM t JOIN ul ON t.tenant = ul.tenant AND {_UNDER.format(h='host', d='domain')} GROUP BY row_id)
        SELECT row_id, tenant,
            CAST(CASE WHEN ua THEN 0 WHEN ub THEN 100 ELSE score END AS INTEGER) AS score,
            CASE WHEN ua THEN 'safe' WHEN ub THEN 'high' ELSE verdict END AS verdict,
            CASE WHEN ua THEN 'user_allowed' WHEN ub THEN 'user_blocked'
                 ELSE array_to_string(reasons, ',') END AS reasons
        FROM t LEFT JOIN f USING (row_id)"""),
    "u17_user_list_entries": (u17, f"""WITH {URLS_SQL}
        SELECT DISTINCT concat('t', page_id % 3) AS tenant,
            CASE WHEN page_id % 2 = 0 THEN 'allow' ELSE 'block' END AS kind,
            {_ENTRY.format(x="concat(' ', url)")} AS domain FROM urls
        WHERE regexp_matches({_ENTRY.format(x="concat(' ', url)")}, '^[a-zA-Z0-9.-]+\\.[a-zA-Z]{{2,}}$')"""),
}

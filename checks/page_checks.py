"""Page layer and combination: S5, C1-C9, B1-B7, E1-E5."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks import seeds
from checks.inputs import FEATURES_SQL, NAV_SQL, nav, pages_with_forms, table
from checks.message_checks import term_sql
from checks.seeds import sql_list, sql_str
from checks.url_checks import _C, verdict_ctes
from phishlake import fixed_values as fv
from phishlake.functions import bands
from phishlake.functions.hosts import strip_www, with_hosts
from phishlake.functions.text import matched_terms
from phishlake.operators.asof import asof_ttl_join
from phishlake.operators.term_join import term_hits
from phishlake.plans import combine as CB
from phishlake.plans.events import page_events
from phishlake.plans import enrich as E
from phishlake.plans.page_job import (
    PageConfig, category_hits, category_score, category_terms, haystack, score_pages,
)
from phishlake.plans.url_job import score_urls
from phishlake.operators.lookups import local_frame
from phishlake.sources.html_features import extract_page_features
from phishlake.sources.workdir import materialised

CONFIG = PageConfig(credential_category="forms")
_PLAIN = [c for c in seeds.CATEGORIES if not c.structural]
_FORMS = next(c for c in seeds.CATEGORIES if c.structural)

BAND_SQL = ("CASE WHEN {s} >= 80 THEN 'high' WHEN {s} >= 55 THEN 'medium' WHEN {s} >= 30 "
            "THEN 'low' ELSE 'safe' END")
RANK_SQL = "CASE {v} WHEN 'high' THEN 3 WHEN 'medium' THEN 2 WHEN 'low' THEN 1 ELSE 0 END"


def features(spark, sf):
    return extract_page_features(pages_with_forms(spark, sf))


def field_text(fields):
    return F.array_join(F.transform(fields, lambda f: F.concat_ws(
        "|", f["name"], f["id"], f["placeholder"], f["type"], f["autocomplete"], f["label_text"])), ";")


def s05(spark, sf):
    return features(spark, sf).select(
        "page_id", F.col("is_https").cast("int").alias("is_https"), "title", "meta_description",
        F.length("text").cast("bigint").alias("n_chars"), F.md5("text").alias("text_md5"),
        F.size("fields").alias("n_fields"), field_text(F.col("fields")).alias("field_text"))


_N_FIELDS = "[0, 1, 1, 0, 2, 1, 2][form + 1]"

# --- terms over documents (whole texts) -------------------------------------------


def _docs(spark, sf):
    return table(spark, sf, "documents").select("doc_id", F.lower("text").alias("hay"))


def _hits_sql(hay, cat):
    return " + ".join(f"CAST({term_sql(hay, t)} AS INTEGER)" for t in category_terms(cat)) or "0"


def _score_sql(hay, cat):
    total = f"({_hits_sql(hay, cat)}) * {cat.weight or 0}"
    return f"least({total}, {cat.cap})" if cat.cap is not None else total


_ALL_TERMS = [t for c in _PLAIN for t in category_terms(c)]


def c02(spark, sf):
    return _docs(spark, sf).select("doc_id", F.array_join(
        matched_terms(F.col("hay"), _ALL_TERMS), ",").alias("terms"))


def c02_join(spark, sf):
    terms = local_frame(spark, [(c.name, t) for c in _PLAIN for t in category_terms(c)],
                        "group string, term string")
    hits = term_hits(table(spark, sf, "documents").select("doc_id", "text"), "doc_id", "text", terms)
    return hits.select("doc_id", F.col("group").alias("category"), "term")


def c03(spark, sf):
    df = _docs(spark, sf)
    return df.select("doc_id", *[
        category_score(category_hits(F.col("hay"), c), c).cast("int").alias(c.name) for c in _PLAIN])


def c01(spark, sf):
    return features(spark, sf).select("page_id", F.md5(haystack()).alias("haystack_md5"))


def _scored(spark, sf):
    return score_pages(features(spark, sf), list(seeds.CATEGORIES), CONFIG)


def c04(spark, sf):
    return _scored(spark, sf).select("page_id", F.array_join("categories_hit", ",").alias("categories"))


def _flag(code, name):
    def run(spark, sf):
        return _scored(spark, sf).select(
            "page_id", F.array_contains("content_reasons", code).cast("int").alias(name))
    return run


def c08(spark, sf):
    """Without a credential category: default weight, no term lists."""
    df = score_pages(features(spark, sf), _PLAIN, CONFIG)
    return df.select("page_id", "content_score")


def c09(spark, sf):
    return _scored(spark, sf).select("page_id", "content_score", "content_verdict",
                                     F.array_join("content_reasons", ",").alias("reasons"))


_HAY = "lower(concat(title, chr(10), meta_description, chr(10), text))"
PAGE_SQL = f"""{FEATURES_SQL},
fx AS (SELECT *, {_HAY} AS hay, regexp_extract(url, '^https?://([^/]+)', 1) AS page_host FROM features),
fy AS (SELECT *, {', '.join(f"{_score_sql('hay', c)} AS s_{c.name}, {_hits_sql('hay', c)} AS n_{c.name}" for c in _PLAIN)},
    form = 1 AND NOT ends_with(page_host, '.example.net') AS sin,
    form = 4 AND NOT is_https AS pwd, form IN (2, 6) AS cvv FROM fx),
pv AS (SELECT *, least(100, {' + '.join(f's_{c.name}' for c in _PLAIN)}
    + CASE WHEN sin THEN 25 ELSE 0 END + CASE WHEN pwd THEN 25 ELSE 0 END
    + CASE WHEN cvv THEN 25 ELSE 0 END) AS content_score,
    list_filter([{', '.join(f"CASE WHEN n_{c.name} > 0 THEN 'terms:{c.name}' END" for c in _PLAIN)},
        CASE WHEN sin THEN 'national_id_field' END, CASE WHEN pwd THEN 'password_over_http' END,
        CASE WHEN cvv THEN 'card_code_field' END], lambda x: x IS NOT NULL) AS content_reasons,
    list_filter([{', '.join(f"CASE WHEN n_{c.name} > 0 THEN '{c.name}' END" for c in _PLAIN)},
        CASE WHEN sin OR pwd OR cvv THEN 'forms' END], lambda x: x IS NOT NULL) AS categories FROM fy)"""

# --- combination ---------------------------------------------------------------------
SENS = ["balanced", "strict", "permissive"]


def _sens(key):
    return F.element_at(F.array(*map(F.lit, SENS)), (F.col(key) % 3 + 1).cast("int"))


def _sens_sql(key):
    return f"{sql_list(SENS)}[{key} % 3 + 1]"


def _url_verdicts(spark, sf):
    rows = table(spark, sf, "pages").select("page_id", "url")
    return score_urls(rows, seeds.allow_list(spark), seeds.block_list(spark), _C)


URL_SQL = verdict_ctes("urls AS (SELECT page_id, url FROM pages)")
_SHIFT = ("greatest(0, least(100, {s} + CASE {k} WHEN 'strict' THEN 15 WHEN 'permissive' "
          "THEN -15 ELSE 0 END))")


def _floor_sql(s, raw, k):
    banded = BAND_SQL.format(s=s)
    return (f"CASE WHEN {k} <> 'permissive' AND ({RANK_SQL.format(v=raw)}) > "
            f"({RANK_SQL.format(v='(' + banded + ')')}) THEN {raw} ELSE {banded} END")


def b01(spark, sf):
    s = F.pmod(F.col("doc_id") * 7 + F.col("n_chars"), F.lit(121)).cast("int")
    return table(spark, sf, "documents").select(
        "doc_id", bands.band(s).alias("verdict"), bands.verdict_rank(bands.band(s)).alias("rank"))


def b02(spark, sf):
    return _url_verdicts(spark, sf).select(
        "page_id", bands.shift_score(F.col("score"), _sens("page_id")).alias("adjusted_score"))


def b03(spark, sf):
    df = CB.with_final_verdict(_url_verdicts(spark, sf), "score", "verdict", _sens("page_id"))
    return df.select("page_id", "adjusted_score", "final_verdict")


def _combined(spark, sf):
    return CB.combine(_url_verdicts(spark, sf), _scored(spark, sf), "page_id", _sens("page_id"))


def b04(spark, sf):
    return _combined(spark, sf).select(
        "page_id", "combined_score", F.array_join("all_reasons", ",").alias("reasons"),
        "adjusted_score", "final_verdict")


def b05(spark, sf):
    return _url_verdicts(spark, sf).select("page_id", CB.needs_page_score(
        F.col("verdict"), F.col("institution_name"), F.col("reasons")).cast("int").alias("needs_page"))


def b06(spark, sf):
    return _combined(spark, sf).groupBy("action").agg(F.count(F.lit(1)).alias("n"))


def b07(spark, sf):
    """Unusable URLs (every page's URL broken or missing) are safe, never an error."""
    bad = table(spark, sf, "pages").select("page_id", F.element_at(F.array(
        F.lit(None).cast("string"), F.lit(""), F.concat(F.lit("http://"), F.lit("")),
        F.concat(F.lit("mailto:"), F.col("url")), F.replace("url", F.lit("://"), F.lit(":")),
        F.concat(F.lit("http://[zz]"), F.col("url"))), (F.col("page_id") % 6 + 1).cast("int")).alias("url"))
    df = score_urls(bad, seeds.allow_list(spark), seeds.block_list(spark), _C)
    return df.select("page_id", "score", "verdict", F.size("reasons").alias("n_reasons"))


COMBINED_SQL = f"""{URL_SQL}, {PAGE_SQL},
both_layers AS (SELECT u.page_id, u.verdict AS raw, u.institution_name, u.score, u.reasons, pv.content_score,
        pv.content_reasons, pv.categories, {_sens_sql('u.page_id')} AS sens,
        least(100, u.score + pv.content_score) AS combined
    FROM scored u JOIN pv ON u.page_id = pv.page_id
    WHERE NOT (u.verdict = 'safe' AND u.institution_name <> '')),
fin AS (SELECT *, {_SHIFT.format(s='combined', k='sens')} AS adj FROM both_layers),
done AS (SELECT *, {_floor_sql('adj', 'raw', 'sens')} AS final_verdict FROM fin)"""

# --- enrichment ------------------------------------------------------------------------


def _nav_hosts(spark, sf):
    return with_hosts(nav(spark, sf)).select("event_id", "session_id", "ts", "url", "host")


def host_ages(spark, sf):
    typed = F.regexp_extract("url", "^https?://([^/]+)", 1)
    hosts = table(spark, sf, "pages").select(strip_www(typed).alias("host")).distinct()
    days = (10 * (F.length("host") % 20)).cast("int")
    first = hosts.select("host", days.alias("value"), F.expr("timestamp'2024-01-01 00:00:00'").alias("fetched_at"))
    again = hosts.filter(F.length("host") % 2 == 0).select(
        "host", F.lit(None).cast("int").alias("value"),
        F.expr("timestamp'2024-01-15 00:00:00'").alias("fetched_at"))
    fresh = hosts.filter(F.length("host") % 3 == 0).select(
        "host", (days + 1).alias("value"), F.expr("timestamp'2024-01-04 12:00:00'").alias("fetched_at"))
    return first.unionByName(again).unionByName(fresh)


AGES_SQL = """ages AS (
    SELECT host, 10 * (len(host) % 20) AS value, TIMESTAMP '2024-01-01 00:00:00' AS fetched_at FROM ph
    UNION ALL SELECT host, NULL, TIMESTAMP '2024-01-15 00:00:00' FROM ph WHERE len(host) % 2 = 0
    UNION ALL SELECT host, 10 * (len(host) % 20) + 1, TIMESTAMP '2024-01-04 12:00:00' FROM ph WHERE len(host) % 3 = 0)"""
_PH = """pn AS (SELECT DISTINCT regexp_replace(regexp_extract(url, '^https?://([^/]+)', 1), '^www[.]', '') AS host
    FROM pages), ph AS (SELECT host FROM pn)"""


def phish_snapshots(spark, sf):
    days = F.explode(F.sequence(F.lit(0), F.lit(20))).alias("d")
    return table(spark, sf, "pages").filter("page_id % 5 = 0").select("page_id", "url", days).select(
        "url", F.lit(True).alias("in_database"), (F.col("page_id") % 2 == 0).alias("valid"),
        F.expr("timestamp'2024-01-01 06:00:00' + make_dt_interval(d)").alias("fetched_at"))


PHISH_SQL = """phish AS (SELECT url, page_id % 2 = 0 AS valid,
    TIMESTAMP '2024-01-01 06:00:00' + to_days(CAST(d AS INTEGER)) AS fetched_at
    FROM (SELECT url, page_id, UNNEST(range(0, 21)) AS d FROM pages WHERE page_id % 5 = 0))"""


def e01(spark, sf):
    df = asof_ttl_join(_nav_hosts(spark, sf), host_ages(spark, sf), "host", "ts", "value",
                       fv.AGE_TTL_SECONDS, fv.FAILED_LOOKUP_TTL_SECONDS, "age_days")
    return df.select("event_id", F.coalesce("age_days", F.lit(-1)).alias("age_days"),
                     F.col("age_days_known").cast("int").alias("known"))


_ASOF = """{out} AS (SELECT * FROM (SELECT n.event_id, s.value AS v, s.fetched_at,
        row_number() OVER (PARTITION BY n.event_id ORDER BY s.fetched_at DESC) AS rn,
        n.ts < s.fetched_at + CASE WHEN s.value IS NULL THEN INTERVAL 1 HOUR ELSE INTERVAL {ttl} END AS live
    FROM {left} n JOIN {right} s ON n.{key} = s.{key} AND s.fetched_at <= n.ts) WHERE rn = 1 AND live)"""
_NAV_HOST = ("nh AS (SELECT *, regexp_replace(regexp_extract(url, '^https?://([^/]+)', 1), "
             "'^www[.]', '') AS host FROM nav)")


def e02(spark, sf):
    born = F.date_format(F.expr("timestamp'2015-03-01 10:00:00' + make_dt_interval(CAST(event_id % 4000 AS INT))"),
                         "yyyy-MM-dd'T'HH:mm:ss'Z'")
    kind = F.when(F.col("event_id") % 4 == 0, "expiration").otherwise("registration")
    payload = F.concat(F.lit('{"events":[{"eventAction":"last changed","eventDate":"2020-01-01T00:00:00Z"},'
                             '{"eventAction":"'), kind, F.lit('","eventDate":"'), born, F.lit('"}]}'))
    df = table(spark, sf, "events").select("event_id", F.col("ts").cast("timestamp").alias("ts"), payload.alias("p"))
    return df.select("event_id", F.coalesce(E.domain_age_days(F.col("p"), F.col("ts")), F.lit(-1)).alias("age_days"))


def e03(spark, sf):
    df = asof_ttl_join(_nav_hosts(spark, sf), host_ages(spark, sf), "host", "ts", "value",
                       fv.AGE_TTL_SECONDS, fv.FAILED_LOOKUP_TTL_SECONDS, "age_days")
    return df.select("event_id", F.when(E.young_domain(
        F.col("age_days"), F.col("session_id") % 2 == 0), fv.YOUNG_DOMAIN_WEIGHT).otherwise(0).alias("extra"))


def e04(spark, sf):
    answers = phish_snapshots(spark, sf).select("url", "fetched_at", F.struct("in_database", "valid").alias("a"))
    df = asof_ttl_join(nav(spark, sf), answers, "url", "ts", "a", fv.PHISH_TTL_SECONDS,
                       fv.FAILED_LOOKUP_TTL_SECONDS, "phish")
    return df.select("event_id", E.is_confirmed_phish(F.col("phish")).cast("int").alias("confirmed"))


def e05(spark, sf):
    scored = score_urls(nav(spark, sf), seeds.allow_list(spark), seeds.block_list(spark), _C, keep_flags=True)
    scored = scored.select(
        "event_id", "ts", "url", "host", "score", "reasons",
        (F.col("session_id") % 3 != 0).alias("entitled"), (F.col("session_id") % 2 == 0).alias("phish_opt_in"),
        F.col("institution_name").isNotNull().alias("claims_institution"))
    scored = materialised(scored, "verdicts")
    out = E.enrich(scored, host_ages(spark, sf), phish_snapshots(spark, sf))
    return out.select("event_id", "score", F.array_join("reasons", ",").alias("reasons"))


E05_SQL = f"""WITH {NAV_SQL}, {verdict_ctes("urls AS (SELECT * FROM nav)")}, {_PH}, {AGES_SQL}, {PHISH_SQL},
pq AS (SELECT url, fetched_at, valid AS value FROM phish),
nb AS (SELECT event_id, session_id, ts, url, host, score, reasons, institution_name FROM scored
       WHERE session_id % 3 <> 0 AND score >= 30 AND score < 80),
{_ASOF.format(out='ag', left='nb', right='ages', key='host', ttl='7 DAY')},
{_ASOF.format(out='pq1', left='nb', right='pq', key='url', ttl='1 DAY')},
en AS (SELECT nb.*, coalesce(ag.v < 90 AND institution_name <> '', FALSE) AS young,
        coalesce(session_id % 2 = 0 AND pq1.v, FALSE) AS listed
    FROM nb LEFT JOIN ag USING (event_id) LEFT JOIN pq1 USING (event_id))
SELECT s.event_id, CAST(CASE WHEN listed THEN 100 WHEN young THEN least(100, s.score + 30) ELSE s.score END
    AS INTEGER) AS score, array_to_string(list_concat(s.reasons, list_filter([
    CASE WHEN young THEN 'young_domain' END, CASE WHEN listed THEN 'confirmed_phish' END],
    lambda x: x IS NOT NULL)), ',') AS reasons
FROM scored s LEFT JOIN en USING (event_id)"""

CLAIMS = _PLAIN[0].name


def page_times(pages):
    """Pages as events at hours after the first snapshots."""
    k = F.col("page_id")
    return pages.select(
        "page_id", "url", F.expr("timestamp'2024-01-03 00:00:00' + make_dt_interval(0, CAST(page_id % 240 AS INT))").alias("ts"),
        (k % 3 != 0).alias("entitled"), (k % 2 == 0).alias("phish_opt_in"))


def e06(spark, sf):
    """Page events end to end."""
    pages = page_times(table(spark, sf, "pages"))
    urls = score_urls(pages, seeds.allow_list(spark), seeds.block_list(spark), _C, keep_flags=True)
    out = page_events(urls, _scored(spark, sf), "page_id", host_ages(spark, sf), phish_snapshots(spark, sf),
                      _sens("page_id"), CLAIMS)
    return out.select("page_id", "combined_score", F.array_join("all_reasons", ",").alias("reasons"),
                      "adjusted_score", "final_verdict", "action")


E06_SQL = f"""WITH {COMBINED_SQL}, {_PH}, {AGES_SQL}, {PHISH_SQL},
pq AS (SELECT url, fetched_at, valid AS value FROM phish),
pe AS (SELECT b.page_id, b.page_id AS event_id, b.raw, b.sens, b.combined, list_concat(b.reasons, b.content_reasons) AS why,
        coalesce(list_contains(b.categories, '{CLAIMS}'), FALSE) OR coalesce(b.institution_name, '') <> '' AS claims,
        s.url, s.host, TIMESTAMP '2024-01-03 00:00:00' + to_hours(CAST(b.page_id % 240 AS INTEGER)) AS ts
    FROM both_layers b JOIN scored s ON s.page_id = b.page_id),
nb AS (SELECT * FROM pe WHERE page_id % 3 <> 0 AND combined >= 30 AND combined < 80),
{_ASOF.format(out='ag', left='nb', right='ages', key='host', ttl='7 DAY')},
{_ASOF.format(out='pq1', left='nb', right='pq', key='url', ttl='1 DAY')},
en AS (SELECT nb.page_id, coalesce(ag.v < 90 AND claims, FALSE) AS young, coalesce(nb.page_id % 2 = 0 AND pq1.v, FALSE) AS listed
    FROM nb LEFT JOIN ag USING (event_id) LEFT JOIN pq1 USING (event_id)),
pf AS (SELECT pe.*, CASE WHEN listed THEN 100 WHEN young THEN least(100, combined + 30) ELSE combined END AS total,
        list_concat(why, list_filter([CASE WHEN young THEN 'young_domain' END, CASE WHEN listed THEN 'confirmed_phish' END],
        lambda x: x IS NOT NULL)) AS codes FROM pe LEFT JOIN en USING (page_id)),
pg AS (SELECT *, {_SHIFT.format(s='total', k='sens')} AS shifted FROM pf),
pd AS (SELECT *, {_floor_sql('shifted', 'raw', 'sens')} AS final_verdict FROM pg)
SELECT page_id, CAST(total AS INTEGER) AS combined_score, array_to_string(codes, ',') AS reasons,
    CAST(shifted AS INTEGER) AS adjusted_score, final_verdict, CASE final_verdict WHEN 'high' THEN 'block'
        WHEN 'medium' THEN 'banner' WHEN 'low' THEN 'badge' ELSE 'none' END AS action FROM pd"""

_DOC_CASE = "lower(text)"
CHECKS = {
    "s05_page_features": (s05, f"""WITH {FEATURES_SQL}
        SELECT page_id, CAST(is_https AS INTEGER) AS is_https, title, meta_description,
            len(text) AS n_chars, md5(text) AS text_md5, CAST({_N_FIELDS} AS INTEGER) AS n_fields, field_text
        FROM features"""),
    "c01_haystack": (c01, f"WITH {FEATURES_SQL} SELECT page_id, md5({_HAY}) AS haystack_md5 FROM features"),
    "c02_term_match": (c02, f"""SELECT doc_id, array_to_string(list_filter([{', '.join(
        f"CASE WHEN {term_sql(_DOC_CASE, t)} THEN {sql_str(t)} END" for t in dict.fromkeys(_ALL_TERMS))}],
        lambda x: x IS NOT NULL), ',') AS terms FROM documents"""),
    "c02_term_dictionary_join": (c02_join, " UNION ALL ".join(
        f"SELECT doc_id, '{c.name}' AS category, {sql_str(t)} AS term FROM documents WHERE {term_sql(_DOC_CASE, t)}"
        for c in _PLAIN for t in category_terms(c))),
    "c03_category_score": (c03, "SELECT doc_id, " + ", ".join(
        f"CAST({_score_sql(_DOC_CASE, c)} AS INTEGER) AS {c.name}" for c in _PLAIN) + " FROM documents"),
    "c04_categories_hit": (c04, f"WITH {PAGE_SQL} SELECT page_id, array_to_string(categories, ',') AS categories FROM pv"),
    "c05_national_id_field": (_flag("national_id_field", "fired"),
                              f"WITH {PAGE_SQL} SELECT page_id, CAST(sin AS INTEGER) AS fired FROM pv"),
    "c06_password_over_http": (_flag("password_over_http", "fired"),
                               f"WITH {PAGE_SQL} SELECT page_id, CAST(pwd AS INTEGER) AS fired FROM pv"),
    "c07_card_code_field": (_flag("card_code_field", "fired"),
                            f"WITH {PAGE_SQL} SELECT page_id, CAST(cvv AS INTEGER) AS fired FROM pv"),
    "c08_credential_defaults": (c08, f"""WITH {PAGE_SQL} SELECT page_id, CAST(least(100,
        {' + '.join(f's_{c.name}' for c in _PLAIN)} + CASE WHEN pwd THEN 25 ELSE 0 END
        + CASE WHEN form = 2 THEN 25 ELSE 0 END) AS INTEGER) AS content_score FROM pv"""),
    "c09_page_verdict": (c09, f"""WITH {PAGE_SQL} SELECT page_id, CAST(content_score AS INTEGER) AS content_score,
        {BAND_SQL.format(s='content_score')} AS content_verdict, array_to_string(content_reasons, ',') AS reasons FROM pv"""),
    "b01_bands": (b01, f"""SELECT doc_id, verdict, CAST({RANK_SQL.format(v='verdict')} AS INTEGER) AS rank FROM (
        SELECT doc_id, {BAND_SQL.format(s='((doc_id * 7 + n_chars) % 121)')} AS verdict FROM documents)"""),
    "b02_sensitivity": (b02, f"""WITH {URL_SQL} SELECT page_id,
        CAST({_SHIFT.format(s='score', k=_sens_sql('page_id'))} AS INTEGER) AS adjusted_score FROM scored"""),
    "b03_verdict_floor": (b03, f"""WITH {URL_SQL}, z AS (SELECT *, {_sens_sql('page_id')} AS sens FROM scored),
        y AS (SELECT *, CAST({_SHIFT.format(s='score', k='sens')} AS INTEGER) AS adjusted_score FROM z)
        SELECT page_id, adjusted_score, {_floor_sql('adjusted_score', 'verdict', 'sens')} AS final_verdict FROM y"""),
    "b04_combined_verdict": (b04, f"""WITH {COMBINED_SQL} SELECT page_id, CAST(combined AS INTEGER) AS combined_score,
        array_to_string(list_concat(reasons, content_reasons), ',') AS reasons,
        CAST(adj AS INTEGER) AS adjusted_score, final_verdict FROM done"""),
    "b05_verified_institution_skip": (b05, f"""WITH {URL_SQL} SELECT page_id,
        CAST(NOT (verdict = 'safe' AND institution_name <> '') AS INTEGER) AS needs_page FROM scored"""),
    "b06_actions": (b06, f"""WITH {COMBINED_SQL} SELECT CASE final_verdict WHEN 'high' THEN 'block'
        WHEN 'medium' THEN 'banner' WHEN 'low' THEN 'badge' ELSE 'none' END AS action, count(*) AS n
        FROM done GROUP BY 1"""),
    "b07_failures_are_safe": (b07, """SELECT page_id, CAST(0 AS INTEGER) AS score, 'safe' AS verdict,
        CAST(0 AS INTEGER) AS n_reasons FROM pages"""),
    "e06_page_event": (e06, E06_SQL),
    "e01_asof_ttl": (e01, f"""WITH {NAV_SQL}, {_NAV_HOST}, {_PH}, {AGES_SQL},
        {_ASOF.format(out='ag', left='nh', right='ages', key='host', ttl='7 DAY')}
        SELECT event_id, CAST(coalesce(v, -1) AS INTEGER) AS age_days,
            CAST(ag.event_id IS NOT NULL AS INTEGER) AS known FROM nh LEFT JOIN ag USING (event_id)"""),
    "e02_domain_age": (e02, """SELECT event_id, CAST(CASE WHEN event_id % 4 = 0 THEN -1 ELSE floor(
        (epoch_us(ts) - epoch_us(TIMESTAMP '2015-03-01 10:00:00' + to_days(CAST(event_id % 4000 AS INTEGER))))
        / 86400000000) END AS INTEGER) AS age_days FROM events"""),
    "e03_young_domain": (e03, f"""WITH {NAV_SQL}, {_NAV_HOST}, {_PH}, {AGES_SQL},
        {_ASOF.format(out='ag', left='nh', right='ages', key='host', ttl='7 DAY')}
        SELECT event_id, CAST(CASE WHEN v < 90 AND session_id % 2 = 0 THEN 30 ELSE 0 END AS INTEGER) AS extra
        FROM nh LEFT JOIN ag USING (event_id)"""),
    "e04_confirmed_phish": (e04, f"""WITH {NAV_SQL}, {PHISH_SQL}, pq AS (SELECT url, fetched_at, valid AS value FROM phish),
        {_ASOF.format(out='pq1', left='nav', right='pq', key='url', ttl='1 DAY')}
        SELECT nav.event_id, CAST(coalesce(v, FALSE) AS INTEGER) AS confirmed FROM nav LEFT JOIN pq1 USING (event_id)"""),
    "e05_enrichment_gate": (e05, E05_SQL),
}

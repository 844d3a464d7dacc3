"""Sources, sinks, licences, reports and list operations."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks import seeds
from checks.inputs import NAV_SQL, PAGE_URLS_SQL, nav, page_urls, pick, sql_pick, table
from checks.url_checks import _C, verdict_ctes
from phishlake.functions.hosts import with_canonical_host, with_hosts
from phishlake.functions.message_parts import build_raw_text
from phishlake.functions.text import fill_template
from phishlake.operators import reports
from phishlake.operators.licences import licence_state, verify_keys
from phishlake.operators.overrides import debounced, drop_overridden, mail_scans
from phishlake.plans.url_job import score_urls
from phishlake.sources import list_store
from phishlake.sources.feeds import build_known_bad, next_version
from phishlake.sources.html_features import extract_mail
from phishlake.sources.lists import list_diff, load_list, numbered, refresh_plan, validate_lists, write_list
from phishlake.sources.sinks import fp_reports, write_verdicts
from phishlake.sources.workdir import work_dir

_HOST = "regexp_replace(regexp_extract(url, '^https?://([^/]+)', 1), '^www[.]', '')"


def _feed(spark, sf):
    lines = F.element_at(F.array(
        F.concat(F.lit("  "), "url"), F.lit("not a url"), F.concat(F.lit("http://localhost/"), "page_id"),
        F.upper("url"), "url"), (F.col("page_id") % 5 + 1).cast("int"))
    return table(spark, sf, "pages").select(F.col("page_id").alias("ord"), lines.alias("line"))


_FEED_SQL = f"""feed AS (SELECT page_id, CASE page_id % 5 WHEN 1 THEN NULL WHEN 2 THEN NULL
    ELSE {_HOST.replace('(url,', '(lower(url),')} END AS host FROM pages),
bad AS (SELECT host FROM feed WHERE host IS NOT NULL GROUP BY host)"""


def s01(spark, sf):
    """Write the built list in shards, then load it through the fall-back chain."""
    base = work_dir(spark, "lists")
    hosts = numbered(build_known_bad(_feed(spark, sf)).select("host"), "host")
    write_list(hosts.select("ord", F.col("host").alias("entry")), "known_bad", "1.0.1", base, shard=20)
    return load_list(spark, "known_bad", f"{base}/missing", base)


def s02(spark, sf):
    pages, docs = table(spark, sf, "pages"), table(spark, sf, "documents")
    k = F.col("page_id")
    inst = pages.select(
        F.when(k % 7 == 0, "nodots").otherwise(F.col("url")).alias("domain"),
        F.when(k % 5 != 0, F.lit("x")).alias("name"), (k % 11 != 0).alias("_hv"),
        F.when(k % 11 != 0, F.lit(True)).alias("high_value"))
    bad = pages.select(F.when(k % 3 == 0, "").otherwise(F.col("url")).alias("domain"))
    d = F.col("doc_id")
    rules = docs.select(
        F.concat(F.lit("r"), d).alias("id"), F.when(d % 4 != 0, F.lit(1)).alias("weight"),
        F.lit("{}").alias("match"), F.col("lang").alias("user_explanation"),
        F.when(F.col("lang") == "fr", F.lit("oui")).alias("user_explanation_fr"))
    orgs = docs.select(
        F.concat(F.lit("o"), d).alias("id"), F.when(d % 6 != 0, F.col("source")).alias("name"),
        F.when(d % 9 != 0, F.array("lang")).alias("aliases"), F.array("source").alias("sending_domains"))
    return validate_lists({"institutions": inst.drop("_hv"), "known_bad": bad, "rules": rules, "sender_orgs": orgs})


S02_SQL = """SELECT 'institutions' AS list_name, 'malformed' AS check_name, count(*) AS "rows",
    count(*) FILTER (page_id % 7 = 0 OR page_id % 5 = 0 OR page_id % 11 = 0) AS bad_rows FROM pages
UNION ALL SELECT 'known_bad', 'malformed', count(*), count(*) FILTER (page_id % 3 = 0) FROM pages
UNION ALL SELECT 'rules', 'malformed', count(*), count(*) FILTER (doc_id % 4 = 0) FROM documents
UNION ALL SELECT 'rules', 'missing_translation', count(*), count(*) FILTER (lang <> 'fr') FROM documents
UNION ALL SELECT 'sender_orgs', 'malformed', count(*), count(*) FILTER (doc_id % 6 = 0 OR doc_id % 9 = 0) FROM documents"""


def s03(spark, sf):
    return build_known_bad(_feed(spark, sf)).withColumn("version", next_version(F.lit("1.4.9")))


def s04(spark, sf):
    k, url = F.col("page_id"), F.col("url")
    pages = table(spark, sf, "pages")
    cur = pages.filter(k % 4 != 3).select(url.alias("list_name"), F.concat(F.lit("1."), k % 3).alias("version"))
    new = pages.filter(k % 4 != 2).select(url.alias("list_name"), F.element_at(F.array(
        F.lit("1.0"), F.lit(None).cast("string"), F.lit("1.2"), F.lit("")), (k % 4 + 1).cast("int")).alias("version"))
    out = refresh_plan(cur, new)
    return out.select("list_name", F.coalesce("current_version", F.lit("-")).alias("current_version"),
                      F.coalesce("incoming_version", F.lit("-")).alias("incoming_version"),
                      F.col("replace").cast("int").alias("replaced"))


S04_SQL = """WITH c AS (SELECT url, concat('1.', page_id % 3) AS cv FROM pages WHERE page_id % 4 <> 3),
n AS (SELECT url, ['1.0', NULL, '1.2', ''][page_id % 4 + 1] AS nv FROM pages WHERE page_id % 4 <> 2)
SELECT coalesce(c.url, n.url) AS list_name, coalesce(cv, '-') AS current_version, coalesce(nv, '-') AS incoming_version,
    CAST(coalesce(nv <> '' AND nv IS DISTINCT FROM cv, FALSE) AS INTEGER) AS replaced
FROM c FULL JOIN n ON c.url = n.url"""



def _hosted_lists(spark, sf, version, entry):
    host = F.regexp_extract("url", "^https?://([^/]+)", 1)
    return table(spark, sf, "pages").withColumn("list_name", host).select("list_name", version.alias("version"), entry.alias("entry"))


def s04_store(spark, sf):
    """Pages as entries of one list per host: a first load, then a refresh with failing, unversioned and unchanged lists."""
    n = F.length("list_name")
    base = work_dir(spark, "lists")
    first = _hosted_lists(spark, sf, F.concat(F.lit("1."), n % 3), F.col("url")).where("length(list_name) % 7 <> 0")
    newer = F.element_at(F.array(F.lit("1.0"), F.lit(None).cast("string"), F.lit("1.2"), F.lit("")), (n % 4 + 1).cast("int"))
    second = _hosted_lists(spark, sf, newer, F.when((n % 5 > 0) | (F.col("page_id") % 3 > 0), F.concat("url", F.lit("?2"))))
    numbers = [list_store.refresh(spark, base, some, F.col("entry").isNull()) for some in (first, second)]
    kept = [list_store.lists_as_of(spark, base, k).withColumn("as_of", F.lit(k)) for k in numbers]
    return kept[0].unionByName(kept[1])


S04_STORE_SQL = """WITH p AS (SELECT *, regexp_extract(url, '^https?://([^/]+)', 1) AS h, len(h) AS n FROM pages),
a AS (SELECT h, concat('1.', n % 3) AS v, url AS entry FROM p WHERE n % 7 <> 0),
b AS (SELECT h, ['1.0', NULL, '1.2', ''][n % 4 + 1] AS v,
        CASE WHEN n % 5 > 0 OR page_id % 3 > 0 THEN concat(url, '?2') END AS entry FROM p),
taken AS (SELECT b.h FROM b GROUP BY b.h HAVING count(*) = count(entry) AND max(v) <> ''
    AND max(v) IS DISTINCT FROM (SELECT max(v) FROM a WHERE a.h = b.h))
SELECT 1 AS as_of, h AS list_name, v AS version, entry FROM a
UNION ALL SELECT 2, h, v, entry FROM a WHERE h NOT IN (SELECT h FROM taken)
UNION ALL SELECT 2, h, v, entry FROM b WHERE h IN (SELECT h FROM taken)"""

_SUBJECT = ["Hello there", None, "", "Invoice <1>"]


def s06(spark, sf):
    n = (F.col("doc_id") % 70 + 1).cast("int")
    anchors = F.transform(F.sequence(F.lit(1), n), lambda i: F.struct(
        F.concat(F.lit("https://a.example/"), i).alias("href"), F.concat(F.lit("t"), i).alias("text")))
    body = F.concat("text", F.lit("\n"), "text", F.lit("\n"), "text")
    raw = build_raw_text(pick(_SUBJECT, "doc_id"), body, anchors)
    return table(spark, sf, "documents").select(
        "doc_id", F.md5(raw).alias("raw_md5"), F.length(raw).cast("bigint").alias("n_chars"))


S06_SQL = f"""WITH z AS (SELECT doc_id, {sql_pick(_SUBJECT, 'doc_id')} AS subj,
    concat(text, chr(10), text, chr(10), text) AS body FROM documents),
y AS (SELECT doc_id, concat(CASE WHEN coalesce(subj, '') <> '' THEN concat('Subject: ', subj, chr(10)) ELSE '' END,
    body, array_to_string(list_transform(range(1, CAST(doc_id % 70 + 1 AS INTEGER) + 1),
    lambda i: concat(chr(10), '<a href="https://a.example/', i, '">t', i, '</a>')), '')) AS r FROM z)
SELECT doc_id, md5(r) AS raw_md5, len(r) AS n_chars FROM y"""


def _escaped(c):
    return F.replace(F.replace(F.replace(c, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")),
                     F.lit(">"), F.lit("&gt;"))


def s07(spark, sf):
    """Every document as an open mail in one of the two layouts; a third has none open."""
    d = F.col("doc_id").cast("string")
    text = _escaped(F.col("text"))
    one = F.concat(F.lit('<div><h2 class="hP">Re: '), d, F.lit('</h2><span class="gD" email="u'), d,
                   F.lit('@mail.example">User &amp; '), d, F.lit('</span><div class="x a3s">'), text,
                   F.lit('<a href="https://l.example/'), d, F.lit('">go <b>there</b></a></div></div>'))
    two = F.concat(F.lit('<div role="main"><div role="heading">Re: '), d, F.lit('</div><span title="u'), d,
                   F.lit('@mail.example">x</span><div role="document">'), text, F.lit("</div></div>"))
    html = F.when(F.col("doc_id") % 3 == 0, one).when(F.col("doc_id") % 3 == 1, two).otherwise(text)
    provider = F.when(F.col("doc_id") % 3 == 1, "two").otherwise("one")
    mails = extract_mail(table(spark, sf, "documents").select(
        F.col("doc_id").alias("msg_id"), provider.alias("provider"), html.alias("html")))
    return mails.select("msg_id", "subject", "sender", F.md5(F.trim("body")).alias("body_md5"),
                        F.array_join(F.transform("anchors", lambda a: F.concat(a["href"], F.lit(">"), a["text"])), "|")
                        .alias("anchors"))


S07_SQL = r"""WITH z AS (SELECT doc_id, trim(regexp_replace(text, '[ \t\n\r\f]+', ' ', 'g')) AS t,
        regexp_replace(text, '[ \t\n\r\f]+', ' ', 'g') AS u FROM documents WHERE doc_id % 3 < 2)
SELECT doc_id AS msg_id, concat('Re: ', doc_id) AS subject,
    CASE WHEN doc_id % 3 = 0 THEN concat('User & ', doc_id, ' <u', doc_id, '@mail.example>')
         ELSE concat('u', doc_id, '@mail.example') END AS sender,
    CASE WHEN doc_id % 3 = 0 THEN md5(concat(chr(10), ltrim(u), 'go there')) ELSE md5(t) END AS body_md5,
    CASE WHEN doc_id % 3 = 0 THEN concat('https://l.example/', doc_id, '>go there') ELSE '' END AS anchors FROM z"""

# --- licences: orders read as billing events ---------------------------------------
_DIGEST = "translate(upper(md5(CAST(o_orderkey AS STRING))), '01', '23')"
_KEY = (f"concat('LIC-', substr({_DIGEST}, 1, 4), '-', substr({_DIGEST}, 5, 4), '-', "
        f"substr({_DIGEST}, 9, 4), '-', substr({_DIGEST}, 13, 4))")
_TYPE = ("CASE o_orderstatus WHEN 'O' THEN 'checkout.session.completed' WHEN 'F' THEN "
         "'customer.subscription.deleted' ELSE 'customer.subscription.updated' END")
_STATUS = ("CASE o_orderpriority WHEN '1-URGENT' THEN 'canceled' WHEN '2-HIGH' THEN 'unpaid' "
           "WHEN '3-MEDIUM' THEN 'active' ELSE 'past_due' END")


def billing(orders, subscription="o_custkey % 500"):
    return orders.select(
        (F.col("o_orderdate").cast("timestamp") + F.make_dt_interval(secs=F.col("o_orderkey") % 80000)).alias("ts"),
        F.expr(_TYPE).alias("event_type"), F.expr(_STATUS).alias("status"),
        F.expr(subscription).cast("string").alias("subscription_id"), F.expr(_KEY).alias("licence_key"))


BILLING_SQL = f"""billing AS (SELECT epoch_us(CAST(o_orderdate AS TIMESTAMP)) + (o_orderkey % 80000) * 1000000 AS ts,
        {_TYPE} AS event_type, {_STATUS} AS status, CAST(o_custkey % 500 AS VARCHAR) AS sub, {_KEY} AS k FROM orders),
ev AS (SELECT *, CASE WHEN event_type = 'checkout.session.completed' THEN 'open'
        WHEN event_type = 'customer.subscription.deleted' THEN 'close'
        WHEN status IN ('canceled', 'unpaid', 'incomplete_expired') THEN 'close' END AS effect FROM billing),
st AS (SELECT k, sub, effect, lead(effect) OVER (PARTITION BY sub ORDER BY ts, effect, k) AS nxt
       FROM ev WHERE effect IS NOT NULL),
state AS (SELECT k AS licence_key, sub AS subscription_id,
        CASE WHEN nxt = 'close' THEN 'inactive' ELSE 'active' END AS status FROM st WHERE effect = 'open')"""


def s08(spark, sf):
    return licence_state(billing(table(spark, sf, "orders")))


_ASKED = (f"CASE o_orderkey % 4 WHEN 0 THEN {_KEY} WHEN 1 THEN lower(concat(' ', {_KEY}, ' ')) "
          f"WHEN 2 THEN replace({_KEY}, '-', '') ELSE concat({_KEY}, 'X') END")


def s09(spark, sf):
    asked = table(spark, sf, "orders").select("o_orderkey", F.expr(_ASKED).alias("key"))
    out = verify_keys(asked, licence_state(billing(table(spark, sf, "orders"))), "LIC")
    return out.select("o_orderkey", "clean_key", F.col("valid").cast("int").alias("valid"), "status")


def _page_verdicts(spark, sf):
    return score_urls(page_urls(spark, sf), seeds.allow_list(spark), seeds.block_list(spark), _C)


PV_SQL = verdict_ctes(PAGE_URLS_SQL)


def s10(spark, sf):
    out = work_dir(spark, "verdicts")
    write_verdicts(_page_verdicts(spark, sf).select("row_id", "score", "verdict"), out)
    return spark.read.parquet(out).select("row_id", "score", "verdict")


def s11(spark, sf):
    v = _page_verdicts(spark, sf).filter("verdict <> 'safe'")
    out = fp_reports(v.select("row_id", F.when(F.col("page_id") % 2 == 0, "site").otherwise("message").alias("kind"),
                              F.col("url").alias("address"), F.lit(None).cast("string").alias("sender"),
                              "verdict", "reasons"))
    return out.select("row_id", "title", "report")


def template(spark, sf):
    return _page_verdicts(spark, sf).select("row_id", fill_template(
        "{name} says {verdict}", name=F.col("institution_name"), verdict=F.col("verdict")).alias("line"))


def _host_rows(spark, sf, scheme):
    return with_hosts(table(spark, sf, "pages")).filter(F.col("url").startswith(scheme)).select("host").distinct()


# --- events with time compressed so that bursts occur --------------------------------


def bursts(spark, sf):
    """(mailbox, ts, signature, event_id): events with time run 300 times faster."""
    micros = F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / 300).cast("bigint")
    return table(spark, sf, "events").select(
        (F.col("user_id") % 2).alias("mailbox"), F.timestamp_micros(micros).alias("ts"),
        F.when(F.col("event_type") < "p", "early").otherwise("late").alias("signature"), "event_id")


BURSTS_SQL = """bursts AS (SELECT user_id % 2 AS mailbox, epoch_us(ts) // 300 AS us,
    CASE WHEN event_type < 'p' THEN 'early' ELSE 'late' END AS signature, event_id FROM events),
calm AS (SELECT * FROM (SELECT *, lead(us) OVER (PARTITION BY mailbox ORDER BY us, event_id) AS nx FROM bursts)
    WHERE nx IS NULL OR nx - us >= 600000)"""


def overrides(spark, sf):
    rows = with_canonical_host(nav(spark, sf), "url", "host")
    first = rows.groupBy("session_id").agg(F.min(F.struct("ts", "event_id", "host")).alias("f"))
    return rows, first.select("session_id", "f.host", "f.ts")


def w04(spark, sf):
    rows, first = overrides(spark, sf)
    return drop_overridden(rows, first).select("event_id", "session_id", "host")


OVERRIDE_SQL = f"""{NAV_SQL}, nr AS (SELECT *, regexp_extract(url, '^https?://([^/]+)', 1) AS host FROM nav),
first_nav AS (SELECT session_id, arg_min(host, struct_pack(ts := ts, e := event_id)) AS host, min(ts) AS ots
    FROM nr GROUP BY session_id)"""
W04_SQL = f"""WITH {OVERRIDE_SQL} SELECT nr.event_id, nr.session_id, nr.host FROM nr
    WHERE NOT EXISTS (SELECT 1 FROM first_nav o WHERE o.session_id = nr.session_id
        AND o.host = nr.host AND o.ots <= nr.ts)"""

CHECKS = {
    "s01_load_list": (s01, f"""WITH {_FEED_SQL} SELECT CAST(row_number() OVER (ORDER BY host) - 1 AS INTEGER) AS ord,
        host AS domain FROM bad"""),
    "s02_validate_lists": (s02, S02_SQL),
    "s03_build_known_bad": (s03, f"WITH {_FEED_SQL} SELECT host, '1.4.10' AS version FROM bad"),
    "s04_versioned_refresh": (s04, S04_SQL),
    "s04_committed_refresh": (s04_store, S04_STORE_SQL),
    "s06_raw_message_text": (s06, S06_SQL),
    "s07_open_mail": (s07, S07_SQL),
    "s08_licence_state": (s08, f"WITH {BILLING_SQL} SELECT * FROM state"),
    "s09_verify_keys": (s09, f"""WITH {BILLING_SQL}, q AS (SELECT o_orderkey, upper(trim({_ASKED})) AS clean_key FROM orders)
        SELECT o_orderkey, clean_key, CAST(coalesce(shaped AND status = 'active', FALSE) AS INTEGER) AS valid,
            CASE WHEN shaped THEN coalesce(status, 'unknown') ELSE 'unknown' END AS status
        FROM (SELECT *, regexp_matches(clean_key, '^LIC(-[2-9A-HJKMNP-Z]{{4}}){{4}}$') AS shaped FROM q)
        LEFT JOIN state ON licence_key = clean_key"""),
    "s10_verdict_sink": (s10, f"WITH {PV_SQL} SELECT row_id, CAST(score AS INTEGER) AS score, verdict FROM scored"),
    "s11_false_positive_reports": (s11, f"""WITH {PV_SQL} SELECT row_id,
        CASE WHEN page_id % 2 = 0 THEN 'site flagged by mistake' ELSE 'message flagged by mistake' END AS title,
        concat('kind: ', CASE WHEN page_id % 2 = 0 THEN 'site' ELSE 'message' END, chr(10), 'address: ', url, chr(10),
            'verdict: ', verdict, chr(10), 'reasons: ', array_to_string(reasons, ',')) AS report
        FROM scored WHERE verdict <> 'safe'"""),
    "f01_template_fill": (template, f"""WITH {PV_SQL} SELECT row_id,
        concat(institution_name, ' says ', verdict) AS line FROM scored"""),
    "a01_verdict_counts": (
        lambda spark, sf: reports.verdict_counts(_page_verdicts(spark, sf)),
        f"""WITH {PV_SQL} SELECT verdict, count(*) AS n, CASE verdict WHEN 'high' THEN 'block' WHEN 'medium'
        THEN 'banner' WHEN 'low' THEN 'badge' ELSE 'none' END AS action FROM scored GROUP BY verdict"""),
    "a02_top_reasons": (
        lambda spark, sf: reports.top_reasons(_page_verdicts(spark, sf), k=4),
        f"""WITH {PV_SQL} SELECT reason, count(*) AS n FROM (SELECT UNNEST(reasons) AS reason FROM scored)
        GROUP BY reason ORDER BY n DESC, reason LIMIT 4"""),
    "q06_list_diff": (
        lambda spark, sf: list_diff(_host_rows(spark, sf, "http:"), _host_rows(spark, sf, "https:"), "host"),
        f"""WITH a AS (SELECT DISTINCT {_HOST} AS host FROM pages WHERE url LIKE 'http:%'),
        b AS (SELECT DISTINCT {_HOST} AS host FROM pages WHERE url LIKE 'https:%')
        SELECT host, 'left_only' AS side FROM (SELECT host FROM a EXCEPT SELECT host FROM b)
        UNION ALL SELECT host, 'right_only' FROM (SELECT host FROM b EXCEPT SELECT host FROM a)"""),
    "w03_mail_debounce": (
        lambda spark, sf: debounced(bursts(spark, sf), "mailbox", "ts", ["event_id"]).select("mailbox", "event_id"),
        f"WITH {BURSTS_SQL} SELECT mailbox, event_id FROM calm"),
    "w03_mail_scans": (
        lambda spark, sf: mail_scans(bursts(spark, sf), "mailbox", "ts", "signature", ["event_id"])
        .select("mailbox", "event_id", "signature"),
        f"""WITH {BURSTS_SQL} SELECT mailbox, event_id, signature FROM (SELECT *,
        lag(signature) OVER (PARTITION BY mailbox ORDER BY us, event_id) AS pv FROM calm)
        WHERE pv IS DISTINCT FROM signature"""),
    "w04_session_overrides": (w04, W04_SQL),
}

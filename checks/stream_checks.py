"""Streaming jobs over the driver tables, run to completion."""

from __future__ import annotations


from pyspark.sql import functions as F

from checks import seeds
from checks.inputs import NAV_SQL, pages_with_forms, table
from checks.ops_checks import BILLING_SQL, billing
from checks.page_checks import CONFIG, PAGE_SQL
from checks.url_checks import _C, verdict_ctes
from phishlake.functions.hosts import with_canonical_host
from phishlake.plans.page_job import score_pages
from phishlake.plans.url_job import score_urls
from phishlake.sources.html_features import extract_page_features
from phishlake.sources.workdir import work_dir
from phishlake.streaming import jobs, stateful

#: Times run faster by these factors, so that limits and bursts occur per user.
RATE_SPEED = 30_000
BURST_SPEED = 60_000
BURST_DELAY = "1 second"
OVERRIDE_LIFE = "10 days"


def _stream(spark, sf, name):
    """The files of a table, which may be one file or a folder of them.

    The pattern has one match: a file source that is given a plain path takes it for a folder.
    """
    return spark.readStream.schema(table(spark, sf, name).schema).parquet(f"{sf.rstrip('/')}/{name}.parque[t]")


def nav_stream(spark, sf, event_type="view"):
    """Events of a type as a stream, pointed at the static pages."""
    pages = table(spark, sf, "pages").select("page_id", "url")
    n = pages.count()
    views = _stream(spark, sf, "events").filter(F.col("event_type") == event_type).select(
        "event_id", F.col("user_id").alias("session_id"), F.col("ts").cast("timestamp").alias("ts"),
        (F.col("event_id") % n).alias("page_id"))
    return views.join(pages, "page_id").select("event_id", "session_id", "ts", "url")


def _scored_nav(spark, sf, out):
    def score(batch):
        # lists are asked for again for every micro-batch
        return score_urls(batch, seeds.allow_list(spark), seeds.block_list(spark), _C)

    jobs.score_stream(nav_stream(spark, sf), score, f"{out}/data", f"{out}/checkpoint").awaitTermination()
    return spark.read.parquet(f"{out}/data")


def w01(spark, sf):
    return _scored_nav(spark, sf, work_dir(spark, "nav")).select("event_id", "score", "verdict")


def w02(spark, sf):
    """Pages as a stream: features and content score per micro-batch."""
    html = pages_with_forms(spark, sf).select("page_id", F.col("html").alias("form_html"))
    rows = _stream(spark, sf, "pages").select("page_id", "url").join(html, "page_id").select(
        "page_id", "url", F.col("form_html").alias("html"))
    out = work_dir(spark, "pages")
    jobs.score_stream(
        rows, lambda b: score_pages(extract_page_features(b), list(seeds.CATEGORIES), CONFIG).select(
            "page_id", "content_score", "content_verdict"),
        f"{out}/data", f"{out}/checkpoint").awaitTermination()
    return spark.read.parquet(f"{out}/data").select("page_id", "content_score", "content_verdict")


def _views(spark, sf):
    """Events as looks at the mailbox of their user."""
    micros = F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / BURST_SPEED).cast("bigint")
    views = _stream(spark, sf, "events").select(
        F.col("user_id").alias("mailbox"), F.timestamp_micros(micros).alias("ts"), F.col("event_id").alias("view_id"),
        F.when(F.col("event_type") < "p", "early").otherwise("late").alias("signature"))
    return jobs.with_event_time(views, delay=BURST_DELAY)


def _run(spark, rows, name, idle_batches=True):
    out = work_dir(spark, name)
    stateful.start_stateful(rows, f"{out}/data", f"{out}/checkpoint", idle_batches).awaitTermination()
    return spark.read.schema(rows.schema).parquet(f"{out}/data")


def w03(spark, sf):
    """Last view of every burst that the watermark has closed."""
    return _run(spark, stateful.bursts(_views(spark, sf)), "bursts").select("mailbox", "micros", "signature")


def w03_scans(spark, sf):
    return _run(spark, stateful.scans(_views(spark, sf)), "scans").select("mailbox", "view_id", "signature")


CLOSED_BURSTS_SQL = f"""views AS (SELECT user_id AS mailbox, epoch_us(ts) // {BURST_SPEED} AS us,
    CASE WHEN event_type < 'p' THEN 'early' ELSE 'late' END AS signature, event_id FROM events),
closed AS (SELECT * FROM (SELECT *, lead(us) OVER (PARTITION BY mailbox ORDER BY us, event_id) AS nx FROM views)
    WHERE (nx IS NULL OR nx - us >= 600000)
        AND us + 599999 <= (SELECT (max(us) // 1000 - 1000) * 1000 FROM views))"""


def w04(spark, sf):
    """Navigations and overrides as two streams: a user accepts the host of each sign-up's page."""
    def hosts(event_type):
        return jobs.with_event_time(with_canonical_host(nav_stream(spark, sf, event_type), "url", "host").select(
            "event_id", "session_id", "host", "ts"))
    rows = stateful.not_overridden(hosts("view"), hosts("signup"), OVERRIDE_LIFE)
    return _run(spark, rows, "overrides").select("event_id", "session_id", "host")


_HOSTS = """(SELECT event_id, user_id AS session_id, ts, regexp_extract(url, '^https?://([^/]+)', 1) AS host FROM (
    SELECT *, event_id % (SELECT count(*) FROM pages) AS page_id FROM events WHERE event_type = '{kind}') e JOIN pages USING (page_id))"""
W04_SQL = f"""WITH n AS {_HOSTS.format(kind='view')}, o AS {_HOSTS.format(kind='signup')},
mark AS (SELECT least((SELECT max(ts) FROM n), (SELECT max(ts) FROM o)) - INTERVAL 10 MINUTE AS w)
SELECT event_id, session_id, host FROM n WHERE ts <= (SELECT w FROM mark) AND NOT EXISTS (
    SELECT 1 FROM o WHERE o.session_id = n.session_id AND o.host = n.host AND o.ts <= n.ts
        AND o.ts >= n.ts - INTERVAL {OVERRIDE_LIFE})"""


def w05(spark, sf):
    """Events as calls of their user, with time run faster so that the limit bites."""
    micros = F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / RATE_SPEED).cast("bigint")
    calls = _stream(spark, sf, "events").select(
        F.concat(F.lit("k"), F.col("user_id").cast("string")).alias("key"),
        F.col("event_id").alias("call_id"), F.timestamp_micros(micros).alias("ts"))
    out = work_dir(spark, "rate")
    stateful.limit_calls(calls, f"{out}/data", f"{out}/checkpoint").awaitTermination()
    return spark.read.parquet(f"{out}/data").select(
        "key", "call_id", F.col("allowed").cast("int").alias("allowed"))


W05_SQL = f"""WITH RECURSIVE calls AS (SELECT concat('k', user_id) AS key, event_id, epoch_us(ts) // {RATE_SPEED} AS us,
    row_number() OVER (PARTITION BY user_id ORDER BY epoch_us(ts) // {RATE_SPEED}, event_id) AS rn FROM events),
walk AS (
    SELECT key, event_id, rn, CAST(1 AS INTEGER) AS cnt, us + 60000000 AS until, CAST(1 AS INTEGER) AS ok
    FROM calls WHERE rn = 1
    UNION ALL
    SELECT c.key, c.event_id, c.rn, CAST(CASE WHEN c.us >= until THEN 1 WHEN cnt < 30 THEN cnt + 1 ELSE cnt END AS INTEGER),
        CASE WHEN c.us >= until OR cnt < 30 THEN c.us + 60000000 ELSE until END,
        CAST(CASE WHEN c.us >= until OR cnt < 30 THEN 1 ELSE 0 END AS INTEGER)
    FROM walk w JOIN calls c ON c.key = w.key AND c.rn = w.rn + 1)
SELECT key, event_id AS call_id, ok AS allowed FROM walk"""


def s08_stream(spark, sf):
    """Billing events as a stream, a subscription per customer; the state of every key from its changes."""
    changes = stateful.licence_changes(billing(_stream(spark, sf, "orders"), "o_custkey"))
    return stateful.licences_now(_run(spark, changes, "licences"))


def w06(spark, sf):
    """Hourly event counts, closed windows only: the watermark trails by ten minutes."""
    counts = jobs.windowed_counts(
        jobs.with_event_time(_stream(spark, sf, "events")), "ts", "1 hour", "event_type")
    out = work_dir(spark, "closed")
    jobs.write_closed_windows(counts, f"{out}/data", f"{out}/checkpoint").awaitTermination()
    return spark.read.parquet(f"{out}/data").select(
        F.unix_seconds("window_start").alias("hour"), "event_type", "n")


def w07(spark, sf):
    """Verdicts per hour, streamed from the verdict table that the first job writes."""
    out = work_dir(spark, "windows")
    scored = _scored_nav(spark, sf, f"{out}/nav").select("event_id", "ts", "verdict")
    stream = jobs.with_event_time(
        spark.readStream.schema(scored.schema).parquet(f"{out}/nav/data"))
    counts = jobs.windowed_counts(stream, "ts", "1 hour", "verdict")
    jobs.write_counts(counts, f"{out}/data", f"{out}/checkpoint").awaitTermination()
    return jobs.merged_counts(spark, f"{out}/data", "verdict").select(
        F.unix_seconds("window_start").alias("hour"), "verdict", "n")


_NAV_VERDICTS = f"{NAV_SQL}, {verdict_ctes('urls AS (SELECT * FROM nav)')}"
CHECKS = {
    "w01_stream_equals_batch": (
        w01, f"WITH {_NAV_VERDICTS} SELECT event_id, CAST(score AS INTEGER) AS score, verdict FROM scored"),
    "w02_page_stream": (w02, f"""WITH {PAGE_SQL} SELECT page_id, CAST(content_score AS INTEGER) AS content_score,
        CASE WHEN content_score >= 80 THEN 'high' WHEN content_score >= 55 THEN 'medium'
             WHEN content_score >= 30 THEN 'low' ELSE 'safe' END AS content_verdict FROM pv"""),
    "w03_debounce_stream": (w03, f"WITH {CLOSED_BURSTS_SQL} SELECT mailbox, us AS micros, signature FROM closed"),
    "w03_scan_stream": (w03_scans, f"""WITH {CLOSED_BURSTS_SQL} SELECT mailbox, event_id AS view_id, signature FROM (
        SELECT *, lag(signature) OVER (PARTITION BY mailbox ORDER BY us, event_id) AS pv FROM closed)
        WHERE pv IS DISTINCT FROM signature"""),
    "w04_override_stream": (w04, W04_SQL),
    "w05_rate_limit_stream": (w05, W05_SQL),
    "s08_licence_stream": (
        s08_stream, f"WITH {BILLING_SQL.replace('o_custkey % 500', 'o_custkey')} SELECT * FROM state"),
    "w06_late_data_watermark": (w06, """SELECT hour, event_type, n FROM (
        SELECT CAST(epoch(date_trunc('hour', ts)) AS BIGINT) AS hour, event_type, count(*) AS n
        FROM events GROUP BY 1, 2)
        WHERE hour + 3600 <= (SELECT epoch(max(ts)) FROM events) - 600"""),
    "w07_windowed_verdicts": (w07, f"""WITH {_NAV_VERDICTS}
        SELECT CAST(epoch(date_trunc('hour', ts)) AS BIGINT) AS hour, verdict, count(*) AS n FROM scored GROUP BY 1, 2"""),
}

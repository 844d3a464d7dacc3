"""Events end to end: navigations and pages, in batch and as streams."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks import seeds
from checks.inputs import NAV_SQL, nav, pages_with_forms
from checks.page_checks import (
    _SHIFT, CLAIMS, CONFIG, E06_SQL, _floor_sql, _sens, _sens_sql, host_ages, page_times, phish_snapshots,
)
from checks.stream_checks import OVERRIDE_LIFE, _stream, nav_stream
from checks.url_checks import _C, _UNDER, _USER_SQL, verdict_ctes
from phishlake.operators.lookups import ListTable, local_frame
from phishlake.plans import navigation
from phishlake.plans.events import page_events
from phishlake.plans.page_job import score_pages
from phishlake.plans.url_job import score_urls
from phishlake.sources.html_features import extract_page_features
from phishlake.sources.lists import clean_user_lists
from phishlake.sources.workdir import materialised, work_dir
from phishlake.streaming import jobs, stateful

_COLUMNS = ("event_id", "session_id", "score", "verdict", "adjusted_score", "final_verdict", "action")


def _user_lists(spark):
    return ListTable(clean_user_lists(local_frame(spark, list(seeds.USER_LISTS), "tenant string, kind string, entry string")))


def _owned(rows):
    return rows.withColumn("tenant", F.concat(F.lit("t"), (F.col("session_id") % 4).cast("string")))


def _shown(df):
    return df.select(*_COLUMNS, F.array_join("reasons", ",").alias("reasons"))


def n01(spark, sf):
    """Every session accepts the host of its first navigation, every fourth page is no web address."""
    rows = nav(spark, sf).withColumn("url", F.when(F.col("event_id") % 4 == 3, F.concat(F.lit("file:"), "url")).otherwise(F.col("url")))
    rows = materialised(rows, "navigations")
    first = navigation.web_navigations(rows).groupBy("session_id").agg(F.min(F.struct("ts", "event_id", "override_host")).alias("f"))
    return _shown(navigation.navigation_actions(
        _owned(rows), first.select("session_id", "f.override_host", "f.ts"), seeds.allow_list(spark), seeds.block_list(spark),
        _sens("session_id"), _user_lists(spark), _C))


def n02(spark, sf):
    """Navigations and sign-ups as two streams; what no override covers is scored per micro-batch."""
    def hosts(event_type):
        return jobs.with_event_time(navigation.web_navigations(nav_stream(spark, sf, event_type)))
    open_ = stateful.not_overridden(hosts("view"), hosts("signup").drop("url", "event_id"), OVERRIDE_LIFE, host="override_host")
    lists = _user_lists(spark)

    def score(batch):
        return navigation.act_on(
            _owned(batch.drop("override_host")), seeds.allow_list(spark), seeds.block_list(spark), _sens("session_id"), lists, _C)
    out = work_dir(spark, "navigation")
    jobs.score_stream(open_, score, f"{out}/data", f"{out}/checkpoint").awaitTermination()
    return _shown(spark.read.parquet(f"{out}/data"))


def n03(spark, sf):
    """Page events as a stream: both layers of the same row, enriched from the snapshots, per micro-batch."""
    html = pages_with_forms(spark, sf).select("page_id", F.col("html").alias("form_html"))
    rows = page_times(_stream(spark, sf, "pages").select("page_id", "url")).join(html, "page_id")
    ages, phish = materialised(host_ages(spark, sf), "ages"), materialised(phish_snapshots(spark, sf), "phish")

    def score(batch):
        urls = score_urls(batch.drop("form_html"), seeds.allow_list(spark), seeds.block_list(spark), _C, keep_flags=True)
        pages = score_pages(extract_page_features(batch.select("page_id", "url", F.col("form_html").alias("html"))),
                            list(seeds.CATEGORIES), CONFIG)
        return page_events(urls, pages, "page_id", ages, phish, _sens("page_id"), CLAIMS).select(
            "page_id", "combined_score", F.array_join("all_reasons", ",").alias("reasons"), "adjusted_score", "final_verdict", "action")
    out = work_dir(spark, "page-events")
    jobs.score_stream(rows, score, f"{out}/data", f"{out}/checkpoint").awaitTermination()
    return spark.read.parquet(f"{out}/data").drop("batch")


_EXACT = "regexp_extract(url, '^https?://([^/]+)', 1)"


def _actions_sql(ctes: str) -> str:
    """``nv`` (event_id, session_id, ts, url) scored and acted on."""
    return f"""WITH {ctes}, {verdict_ctes('urls AS (SELECT * FROM nv)')}, {_USER_SQL},
t AS (SELECT *, concat('t', session_id % 4) AS tenant, {_sens_sql('session_id')} AS sens FROM scored),
f AS (SELECT event_id, bool_or(kind = 'allow') AS ua, bool_or(kind = 'block') AS ub
      FROM t JOIN ul ON t.tenant = ul.tenant AND {_UNDER.format(h='host', d='domain')} GROUP BY event_id),
u AS (SELECT event_id, session_id, sens, CASE WHEN ua THEN 0 WHEN ub THEN 100 ELSE score END AS score,
        CASE WHEN ua THEN 'safe' WHEN ub THEN 'high' ELSE verdict END AS verdict,
        CASE WHEN ua THEN 'user_allowed' WHEN ub THEN 'user_blocked' ELSE array_to_string(reasons, ',') END AS reasons
    FROM t LEFT JOIN f USING (event_id)),
g AS (SELECT *, {_SHIFT.format(s='score', k='sens')} AS shifted FROM u),
d AS (SELECT *, {_floor_sql('shifted', 'verdict', 'sens')} AS final_verdict FROM g)
SELECT event_id, session_id, CAST(score AS INTEGER) AS score, verdict, reasons, CAST(shifted AS INTEGER) AS adjusted_score,
    final_verdict, CASE final_verdict WHEN 'high' THEN 'block' WHEN 'medium' THEN 'banner' WHEN 'low' THEN 'badge'
        ELSE 'none' END AS action FROM d"""


N01_SQL = _actions_sql(f"""{NAV_SQL}, w AS (SELECT *, {_EXACT} AS oh FROM nav WHERE event_id % 4 <> 3),
fo AS (SELECT session_id, arg_min(oh, struct_pack(ts := ts, e := event_id)) AS oh, min(ts) AS ots FROM w GROUP BY session_id),
nv AS (SELECT event_id, session_id, ts, url FROM w WHERE NOT EXISTS (
    SELECT 1 FROM fo WHERE fo.session_id = w.session_id AND fo.oh = w.oh AND fo.ots <= w.ts))""")
_KIND = f"""(SELECT event_id, user_id AS session_id, ts, url, {_EXACT} AS oh FROM (
    SELECT *, event_id % (SELECT count(*) FROM pages) AS page_id FROM events WHERE event_type = '{{kind}}') e JOIN pages USING (page_id))"""
N02_SQL = _actions_sql(f"""w AS {_KIND.format(kind='view')}, o AS {_KIND.format(kind='signup')},
mark AS (SELECT least((SELECT max(ts) FROM w), (SELECT max(ts) FROM o)) - INTERVAL 10 MINUTE AS m),
nv AS (SELECT event_id, session_id, ts, url FROM w WHERE ts <= (SELECT m FROM mark) AND NOT EXISTS (
    SELECT 1 FROM o WHERE o.session_id = w.session_id AND o.oh = w.oh AND o.ts <= w.ts AND o.ts >= w.ts - INTERVAL {OVERRIDE_LIFE}))""")

CHECKS = {
    "n01_navigation_actions": (n01, N01_SQL),
    "n02_navigation_stream": (n02, N02_SQL),
    "n03_page_event_stream": (n03, E06_SQL),
}

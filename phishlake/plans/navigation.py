"""A navigation end to end: override, URL score with the user's lists, sensitivity, floor, action."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from phishlake.functions.hosts import with_canonical_host
from phishlake.operators.lookups import ListTable
from phishlake.operators.overrides import drop_overridden
from phishlake.plans.combine import with_final_verdict
from phishlake.plans.url_job import UrlConfig, score_urls

WEB = r"(?i)^https?://"


def web_navigations(nav: DataFrame, url: str = "url") -> DataFrame:
    """Navigations to web addresses, the only ones looked at, with the exact host that overrides go by."""
    return with_canonical_host(nav.where(F.col(url).rlike(WEB)), url, "override_host")


def act_on(nav: DataFrame, allow: ListTable, block: ListTable, sensitivity: Column, user_lists: ListTable | None = None,
           config: UrlConfig = UrlConfig()) -> DataFrame:
    """Score, adjusted score, final verdict and action of navigations that no override covers."""
    scored = score_urls(nav, allow, block, config, user_lists=user_lists)
    return with_final_verdict(scored, "score", "verdict", sensitivity)


def navigation_actions(nav: DataFrame, overrides: DataFrame, allow: ListTable, block: ListTable, sensitivity: Column,
                       user_lists: ListTable | None = None, config: UrlConfig = UrlConfig()) -> DataFrame:
    """(session_id, ts, url, …) rows with what the user gets to see.

    ``overrides`` is (session_id, override_host, ts): hosts that a session accepted, exact, from that time
    on. Overridden navigations and those to no web address give no row. ``tenant`` names the user lists' owner.
    """
    open_ = drop_overridden(web_navigations(nav), overrides, host="override_host").drop("override_host")
    return act_on(open_, allow, block, sensitivity, user_lists, config)

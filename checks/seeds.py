"""Small reference lists of our own, chosen so that every signal occurs in the driver tables."""

from __future__ import annotations

from pyspark.sql import SparkSession

from phishlake.operators.lookups import ListTable, local_frame
from phishlake.plans.url_job import UrlConfig
from phishlake.sources.lists import Category, Org, Rule, allow_table, block_table

TLDS = ("com", "net", "org")
HIGH_VALUE = tuple(f"{n}.example.{t}" for n in ("ththen", "thther", "therin") for t in TLDS)
LOW_VALUE = tuple(f"ththan.example.{t}" for t in TLDS) + ("theron.example", "tionsh.example")
ALLOW = tuple(
    (d, d.split(".")[0].title() + " " + d.split(".")[-1], f"https://{d}/", d in HIGH_VALUE, i)
    for i, d in enumerate(HIGH_VALUE + LOW_VALUE)
)
BLOCK = tuple(
    f"{n}.example.{t}" for n in ("spam-farm", "cheap-pills", "casino-win", "free-bets")
    for t in TLDS
)
URL_CONFIG = UrlConfig(
    risky_tlds=(".org",), gov_keywords=("blog", "/fr"), gov_suffixes=(".example.net",)
)
USER_LISTS = (
    ("t0", "allow", "https://www.thtion.example.com/a"), ("t0", "block", "example.net"),
    ("t0", "allow", "ththre.example.net"), ("t1", "block", "WWW.thther.example.org "),
    ("t1", "allow", "spam-farm.example.com"), ("t1", "allow", "not a domain"),
    ("t1", "allow", "spam-farm.example.com/x?y"), ("t2", "block", "example.com"),
    ("t2", "allow", "example.com"),
)
CATEGORIES = (
    Category("cat_a", 15, 45, terms=("the", "that", "from", "this"), terms_fr=("les", "que", "the")),
    Category("cat_b", 20, 40, terms=("der", "die", "license")),
    Category("cat_c", 30, None, terms=("token",)),
    Category("forms", 25, None, structural=True, sin_terms=("sin", "social number"),
             cvv_terms=("cvv", "security code"), gov_suffixes=(".example.net",)),
)
ORGS = (
    Org("o1", "Org One", ("license", "mit license"), ("mail1.example.com",),
        "https://one.example.com/contact", "555-0101"),
    Org("o2", None, ("token", "Thther Bank"), ("mail2.example.com", "thther.example.org"),
        "https://two.example.com/contact", None),
    Org("o3", "Org Three", ("parcel desk",), (), None, "555-0103"),
)
MARKS = ("gift card", "wire transfer")
RULES = (
    Rule("gift_demand", 70, {"body_contains_any": list(MARKS)}, "asks for gift cards", "demande des cartes"),
    Rule("free_mail_claim", 45, {
        "from_domain_in": ["gmail.com", "yahoo.ca"], "body_or_display_claims_institution": True},
        "claims an organisation from free mail", None),
    Rule("exe_or_locked", 75, {
        "attachment_extension_in": [".exe", ".scr"], "or_password_protected_archive": True},
        "dangerous attachment", "piece jointe"),
    Rule("alike_host", 60, {"lookalike_of_high_value_whitelist": True}, "look-alike host", None),
    Rule("amount_and_phone", 35, {
        "body_dollar_amount_in_range": [199, 799], "body_contains_phone_number": True},
        "invoice with phone", None),
    Rule("link_differs", 55, {"link_text_domain_differs_from_href_domain": True}, "link text differs", None),
    Rule("ip_link", 40, {"link_url_is_ip_address": True}, None, None),
    Rule("auth_fail", 65, {
        "spf_or_dkim_or_dmarc_failed": True, "claimed_brand_in_whitelist": True},
        "failed authentication", None),
    Rule("national_id", 60, {"body_contains_sin_pattern": True}, "shows an id number", "numero"),
    Rule("several_signs", 15, {"other_rules_triggered_count_gte": 2, "link_present": True},
         "several signs", None),
    Rule("many_signs", 10, {"other_rules_triggered_count_gte": 4}, "many signs", None),
    Rule("never", 90, {"no_such_predicate": True}, "never", None),
    Rule("polished", 90, {"body_appears_ai_polished": True}, "never", None),
)


def allow_list(spark: SparkSession) -> ListTable:
    df = local_frame(
        spark, list(ALLOW), "domain string, name string, official_url string, high_value boolean, ord int")
    return allow_table(df)


def block_list(spark: SparkSession) -> ListTable:
    return block_table(local_frame(spark, [(d,) for d in BLOCK], "domain string"))


def sql_str(text: str | None) -> str:
    return "NULL" if text is None else "'" + text.replace("'", "''") + "'"


def sql_list(items) -> str:
    return "[" + ", ".join(sql_str(x) for x in items) + "]"


def sql_values(rows) -> str:
    def cell(v):
        if isinstance(v, bool):
            return "TRUE" if v else "FALSE"
        return str(v) if isinstance(v, (int, float)) else sql_str(v)
    return "VALUES " + ", ".join("(" + ", ".join(cell(v) for v in r) + ")" for r in rows)

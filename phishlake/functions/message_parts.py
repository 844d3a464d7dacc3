"""Parts of a raw message: sender, links, phones, anchors, amounts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from phishlake.functions.hosts import ANY_HOST_SCHEMES, hosts_of_urls, strip_www
from phishlake.functions.settle import settled
from phishlake.functions.text import SPACE, text_or_empty, trim_space

# --- fixed values: extraction patterns -------------------------------------
LINK = rf"""(?i)https?://[^{SPACE}<>"')\]]+"""
PHONE = r"(?:\+?1[-. ]?)?\(?[0-9]{3}\)?[-. ][0-9]{3}[-. ][0-9]{4}"
ANCHOR = r"""(?i)<a[^>]*href=["']([^"']+)["'][^>]*>([^<]*)</a>"""
EMAIL = r"(?i)[a-z0-9._%+-]++@[a-z0-9.-]+\.[a-z]{2,}"
DOLLARS = rf"\$[{SPACE}]?([0-9][0-9,]*(?:\.[0-9]{{2}})?)"
FROM_LINE = rf"(?im)^from:[{SPACE}]*(.+)$"
ANGLED_SENDER = rf"^(.*?)<[{SPACE}]*([^<>{SPACE}]+@[^<>{SPACE}]+)[{SPACE}]*>$"
BARE_SENDER = rf"""[^{SPACE}"'<>]+@[^{SPACE}"'<>]+"""
HOST_LIKE_TEXT = r"(?i)^[a-z0-9.-]+\.[a-z]{2,}$"


# every phone number holds this; it is much cheaper to look for
PHONE_CORE = r"[0-9]{3}[-. ][0-9]{4}"


def _all(c: Column, pattern: str, must_hold: str, group: int = 0) -> Column:
    """All matches; texts without a piece that every match holds are not searched."""
    found = F.regexp_extract_all(c, F.lit(pattern), F.lit(group))
    return F.when(c.contains(must_hold), found).otherwise(F.array().cast("array<string>"))


def sender_text(from_hdr: Column, body: Column) -> Column:
    """The From header, else the first ``From:`` line of the body, else ''."""
    return F.coalesce(
        F.nullif(from_hdr, F.lit("")), F.regexp_extract(text_or_empty(body), FROM_LINE, 1)
    )


def _unquote(c: Column) -> Column:
    return F.regexp_replace(c, r"""^["']|["']$""", "")


def parse_sender(c: Column) -> Column:
    """``Name <a@b>`` or a bare address -> struct(display_name, email, domain, local)."""
    s = trim_space(text_or_empty(c))
    is_angled = s.rlike(ANGLED_SENDER)
    bare = F.regexp_extract(s, f"({BARE_SENDER})", 1)
    email = F.when(is_angled, F.regexp_extract(s, ANGLED_SENDER, 2)).otherwise(
        F.nullif(bare, F.lit(""))
    )
    around = F.regexp_replace(s, f"(?s)^(.*?){BARE_SENDER}", "$1")
    named = (
        F.when(is_angled, _unquote(trim_space(F.regexp_extract(s, ANGLED_SENDER, 1))))
        .when(bare != "", _unquote(trim_space(around)))
        .otherwise(s)
    )
    pieces = F.split(email, "@")
    return F.struct(
        named.alias("display_name"),
        email.alias("email"),
        F.nullif(F.lower(F.get(pieces, F.lit(1))), F.lit("")).alias("domain"),
        F.get(pieces, F.lit(0)).alias("local"),
    )


def extract_links(body: Column) -> Column:
    return _all(text_or_empty(body), LINK, "://")


def extract_phones(body: Column) -> Column:
    b = text_or_empty(body)
    found = F.regexp_extract_all(b, F.lit(PHONE), F.lit(0))
    return F.when(b.rlike(PHONE_CORE), found).otherwise(F.array().cast("array<string>"))


def has_phone(body: Column) -> Column:
    return body.rlike(PHONE_CORE) & body.rlike(PHONE)


def extract_emails(body: Column) -> Column:
    return _all(text_or_empty(body), EMAIL, "@")


def extract_amounts(body: Column) -> Column:
    """Dollar amounts as doubles, grouping commas dropped."""
    return F.transform(
        _all(text_or_empty(body), DOLLARS, "$", 1),
        lambda x: F.replace(x, F.lit(","), F.lit("")).cast("double"),
    )


def extract_anchors(body: Column) -> Column:
    """array<struct<href,text>> of the HTML anchors."""
    b = text_or_empty(body)
    return F.transform(
        F.arrays_zip(_all(b, ANCHOR, "</", 1).alias("href"), _all(b, ANCHOR, "</", 2).alias("text")),
        lambda a: F.struct(a["href"].alias("href"), trim_space(a["text"]).alias("text")),
    )


def build_raw_text(subject: Column, body: Column, anchors: Column,
                   max_chars: int | None = None, max_anchors: int | None = None) -> Column:
    """Subject line, body and the anchors written out again; the limits are optional."""
    anchors = F.coalesce(anchors, F.array().cast("array<struct<href:string,text:string>>"))
    text = text_or_empty(body)
    head = F.when(
        F.coalesce(subject, F.lit("")) != "", F.concat(F.lit("Subject: "), subject, F.lit("\n"))
    ).otherwise("")
    tail = F.array_join(F.transform(
        anchors if max_anchors is None else F.slice(anchors, 1, max_anchors),
        lambda a: F.concat(F.lit('\n<a href="'), a["href"], F.lit('">'), a["text"], F.lit("</a>")),
    ), "")
    return F.concat(
        head, text if max_chars is None else F.substr(text, F.lit(1), F.lit(max_chars)), tail)


def with_message_parts(df: DataFrame) -> DataFrame:
    """Add sender, reply_to, links, hosts, anchors and lower-cased texts.

    Needs ``body, from_hdr, reply_to, subject, auth_results``. Steps are stacked
    as projections so that shared parts are computed once.
    """
    texts = F.col("_anchors.text")
    df = df.withColumn("body", text_or_empty(F.col("body"))).withColumns({
        "_from": sender_text(F.col("from_hdr"), F.col("body")),
        "body_lower": F.lower("body"),
        "links": extract_links(F.col("body")),
        "_anchors": extract_anchors(F.col("body")),
        "reply_domain": F.when(F.coalesce(F.col("reply_to"), F.lit("")) != "",
                               parse_sender(F.col("reply_to"))["domain"]),
    }).withColumns({
        "subject_hay": F.concat(
            F.lower(text_or_empty(F.col("subject"))), F.lit("\n"), F.col("body_lower")),
        "sender": parse_sender(F.col("_from")),
        "link_hosts": F.array_compact(hosts_of_urls("links")),
        "_hrefs": hosts_of_urls("_anchors.href", ANY_HOST_SCHEMES),
        "_texts": hosts_of_urls("_anchors.text", ANY_HOST_SCHEMES),
    }).withColumns({
        "display_hay": F.concat(
            F.lower(F.col("sender.display_name")), F.lit("\n"), F.col("body_lower")),
        "anchor_hosts": F.zip_with(
            F.col("_hrefs"),
            F.zip_with(F.col("_texts"), texts, lambda h, t: F.coalesce(
                h, F.when(t.rlike(HOST_LIKE_TEXT), F.lower(t)))),
            lambda h, t: F.struct(strip_www(h).alias("href"), strip_www(t).alias("text")),
        ),
        "all_hosts": F.array_compact(F.concat(F.array("sender.domain"), F.col("link_hosts"))),
    })
    return settled(df.drop("_from", "_anchors", "_hrefs", "_texts"), [
        "sender", "reply_domain", "links", "link_hosts", "anchor_hosts", "all_hosts"])

"""Engine inputs derived from the driver tables, in Spark and as SQL text.

The driver tables hold no forms, e-mail headers, odd URLs or look-alike letters,
so each row is extended by a deterministic variation of itself. Every derived
table grows with its source table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from checks.seeds import sql_list


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf.rstrip('/')}/{name}.parquet")


def pick(items: list[str | None], key: str) -> Column:
    return F.element_at(F.array(*[F.lit(x).cast("string") for x in items]),
                        (F.col(key) % len(items) + 1).cast("int"))


def sql_pick(items: list[str | None], key: str) -> str:
    return f"{sql_list(items)}[{key} % {len(items)} + 1]"


# --- URLs -------------------------------------------------------------------
# The same expressions are valid in both SQL dialects: h = host as typed, p = rest.
URL_FORMS = [
    "url",
    "concat('https://user:pw@', h, ':8443', p)",
    "concat('http://', h, './')",
    "concat('HTTPS://WWW.', upper(h), p)",
    "concat('http://', replace(h, 'e', 'е'), p)",
    "concat('http://', translate(h, 'then', 'ｔｈｅｎ'), p)",
    "concat('http://xn--', h, p)",
    "concat('http://192.168.', CAST(page_id % 256 AS STRING), '.7/fr')",
    "concat('http://', CAST(3232235776 + page_id AS STRING), '/a')",
    "concat('http://0x7f.', CAST(page_id % 256 AS STRING), '/')",
    "concat('http://01', CAST(page_id % 8 AS STRING), '.0.0.1/')",
    "concat('http://999.1.1.', CAST(page_id AS STRING), '/')",
    "concat('http://', replace(h, '.', '_'), '.com/')",
    "concat('http://', h, ' x.com/')",
    "concat('ftp://', h, p)",
    "concat('https://a.b.c.d.', h, p)",
    "concat('https://one-two-three-', h, p)",
    "concat('https://', replace(h, '.example', '-x-y-z.example'), p)",
    "concat('https://', h, '.pay-portal.org', p)",
    "concat('https://', substr(h, 2), p)",
    "concat('https://', h, 'm', p)",
    "concat('http://', h, chr(92), 'fr')",
    "concat('http://', h, ':99999', p)",
    "concat('http://[::', CAST(page_id % 10 AS STRING), ']/a')",
    "concat('http://', replace(h, 'th', '%74h'), p)",
    "concat('  ', url)",
    "concat('https://théo-', h, p)",
]


def urls(spark: SparkSession, sf: str) -> DataFrame:
    """(row_id, page_id, url): every page URL in every form."""
    base = table(spark, sf, "pages").select(
        "page_id", "url",
        F.regexp_extract("url", "^https?://([^/]+)", 1).alias("h"),
        F.regexp_extract("url", "^https?://[^/]+(.*)$", 1).alias("p"))
    forms = F.array(*[F.expr(x) for x in URL_FORMS])
    return base.select("page_id", F.posexplode(forms).alias("form", "url")).select(
        (F.col("page_id") * 100 + F.col("form")).alias("row_id"), "page_id", "url")


URLS_SQL = f"""urls AS (
    SELECT page_id * 100 + form AS row_id, page_id, url FROM (
        SELECT page_id, UNNEST(range(0, {len(URL_FORMS)})) AS form,
               UNNEST([{', '.join(URL_FORMS)}]) AS url
        FROM (SELECT page_id, url, regexp_extract(url, '^https?://([^/]+)', 1) AS h,
                     regexp_extract(url, '^https?://[^/]+(.*)$', 1) AS p FROM pages)))"""


def page_urls(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "pages").select(F.col("page_id").alias("row_id"), "page_id", "url")


PAGE_URLS_SQL = "urls AS (SELECT page_id AS row_id, page_id, url FROM pages)"


# --- navigation ---------------------------------------------------------------

def nav(spark: SparkSession, sf: str) -> DataFrame:
    """(event_id, session_id, ts, url): page views pointed at pages."""
    pages = table(spark, sf, "pages").select("page_id", "url")
    n = pages.count()
    views = table(spark, sf, "events").filter("event_type = 'view'").select(
        "event_id", F.col("user_id").alias("session_id"), F.col("ts").cast("timestamp").alias("ts"),
        (F.col("event_id") % n).alias("page_id"))
    return views.join(pages, "page_id").select("event_id", "session_id", "ts", "url")


NAV_SQL = """nav AS (
    SELECT event_id, user_id AS session_id, ts, url FROM (
        SELECT *, event_id % (SELECT count(*) FROM pages) AS page_id
        FROM events WHERE event_type = 'view') e JOIN pages USING (page_id))"""


# --- messages -------------------------------------------------------------------
SNIPPETS = [
    "",
    "Pay now with a gift card or wire transfer. Call 1-800-555-0142.",
    "See https://ththen.example.com/a and https://thther.example.org/x).",
    "Invoice total $450 call (416) 555-0134 today. http://192.168.4.7/pay",
    "Owed $1,250.50 or $5000 see http://3232235777/x",
    "Statement attached: statement.exe open it",
    "password-protected zip inside the mail, read report.scr.",
    'Visit <a href="https://evil.example.com/x">thther.example.org</a> now',
    'Visit <a href="https://www.thther.example.org/x">thther.example.org</a> now',
    '<form action="x"><input name=a></form> id 123-456-789 ok',
    "write to Someone.Else@GMAIL.com or helper@yahoo.ca",
    "claims from token desk and Thther  Bank https://ththem.example.com/l",
    "https://ththen.example.com.pay.example.org/x parcel desk",
    'From: "Late Line" <late@ththan.example.net>',
    "ids 123456789 and 1234567890 costs $199",
    "therin.example.net is named here, MIT license",
    "https://user:pw@thther.example.org/ https://ththan.example.com",
]
FROMS = [
    None,
    "User <user@mail1.example.com>",
    '"Token Desk" <pay@gmail.com>',
    "xkqzvbtrwpl@bqzxkjvw.test999.me.biz.id",
    "Bank <no-reply@thther.example.org>",
    "notice@ththan.example.com",
    "'Joe' joe@x.example@y.com hi",
    "no address here",
    "Help <help@ththem.example.com>",
    "a@a.b.c.d.example.com",
    "Someone.Else@GMAIL.com",
]
SUBJECTS = [None, "Your license", "gift card inside", "Hello", ""]
REPLY_TO = [None, "r@mail1.example.com", "X <x@gmail.com>", ""]
AUTH = [None, "spf=pass", "dkim = fail"]


def messages(spark: SparkSession, sf: str) -> DataFrame:
    """(msg_id, body, from_hdr, reply_to, subject, auth_results) from documents."""
    return table(spark, sf, "documents").select(
        F.col("doc_id").alias("msg_id"),
        F.concat("text", F.lit("\n"), pick(SNIPPETS, "doc_id")).alias("body"),
        pick(FROMS, "doc_id").alias("from_hdr"), pick(REPLY_TO, "doc_id").alias("reply_to"),
        pick(SUBJECTS, "doc_id").alias("subject"), pick(AUTH, "doc_id").alias("auth_results"))


MESSAGES_SQL = f"""messages AS (
    SELECT doc_id AS msg_id, concat(text, chr(10), {sql_pick(SNIPPETS, 'doc_id')}) AS body,
           {sql_pick(FROMS, 'doc_id')} AS from_hdr, {sql_pick(REPLY_TO, 'doc_id')} AS reply_to,
           {sql_pick(SUBJECTS, 'doc_id')} AS subject, {sql_pick(AUTH, 'doc_id')} AS auth_results
    FROM documents)"""


# --- pages with forms -------------------------------------------------------------
FORMS = [
    "",
    '<form><label for="f1">Social  number</label><input id="f1" name="q1"></form>',
    '<form><label>Enter <b>CVV</b> <input name="c" autocomplete="CC-CSC" placeholder="code"></label></form>',
    '<form><input type="password"><input type="hidden"></form>',
    '<form><input type="PASSWORD" name="pw"><select id="s"><option>a</option></select></form>',
    '<form><textarea name="casino" placeholder="casino">x</textarea></form>',
    "<form>" + "<input>" * 79 + '<input name="a79"><input name="cvv"></form>',
]
# name|id|placeholder|type|autocomplete|label per kept field
FORM_FIELDS = [
    "", "q1|f1||text||Social number", "c||code|text|cc-csc|Enter CVV", "",
    "pw|||password||;|s||select-one||", "casino||casino|textarea||", "a79|||text||;cvv|||text||",
]


def pages_with_forms(spark: SparkSession, sf: str) -> DataFrame:
    """(page_id, url, html): every page with a meta description and a form."""
    html = F.replace(
        F.replace(F.col("html"), F.lit("</article>"),
                  F.concat(pick(FORMS, "page_id"), F.lit("</article>"))),
        F.lit("<title>"),
        F.concat(F.lit('<meta name="description" content="About page '),
                 F.col("page_id").cast("string"), F.lit('"><title>')))
    return table(spark, sf, "pages").select("page_id", "url", html.alias("html"))


FORMS_SQL = f"""forms AS (
    SELECT page_id, url, replace(replace(html, '</article>', concat(
        {sql_pick(FORMS, 'page_id')}, '</article>')), '<title>', concat(
        '<meta name="description" content="About page ', page_id, '"><title>')) AS html
    FROM pages)"""

# text of a page as SQL: body only, comments out, blocks on own lines, entities resolved
_BLOCKS = "p|li|ul|nav|div|article|h1|footer|body|html|form|option|br"
FEATURES_SQL = rf"""{FORMS_SQL},
stripped AS (
    SELECT page_id, url, html,
        regexp_replace(regexp_replace(regexp_replace(regexp_replace(
            regexp_replace(html, '(?s)^.*<body>', ''), '(?s)<!--.*?-->', '', 'g'),
            '[ \t\n\r\f]+', ' ', 'g'),
            '(?i)</?({_BLOCKS})( [^>]*)?>', chr(10), 'g'), '<[^>]*>', '', 'g') AS t
    FROM forms),
features AS (
    SELECT page_id, url, coalesce(regexp_matches(url, '^https:'), FALSE) AS is_https,
        (trim(regexp_replace(replace(replace(regexp_extract(html, '<title>([^<]*)</title>', 1),
            '&quot;', '"'), '&amp;', '&'), '[ \t\n\r\f]+', ' ', 'g'))) AS title,
        concat('About page ', page_id) AS meta_description,
        (trim(regexp_replace(regexp_replace(
            replace(replace(replace(replace(t, '&copy;', '©'), '&middot;', '·'), '&quot;', '"'),
            '&amp;', '&'), ' +', ' ', 'g'), ' *\n[ \n]*', chr(10), 'g'), concat(' ', chr(10)))) AS text,
        {sql_pick(FORM_FIELDS, 'page_id')} AS field_text,
        page_id % {len(FORMS)} AS form
    FROM stripped)"""


"""Host extraction and features on odd URLs."""

import random

import pytest
from pyspark.sql import functions as F

from phishlake.functions import hosts as H
from phishlake.functions import reputation as R
from phishlake.functions.punycode import ascii_label

# url, raw host, host, failed, path
URLS = [
    ("https://user:pw@evil.test:8443/x", "user", "evil.test", False, "/x"),
    ("http://bank.test./", "bank.test.", "bank.test.", False, "/"),
    ("https://WWW.Bank.Test", "bank.test", "bank.test", False, "/"),
    ("http://2130706433/", "2130706433", "127.0.0.1", False, "/"),
    ("http://0x7f.1/", "0x7f.1", "127.0.0.1", False, "/"),
    ("http://010.0.0.1/a", "010.0.0.1", "8.0.0.1", False, "/a"),
    ("http://999.1.1.1/", "999.1.1.1", "999.1.1.1", True, ""),
    ("http://4294967296/", "4294967296", "4294967296", True, ""),
    ("http://1.2.3.4.5/", "1.2.3.4.5", "1.2.3.4.5", True, ""),
    ("http://[::1]/a", "", "[::1]", False, "/a"),
    ("https://a_b.test/", "a_b.test", "a_b.test", False, "/"),
    ("http://ev il.test/x", "ev il.test", "ev il.test", True, ""),
    ("https://bаnk.test", "bаnk.test", "xn--bnk-6cd.test", False, "/"),
    ("http://ｂａｎｋ.test/", "ｂａｎｋ.test", "bank.test", False, "/"),
    ("http://bank.test:99999/", "bank.test", "bank.test", True, ""),
    ("http://b%61nk.test/", "b%61nk.test", "bank.test", False, "/"),
    ("http://bank.test\\x", "bank.test\\x", "bank.test", False, "/x"),
]


def test_hosts_of_odd_urls(spark):
    df = H.with_hosts(spark.createDataFrame([(u[0],) for u in URLS], "url string"))
    got = {r.url: (r.raw_host, r.host, r.idna_failed, r.path) for r in df.collect()}
    for url, *want in URLS:
        assert got[url] == tuple(want), url


def test_array_form_equals_column_form(spark):
    df = spark.createDataFrame([([u[0] for u in URLS],)], "urls array<string>")
    arr = df.select(H.hosts_of_urls("urls").alias("h")).collect()[0].h
    one = H.with_canonical_host(spark.createDataFrame([(u[0],) for u in URLS], "url string"), "url", "h")
    assert arr == [r.h for r in one.collect()]


@pytest.mark.parametrize("url", ["ftp://bank.test", "mailto:a@b", "", None, "https://", "  http://bank.test"])
def test_other_input_is_not_a_web_url_or_has_no_host(spark, url):
    r = H.with_hosts(spark.createDataFrame([(url,)], "url string")).collect()[0]
    assert not (r.is_web and r.host)


@pytest.mark.parametrize("host,n", [
    ("one-two-three-four.test", 3), ("a.b.c.d.shop.test", 0), ("a-b.c-d.shop.co.test", 2), ("shop-a-b.co.test", 2)])
def test_hyphens_count_inside_labels_only(spark, host, n):
    assert spark.range(1).select(H.hyphen_count(F.lit(host))).collect()[0][0] == n


def test_fold_and_lookalike(spark):
    pairs = [("bаnk.test", "bank.test", True), ("ＢＡＮＫ.test", "bank.test", True),
             ("bank.test", "other.test", False), ("bnk.tst", "bank.test", True)]
    df = spark.createDataFrame(pairs, "a string, b string, want boolean")
    for r in df.withColumn("got", H.is_lookalike(F.col("a"), F.col("b"))).collect():
        assert r.got == r.want, r.a
    row = spark.range(1).select(H.edit_distance(F.lit(""), F.lit("abc")).alias("x"),
                                H.edit_distance(F.lit("sunday"), F.lit("saturday")).alias("y")).collect()[0]
    assert (row.x, row.y) == (3, 3)


def test_risky_endings_and_gov_words_are_plain_substrings(spark):
    rows = [("shop.xyz", "/", True, False), ("democracy.test", "/", False, True),
            ("shop.gc.ca", "/cra", False, False), ("shop.test", "/my/rcmp-page", False, True)]
    df = spark.createDataFrame(rows, "host string, path string, tld boolean, gov boolean")
    for r in df.withColumn("t", H.has_risky_tld(F.col("host"))).withColumn(
            "g", H.has_fake_gov(F.col("host"), F.col("path"))).collect():
        assert (r.t, r.g) == (r.tld, r.gov), r.host


@pytest.mark.parametrize("host,labels,abused,mixed,random", [
    ("mail.news.shop.test", 4, False, False, False),
    ("a.b.c.d.zxqvbkrt.biz.id", 7, True, False, True),
    ("shop12345.test", 2, False, True, False),
    ("lightweights.test", 2, False, False, False),
])
def test_sender_host_shape(spark, host, labels, abused, mixed, random):
    h = F.lit(host)
    r = spark.range(1).select(R.label_count(h), R.has_abused_suffix(h), R.has_digit_mixed_label(h),
                              R.has_gibberish_label(h)).collect()[0]
    assert tuple(r) == (labels, abused, mixed, random)


def test_role_mailboxes_are_never_random(spark):
    df = spark.createDataFrame([("xkqzvbtrwpl", True), ("noreplyxkqzvb", False), ("short", False),
                                (None, False), ("mariefournier", False)], "m string, want boolean")
    for r in df.withColumn("got", R.is_random_local_part(F.col("m"))).collect():
        assert r.got == r.want, r.m


def test_labels_equal_the_codec(spark):
    rng = random.Random(4)
    letters = "ab-9éüñправда中文한أ😀ß"
    labels = ["правда", "россия", "bаnk", "théo-x", "münchen", "中文", "é", "😀", "ａ中"] + [
        "".join(rng.choice(letters) for _ in range(rng.randint(1, 14))) for _ in range(200)]
    labels = [x.lower() for x in labels if not x.isascii()]
    got = spark.createDataFrame([(x,) for x in labels], "x string").select(
        "x", F.expr(ascii_label("x")).alias("y")).collect()
    assert {r.x: r.y for r in got} == {x: "xn--" + x.encode("punycode").decode() for x in labels}

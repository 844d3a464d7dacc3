"""Joins with lists: large and skewed paths give the same rows as the plain ones."""

import random

import pytest
from pyspark.sql import functions as F

from checks import seeds
from phishlake.functions.hosts import fold_lookalikes
from phishlake.operators import lookups as L
from phishlake.operators import term_join
from phishlake.operators.asof import asof_ttl_join
from phishlake.operators.lookalike import candidates, lookalike_pairs
from phishlake.operators.neighbours import with_neighbour
from phishlake.plans.url_job import score_urls
from phishlake.sources.lists import allow_table, block_table

SCHEMA = "domain string, name string, official_url string, high_value boolean, ord int"


def _big(spark):
    """The seed lists forced onto the path for lists that are too large to broadcast."""
    allow = allow_table(spark.createDataFrame(list(seeds.ALLOW), SCHEMA), local_rows=0, broadcast_rows=0)
    block = block_table(spark.createDataFrame([(d,) for d in seeds.BLOCK], "domain string"),
                        local_rows=0, broadcast_rows=0)
    assert not allow.small and not block.small
    return allow, block


def _pages(spark):
    return spark.read.parquet("/root/testdata/sf0.001/pages.parquet").select("page_id", "url")


def test_large_lists_give_the_same_verdicts(spark):
    small = score_urls(_pages(spark), seeds.allow_list(spark), seeds.block_list(spark), seeds.URL_CONFIG)
    large = score_urls(_pages(spark), *_big(spark), seeds.URL_CONFIG)
    assert sorted(small.collect()) == sorted(large.collect())


def test_large_list_plan_does_not_broadcast_the_list(spark):
    allow, _ = _big(spark)
    df = L.longest_suffix_join(_pages(spark).withColumn("host", F.lit("a.b")), "host", allow, "m")
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    # the only broadcast hints are those of the bounded hot-key tables
    assert plan.count("strategy=broadcast") == 2 * len(allow.depths)


def test_salted_join_equals_plain_join_when_one_key_is_hot(spark):
    big = spark.range(20_000).withColumn("k", F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id") % 50))
    dim = spark.range(40).select(F.col("id").alias("k"), (F.col("id") * 10).alias("v"))
    hot = L.hot_keys(big, ["k"], rows_per_salt=1_000)
    assert [r.k for r in hot.collect()] == [0]
    for how in ("left", "inner"):
        got = L.salted_join(big, dim, ["k"], hot=hot, how=how)
        assert sorted(got.select("id", "k", "v").collect()) == sorted(big.join(dim, "k", how).select("id", "k", "v").collect())
    salted = L.salted_join(big, dim, ["k"], hot=hot)
    assert "_salt" not in salted.columns


def test_salts_follow_the_row_count(spark):
    df = spark.range(1000).withColumn("k", F.when(F.col("id") < 600, 1).when(F.col("id") < 800, F.lit(None)).otherwise(F.col("id")))
    assert [tuple(r) for r in L.hot_keys(df, ["k"], rows_per_salt=100).collect()] == [(1, 6)]


def test_null_keys_are_spread_and_match_nothing(spark):
    big = spark.range(500).withColumn("k", F.when(F.col("id") % 2 == 0, F.lit(None)).otherwise(F.col("id") % 5))
    dim = spark.createDataFrame([(1, 10), (None, 20)], "k long, v int")
    got = L.salted_join(big, dim, ["k"])
    assert got.count() == 500 and got.where("k is null and v is not null").count() == 0
    assert got.where("v = 10").count() == big.where("k = 1").count()


def test_piece_keys_find_every_close_pair(spark):
    rng = random.Random(5)
    letters = "abcrn.-"
    targets = ["".join(rng.choice(letters) for _ in range(rng.randint(1, 9))) for _ in range(60)]
    targets = list(dict.fromkeys(targets))

    def mutate(s):
        s = list(s)
        for _ in range(rng.randint(0, 3)):
            op, at = rng.randint(0, 2), rng.randint(0, len(s))
            if op == 0:
                s.insert(at, rng.choice(letters))
            elif s and op == 1:
                s.pop(min(at, len(s) - 1))
            elif s:
                s[min(at, len(s) - 1)] = rng.choice(letters)
        return "".join(s)

    hosts = sorted({mutate(rng.choice(targets)) for _ in range(1500)} - {""})
    table = allow_table(spark.createDataFrame([(t, t, None, True, i) for i, t in enumerate(targets)], SCHEMA))
    h = spark.createDataFrame([(x,) for x in hosts], "raw_host string")
    got = {(r.raw_host, r.ord) for r in lookalike_pairs(h, "raw_host", table).collect()}
    t = table.df.select(F.col("domain"), "ord")
    brute = h.crossJoin(t).filter(
        (F.col("raw_host") != F.col("domain"))
        & (F.levenshtein(fold_lookalikes(F.col("raw_host")), fold_lookalikes(F.col("domain"))) <= 2))
    assert got == {(r.raw_host, r.ord) for r in brute.collect()}
    assert len(got) > 500


@pytest.mark.parametrize("endings", [[".com"], [".com", ".ca", ".co.uk", ".gov.au", ".example"]])
def test_common_endings_find_few_candidates(spark, endings):
    """Unrelated names under the same endings: under one pair in a hundred reaches the edit-distance test."""
    rng = random.Random(9)

    def names(n):
        return sorted({"".join(rng.choice("abcdefghiklmnoprstuvy") for _ in range(rng.randint(7, 13))) + rng.choice(endings)
                       for _ in range(n)})
    targets, hosts = names(2000), names(2000)
    close = [t.replace(t[2], "x", 1) for t in targets[:300]]
    table = allow_table(spark.createDataFrame([(t, t, None, True, i) for i, t in enumerate(targets)], SCHEMA))
    h = spark.createDataFrame([(x,) for x in {*hosts, *close}], "raw_host string")
    found = candidates(h, "raw_host", table).where("ord is not null").count()
    assert found < 0.005 * len(targets) * len(hosts)
    assert lookalike_pairs(h, "raw_host", table).select("raw_host").distinct().count() >= 300


def test_last_duplicate_of_a_domain_wins(spark):
    rows = [("Bank.test", "old", None, True, 0), ("bank.test", "new", "https://bank.test/", False, 1)]
    table = allow_table(spark.createDataFrame(rows, SCHEMA))
    assert [(r.name, r.high_value) for r in table.rows] == [("new", False)]


def test_longest_listed_parent_wins(spark):
    rows = [("test", "t", None, False, 0), ("bank.test", "b", None, False, 1), ("a.bank.test", "a", None, False, 2)]
    table = allow_table(spark.createDataFrame(rows, SCHEMA))
    df = spark.createDataFrame([("x.a.bank.test",), ("bank.test",), ("xbank.test",), ("other",)], "host string")
    got = {r.host: r.m and r.m.name for r in L.longest_suffix_join(df, "host", table, "m", ["name"]).collect()}
    assert got == {"x.a.bank.test": "a", "bank.test": "b", "xbank.test": "t", "other": None}


def test_neighbour_across_buckets_equals_plain_window(spark):
    from pyspark.sql import Window as W
    rng = random.Random(3)
    rows = [(i, rng.randint(0, 2), rng.randint(0, 40_000)) for i in range(500)]
    df = spark.createDataFrame(rows, "id int, k int, s int").withColumn("ts", F.timestamp_seconds("s"))
    w = W.partitionBy("k").orderBy("ts", "id")
    for ahead, fn in ((True, F.lead), (False, F.lag)):
        got = with_neighbour(df, ["k"], "ts", ["id"], "n", ahead=ahead, tie=["id"], bucket_seconds=600)
        want = df.withColumn("n", fn("id").over(w))
        assert sorted((r.id, r.n and r.n.id) for r in got.collect()) == sorted((r.id, r.n) for r in want.collect())


def test_asof_expiry_is_strict_and_null_lives_an_hour(spark):
    snaps = spark.createDataFrame([("h", 5, 1000), ("h", None, 700_000)], "key string, value int, s int").select(
        "key", "value", F.timestamp_seconds("s").alias("fetched_at"))
    times = [999, 1000, 1000 + 604_799, 1000 + 604_800, 700_000, 703_599, 703_600]
    events = spark.createDataFrame([(i, s) for i, s in enumerate(times)], "id int, s long").select(
        "id", F.lit("h").alias("key"), F.timestamp_seconds("s").alias("ts"))
    out = asof_ttl_join(events, snaps, "key", "ts", "value", 604_800, 3_600, "v").orderBy("id").collect()
    assert [(r.v, r.v_known) for r in out] == [
        (None, False), (5, True), (5, True), (None, False), (None, True), (None, True), (None, False)]


@pytest.mark.parametrize(("local", "broadcast"), [(L.LOCAL_ROWS, L.BROADCAST_ROWS), (0, L.BROADCAST_ROWS), (0, 0)])
def test_term_dictionary_join_on_edges(spark, monkeypatch, local, broadcast):
    monkeypatch.setattr(term_join, "LOCAL_ROWS", local)
    monkeypatch.setattr(term_join, "BROADCAST_ROWS", broadcast)
    texts = spark.createDataFrame([
        (1, "tax  refund"), (2, "a taxi refund"), (3, "écra"), (4, "GST/HST refund!"), (5, "d’impôt dû"),
        (6, "pay now"), (7, "§ 5")], "id int, text string")
    terms = spark.createDataFrame([
        ("g", "Tax refund"), ("g", "CRA"), ("g", "gst/hst refund"), ("g", "d’impôt"), ("g", "pay now"),
        ("g", "§"), ("g", "tax"), ("g", "tax")], "group string, term string")
    got = {(r.id, r.term) for r in term_join.term_hits(texts, "id", "text", terms).collect()}
    assert got == {(1, "Tax refund"), (1, "tax"), (3, "CRA"), (4, "gst/hst refund"), (5, "d’impôt"),
                   (6, "pay now"), (7, "§")}


@pytest.mark.parametrize("local", [L.LOCAL_ROWS, 0])
def test_term_hits_stay_with_their_row(spark, monkeypatch, local):
    monkeypatch.setattr(term_join, "LOCAL_ROWS", local)
    texts = spark.createDataFrame(
        [(1, "tax é"), (1, "none"), (1, "tax é"), (None, "tax"), (None, "$$$ due"), (2, None), (3, "éé x")], "id int, text string")
    terms = spark.createDataFrame([("g", "tax"), ("g", "é"), ("g", "$$$")], "group string, term string")
    got = sorted(((r.id, r.term) for r in term_join.term_hits(texts, "id", "text", terms).collect()), key=repr)
    want = [(1, "tax"), (1, "é"), (1, "tax"), (1, "é"), (None, "tax"), (None, "$$$"), (3, "é")]
    assert got == sorted(want, key=repr)


def test_enrichment_reads_its_inputs_once(spark):
    """Rows once for each branch, each snapshot table once, and the few hot keys."""
    from checks.page_checks import e01, e05, e06
    for query, most in ((e01, 6), (e05, 8), (e06, 8)):
        plan = query(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
        assert plan.count("Scan parquet") <= most

"""Whole verdicts on small inputs of our own."""

import gc
import time
import tracemalloc

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from checks import seeds
from checks.inputs import messages
from checks.page_checks import c04
from phishlake.functions import bands
from phishlake.operators.lookups import ListTable
from phishlake.operators.rules import PREDICATES, is_structural
from phishlake.plans import combine as CB
from phishlake.plans.enrich import domain_age_days, phish_answer
from phishlake.plans.message_job import (
    MessageConfig, score_messages, with_predicate_inputs,
)
from phishlake.plans.page_job import PageConfig, score_pages
from phishlake.plans.url_job import score_urls
from phishlake.sources import html_features
from phishlake.sources.html_features import BROWSER_LIMITS, extract_mail, extract_page_features, page_features
from phishlake.sources.lists import (
    Category, Org, Rule, allow_table, block_table, clean_user_lists, load_list, refresh_lists,
    rules_of, validate_lists,
)

ALLOW = [("maplebank.test", "Maple Bank", "https://maplebank.test/", True, 0),
         ("maplebank.tesst", "Maple Too", None, True, 1), ("tax.gov.test", "Tax Office", None, False, 2),
         ("gov.test", "Government", None, False, 3)]
CATS = [
    Category("impersonation_terms", 15, 45, terms=("CRA", "tax refund"), terms_fr=("remboursement d’impôt",)),
    Category("payment_red_flags", 30, 60, terms=("gift card",), terms_fr=("carte-cadeau",)),
    Category("credential_harvesting", 25, structural=True, sin_terms=("sin", "social insurance"),
             cvv_terms=("cvv",)),
]
FEATURES = ("title string, meta_description string, text string, is_https boolean, url string, fields "
            "array<struct<name:string,id:string,placeholder:string,type:string,autocomplete:string,label_text:string>>")


def lists(spark):
    schema = "domain string, name string, official_url string, high_value boolean, ord int"
    return (allow_table(spark.createDataFrame(ALLOW, schema)),
            block_table(spark.createDataFrame([("bad.test",)], "domain string")))


URL_CASES = [
    ("https://www.maplebank.test/login", "safe", "allow_listed"),
    ("https://my.tax.gov.test", "safe", "allow_listed"),
    ("https://deep.bad.test/x", "high", "known_bad"),
    ("https://mаplebаnk.test/", "high", "lookalike_domain,many_hyphens,encoded_host"),
    ("https://maplebonk.test/", "medium", "lookalike_domain"),
    ("https://tax.gov.test.pay.xyz/", "medium", "risky_tld,subdomain_spoof"),
    ("https://tax.governing.test/", "safe", ""),
    ("https://10.0.0.1/cra-login", "high", "fake_government,ip_host"),
    ("https://cra-tax-pay-now.top", "high", "fake_government,risky_tld,many_hyphens"),
    ("https://a.b.c.d.shop.test", "safe", ""),
    ("ftp://bad.test", "safe", ""), ("", "safe", ""), (None, "safe", ""),
]


def test_url_verdicts(spark):
    df = spark.createDataFrame([(i, c[0]) for i, c in enumerate(URL_CASES)], "id int, url string")
    for r in score_urls(df, *lists(spark)).collect():
        url, verdict, reason = URL_CASES[r.id]
        assert (r.verdict, ",".join(r.reasons)) == (verdict, reason), url


def test_url_rows_scores_and_names(spark):
    df = spark.createDataFrame([(i, u) for i, u in enumerate(
        ["https://maplebonk.test/"] * 3 + ["https://maplebank.test", "https://bad.test", "x", None])],
        "id int, url string")
    rows = sorted(score_urls(df, *lists(spark)).collect())
    assert len(rows) == 7 and all(0 <= r.score <= 100 for r in rows)
    assert rows[0].institution_name == "Maple Bank" and rows[3].official_url == "https://maplebank.test/"


def test_user_lists_come_first_and_allow_beats_block(spark):
    raw = spark.createDataFrame([("t", "block", "https://www.maplebank.test/x"), ("t", "allow", "deep.bad.test"),
                                 ("t", "block", "bad.test"), ("t", "allow", "no dots")],
                                "tenant string, kind string, entry string")
    own = ListTable(clean_user_lists(raw))
    assert len(own.rows) == 3
    df = spark.createDataFrame([(1, "t", "https://maplebank.test"), (2, "t", "https://deep.bad.test"),
                                (3, "u", "https://deep.bad.test")], "id int, tenant string, url string")
    got = {r.id: (r.score, r.reasons[0]) for r in score_urls(df, *lists(spark), user_lists=own).collect()}
    assert got == {1: (100, "user_blocked"), 2: (0, "user_allowed"), 3: (100, "known_bad")}


def page(spark, config=PageConfig(), cats=CATS, **kw):
    base = dict(title="", meta_description="", text="", is_https=True, url="https://shop.test", fields=[])
    df = spark.createDataFrame([tuple({**base, **kw}.values())], FEATURES)
    return score_pages(df, cats, config).collect()[0]


def field(**kw):
    keys = ("name", "id", "placeholder", "type", "autocomplete", "label_text")
    return tuple(kw.get(k) for k in keys)


def test_page_terms(spark):
    r = page(spark, title="CRA page", text="your tax  refund: buy a gift card")
    assert (r.content_score, r.content_verdict) == (60, "medium")
    assert r.categories_hit == ["impersonation_terms", "payment_red_flags"]
    assert page(spark, text="the crap hit, what a casino").content_score == 0
    french = page(spark, text="votre remboursement d’impôt par carte-cadeau")
    assert french.content_score == 45
    assert page(spark, text="écra").content_score == 15


def test_page_fields(spark):
    sin = [field(name="x", label_text="Social  Insurance number")]
    assert page(spark, fields=sin).content_score == 25
    assert page(spark, fields=sin, config=PageConfig(check_national_id=False)).content_score == 0
    assert page(spark, fields=sin, url="https://my.canada.ca/x").content_score == 0
    assert page(spark, fields=sin, url="not a url").content_score == 25
    assert page(spark, fields=[field(name="casino")]).content_score == 0
    pw = [field(type="password"), field(type="PASSWORD")]
    assert page(spark, fields=pw, is_https=False).content_reasons == ["password_over_http"]
    assert page(spark, fields=pw).content_score == 0
    cvv = [field(autocomplete="cc-csc")]
    assert page(spark, fields=cvv).categories_hit == ["credential_harvesting"]
    assert page(spark, fields=[field(name="cvv")], url="https://js.stripe.com/x").content_score == 0
    assert page(spark, fields=cvv, cats=[], is_https=None).content_score == 25
    assert page(spark, fields=None).content_score == 0


def test_hostile_nesting_is_read_in_linear_time():
    """Stray ends, deep nesting and one label around many fields: ten times the page, about ten times the time."""
    def took(n):
        pages = ("<div>" * n + "</span>" * n, "<div>" * n + "<input name=a>" * n, "<label>all" + "<b>x</b>" * n + "<input name=a>" * n)
        start = time.process_time()
        fields = [len(page_features(p)["fields"]) for p in pages]
        assert fields == [0, n, n]
        return time.process_time() - start
    took(500)
    assert took(10_000) < 40 * took(1_000) + 0.5
    f = page_features("<label>L<p><b>x</label><input id=1><label for=1>one</label></p><label></i>in<span><input name=q></span></label></b>")
    assert [(x["id"], x["label_text"]) for x in f["fields"]] == [("1", "one"), ("", "in")]


def test_pages_are_read_in_bounded_slices(spark, monkeypatch):
    """A tree goes with its row, texts become Python strings slice by slice, and the rows stay the same."""
    page = '<body><label>L <input name=a></label><p>one</p></body>'
    gc.collect()
    gc.disable()
    try:
        page_features(page * 50)
        assert gc.collect() == 0  # nothing waits for the collector
    finally:
        gc.enable()
    batch = pa.RecordBatch.from_pydict({"html": ["x" * 10, None, "y" * 70, "", "z" * 30, "w" * 200]})
    monkeypatch.setattr(html_features, "SLICE_BYTES", 60)
    parts = [x.column("html").to_pylist() for x in html_features._slices([batch, batch.slice(0, 0)], "html")]
    assert [len(x) for x in parts] == [2, 1, 2, 1] and sum(parts, []) == batch.column("html").to_pylist()
    rows = [(None, "u", "one", page), (2**53 + 1, None, "one", "<h2 class=hP>S</h2><div class=a3s>t</div>"), (3, "u", None, None)]
    df = spark.createDataFrame(rows, "id long, url string, provider string, html string").coalesce(1)
    got = {r.id: (r.url, r.text, len(r.fields)) for r in extract_page_features(df, "id").collect()}
    assert got == {None: ("u", "L\none", 1), 2**53 + 1: (None, "S\nt", 0), 3: ("u", "", 0)}
    assert [(r.id, r.subject, r.body, r.anchors) for r in extract_mail(df, "id").collect()] == [(2**53 + 1, "S", "\nt", [])]
    assert extract_mail(df.where("false"), "id").count() == extract_page_features(df.where("false"), "id").count() == 0


def test_python_memory_of_page_categories_does_not_grow_with_the_rows(spark, tmp_path, monkeypatch):
    """Ten times the pages in an Arrow batch: the Python objects of c04_categories_hit's one Python step stay as few."""
    page = "<title>t</title><body>" + "<p>one <b>two</b></p>" * 60 + "<article></article></body>"
    spark.createDataFrame([(k, "http://a.example.org/", page) for k in (0, 1)], "page_id long, url string, html string"
                          ).write.parquet(f"{tmp_path}/pages.parquet")
    steps, frame = [], type(spark.range(1))
    plain = frame.mapInArrow
    monkeypatch.setattr(frame, "mapInArrow", lambda self, f, *a, **b: (steps.append(f), plain(self, f, *a, **b))[1])
    assert sorted(c04(spark, str(tmp_path)).collect()) == [(0, ""), (1, "forms")]
    monkeypatch.setattr(html_features, "SLICE_BYTES", 10 * len(page))

    def peak(n):
        batch = pa.RecordBatch.from_pydict({"page_id": list(range(n)), "url": ["u"] * n, "html": [page] * n})
        gc.collect()
        tracemalloc.start()
        try:
            ids = [k for out in steps[0](iter([batch])) for k in out.column("page_id").to_pylist()]
            return tracemalloc.get_traced_memory()[1], ids == list(range(n))
        finally:
            tracemalloc.stop()

    assert len(steps) == 1
    (few, whole), (many, all_of_it) = peak(50), peak(500)
    assert whole and all_of_it and many < 1.5 * few


def test_page_features_of_html():
    f = page_features('<html><head><title> A &amp;\n B </title><meta name="description" content="M"></head><body>'
                      '<p>one<script>x<p></script> two<p>three<br>four<label for=q>Your <i>code</i></label>'
                      '<input id=q><label>Wrap <select name=s multiple></select></label><input type=hidden>'
                      '<textarea name=t><b>x</b></textarea></body></html>')
    assert (f["title"], f["meta_description"]) == ("A & B", "M")
    assert f["text"].split("\n")[:3] == ["one two", "three", "fourYour codeWrap <b>x</b>"[:4] + "Your codeWrap <b>x</b>"]
    assert [(x["id"], x["name"], x["type"], x["label_text"]) for x in f["fields"]] == [
        ("q", "", "text", "Your code"), ("", "s", "select-multiple", "Wrap"), ("", "t", "textarea", "")]
    many = page_features("<input>" * 79 + "<input name=a><input name=b>")
    assert [x["name"] for x in many["fields"]] == ["a", "b"]
    cut = page_features("<input>" * 79 + "<input name=a><input name=b><p>" + "x" * 40_000, BROWSER_LIMITS)
    assert [x["name"] for x in cut["fields"]] == ["a"] and len(cut["text"]) == 30_000
    page_features('<a "' * 50_000 + "<!--" * 20_000 + "<script>" * 20_000)  # linear, or this never ends
    assert page_features("")["text"] == "" and page_features("<div <<>>")["fields"] == []


ORGS = [Org("maple", "Maple Bank", ("Maple Bank", "MB"), ("maplebank.test",), "https://maplebank.test/c", None),
        Org("post", None, ("Parcel Post",), ("post.test",), None, "555-0100")]


def mail(spark, rules, body="", from_hdr=None, subject=None, reply_to=None, auth=None, **kw):
    df = spark.createDataFrame([(1, body, from_hdr, reply_to, subject, auth)],
                               "msg_id int, body string, from_hdr string, reply_to string, subject string, auth_results string")
    return score_messages(df, lists(spark)[0], ORGS, rules, MessageConfig(auth_checks=True, **kw)).collect()[0]


def ids(r):
    return [x.id for x in r.fired_rules]


CASES = [
    ({}, "x", None, True),
    ({"unknown": True}, "x", None, False),
    ({"from_domain_in": "oops.test"}, "x", "a@oops.test", True),
    ({"from_domain_contains_any": "text"}, "x", "a@text.test", False),
    ({"from_domain_not_ends_with": [".ca"]}, "x", None, False),
    ({"from_domain_not_in_known_sender_domains_for": ["maple", "nobody"]}, "x", "a@x.test", True),
    ({"body_dollar_amount_in_range": [199, 799]}, "pay $450", None, True),
    ({"body_dollar_amount_in_range": [199, 799]}, "pay $2000", None, False),
    ({"body_dollar_amount_in_range": [2000, 5000]}, "pay $ 2,500.50", None, True),
    ({"body_contains_sin_pattern": True}, "é123 456-789é", None, True),
    ({"body_contains_sin_pattern": True}, "1234567890", None, False),
    ({"attachment_extension_in": [".exe"], "or_password_protected_archive": True}, "a password protected  zip", None, True),
    ({"attachment_extension_in": [".exe"], "or_password_protected_archive": True}, "run.exe", None, True),
    ({"or_password_protected_archive": True}, "run.exe", None, False),
    ({"attachment_extension_in": [".exe"]}, "run.exes .exe", None, False),
    ({"link_text_domain_differs_from_href_domain": True},
     '<a href="https://www.maplebank.test/l">maplebank.test</a>', None, False),
    ({"link_text_domain_differs_from_href_domain": True},
     '<a href="https://evil.test/l">www.maplebank.test</a>', None, True),
    ({"link_url_is_ip_address": True}, "http://2130706433/x", None, True),
    ({"lookalike_of_high_value_whitelist": True}, "x", "a@maplebank.tesst", False),
    ({"lookalike_of_high_value_whitelist": True}, "x", "a@maplebonk.test", True),
    ({"subdomain_contains_institution_name": True}, "https://xmaplebank.testy.org/", None, True),
    ({"target_email_on_free_provider": True}, "to Me@Gmail.com", "Me@Gmail.com", False),
    ({"target_email_on_free_provider": True}, "to you@gmail.com", None, True),
    ({"email_body_contains_html_form": True}, "<FORM>", None, True),
    ({"email_body_contains_html_form": True}, "<formal>", None, False),
    ({"claimed_brand_in_whitelist": True}, "visit tax.gov.test now", None, True),
    ({"body_contains_all_of": [["one"], ["two", "three"]]}, "one three", None, True),
    ({"body_contains_all_of": [["one"], ["two"]]}, "one", None, False),
    ({"body_appears_ai_polished": True}, "x", None, False),
]


def test_predicates(spark):
    """One rule per case, all in one plan; each case looks at its own message."""
    rules = [Rule(f"r{i}", 1, match) for i, (match, *_) in enumerate(CASES)]
    df = spark.createDataFrame(
        [(i, body, from_hdr, None, None, None) for i, (_, body, from_hdr, _) in enumerate(CASES)],
        "msg_id int, body string, from_hdr string, reply_to string, subject string, auth_results string")
    for r in score_messages(df, lists(spark)[0], ORGS, rules).collect():
        match, body, from_hdr, fires = CASES[r.msg_id]
        gated = r.sender_verified and not is_structural(rules[r.msg_id])
        assert (f"r{r.msg_id}" in ids(r)) == (fires and not gated), (match, body)


def test_every_predicate_is_known():
    assert len(PREDICATES) == 34  # the rule-count predicate is handled by the evaluator


def test_rule_order_and_counts(spark):
    rules = [Rule("second", 5, {"other_rules_triggered_count_gte": 2}), Rule("a", 10, {}),
             Rule("third", 5, {"other_rules_triggered_count_gte": 3}), Rule("b", 10, {"link_present": True})]
    assert ids(mail(spark, rules, "https://x.test")) == ["a", "b", "second", "third"]
    assert ids(mail(spark, rules, "none")) == ["a"]


def test_verified_sender_keeps_structural_rules_only(spark):
    rules = [Rule("words", 70, {"body_contains_any": ["gift card"]}), Rule("exe", 75, {"attachment_extension_in": [".exe"]})]
    r = mail(spark, rules, "gift card run.exe", "Post <a@mail.post.test>")
    assert r.sender_verified and ids(r) == ["exe"]
    assert ids(mail(spark, rules, "gift card run.exe", "Post <a@p0st.test>")) == ["words", "exe"]


def test_sender_signals_and_contact(spark):
    r = mail(spark, [], "Dear Parcel Post client, MB", "X <xkqzvbtrwpl@zqxvbkrtw.test999.a.biz.id>")
    assert ids(r) == ["random_sender_domain", "random_sender_local_part", "deep_subdomain_chain_sender",
                      "abused_sender_tld", "digit_mixed_sender_domain"]
    assert r.score == 100 and r.official_contact.name == "Maple Bank" and r.official_contact.phone is None
    quiet = mail(spark, [], "See you at six", "News <news@e.mail.somebrand.test>")
    assert quiet.verdict == "safe" and not quiet.fired_rules and quiet.official_contact is None


def test_explanations(spark):
    rules = [Rule("a", 1, {}, "english", "français"), Rule("b", 1, {}, "english", ""), Rule("c", 1, {})]
    assert [x.explanation for x in mail(spark, rules, lang="fr").fired_rules] == ["français", "english", "c"]
    assert [x.explanation for x in mail(spark, rules).fired_rules] == ["english", "english", "c"]


def test_from_line_in_body_and_empty_message(spark):
    assert mail(spark, [], 'hi\nFROM:\t"Joe" <j@Shop.TEST>').sender_domain == "shop.test"
    assert mail(spark, [], None).score == 0


def test_host_flags_by_join_equal_row_local_flags(spark):
    """An allow-list beyond the row-local bound gives the same flags through joins."""
    rows = messages(spark, "/root/testdata/sf0.001")
    schema = "domain string, name string, official_url string, high_value boolean, ord int"
    big = allow_table(spark.createDataFrame(list(seeds.ALLOW), schema), local_rows=0, broadcast_rows=0)
    names = ["from_in_allow", "link_outside_allow", "host_outside_allow", "text_in_allow",
             "holds_allow_domain", "is_lookalike", "names_allow_domain"]
    a, _ = with_predicate_inputs(rows, seeds.allow_list(spark), list(seeds.ORGS), MessageConfig())
    b, _ = with_predicate_inputs(rows, big, list(seeds.ORGS), MessageConfig())
    a, b = (sorted(x.select("msg_id", *names).collect()) for x in (a, b))
    assert a == b
    assert all(any(getattr(r, n) for r in a) for n in names)


def test_bands_are_monotone_and_shift_is_clamped(spark):
    s = spark.range(101).select(F.col("id").cast("int").alias("s"))
    rows = s.select("s", bands.verdict_rank(bands.band(F.col("s"))).alias("r"),
                    bands.shift_score(F.col("s"), F.lit("strict")).alias("up"),
                    bands.shift_score(F.col("s"), F.lit("permissive")).alias("down")).orderBy("s").collect()
    assert [r.r for r in rows] == sorted(r.r for r in rows)
    assert all(0 <= r.down <= r.s <= r.up <= 100 for r in rows)


@pytest.mark.parametrize("score,raw,sens,verdict", [
    (60, "medium", "permissive", "low"), (45, "low", "strict", "medium"),
    (10, "high", "balanced", "high"), (10, "high", "permissive", "safe")])
def test_sensitivity_and_floor(spark, score, raw, sens, verdict):
    df = spark.createDataFrame([(score, raw)], "s int, v string")
    assert CB.with_final_verdict(df, "s", "v", F.lit(sens)).collect()[0].final_verdict == verdict


def test_trusted_host_is_still_content_scored_by_default(spark):
    df = spark.createDataFrame([("safe", None, ["user_allowed"]), ("safe", "Maple", ["allow_listed"])],
                               "v string, i string, r array<string>")
    def needs(**kw):
        return [x[0] for x in df.select(CB.needs_page_score(F.col("v"), F.col("i"), F.col("r"), **kw)).collect()]
    assert needs() == [True, False] and needs(trust_user_list=True) == [False, False]


def test_lookup_answers(spark):
    now = F.expr("timestamp'2024-03-01 00:00:00'")
    good = '{"events":[{"eventAction":"x"},{"eventAction":"registration","eventDate":"2024-02-28T12:00:00Z"}]}'
    df = spark.createDataFrame([(good,), ("{}",), ("broken",), (None,)], "p string")
    assert [r[0] for r in df.select(domain_age_days(F.col("p"), now)).collect()] == [1, None, None, None]
    ph = spark.createDataFrame([('{"results":{"in_database":true}}',), ("{}",)], "p string")
    got = [r[0] for r in ph.select(phish_answer(F.col("p"))).collect()]
    assert tuple(got[0]) == (True, False, False) and got[1] is None


def test_list_files_with_fall_back_and_refresh(spark, tmp_path):
    live, packed = tmp_path / "live", tmp_path / "packed"
    live.mkdir(), packed.mkdir()
    (packed / "rules.json").write_text('{"version":"1","rules":[{"id":"a","weight":7,"match":{"link_present":true},'
                                       '"user_explanation":"e"},{"id":"b","match":{}}]}')
    (packed / "known_bad.json").write_text('{"version":"1.0.0","domains":["X.test","y.test"]}')
    (live / "known_bad.json").write_text('{"version":"1.0.1","domains":["z.test"]}')
    args = (str(live), str(packed))
    rules = load_list(spark, "rules", *args)
    assert [(r.rule_id, r.weight, r.match) for r in rules_of(rules)] == [("a", 7, {"link_present": True}), ("b", 0, {})]
    assert [r.domain for r in load_list(spark, "known_bad", *args).collect()] == ["z.test"]
    assert [r.domain for r in load_list(spark, "known_bad", None, str(packed)).collect()] == ["x.test", "y.test"]
    assert load_list(spark, "institutions", *args).count() == 0
    bad = {(r.check_name, r.rows, r.bad_rows) for r in validate_lists({"rules": rules}).collect()}
    assert bad == {("malformed", 2, 1), ("missing_translation", 2, 2)}
    cur = {"a": spark.createDataFrame([("2",)], "version string"), "b": spark.createDataFrame([("1",)], "version string")}
    new = {"a": spark.createDataFrame([("1",)], "version string"), "b": spark.createDataFrame([("1",)], "version string"),
           "c": spark.createDataFrame([(None,)], "version string")}
    assert refresh_lists(cur, new, str(tmp_path / "out")) == ["a"]


def test_messages_with_one_id_keep_their_own_flags(spark, monkeypatch):
    """Long allow-lists resolve hosts by joins; the verdicts must be those of the row-local way."""
    rules = [Rule(f"r{i}", 1, match) for i, (match, *_) in enumerate(CASES)]
    rows = [(i % 3 or None, body, from_hdr, None, None, None) for i, (_, body, from_hdr, _) in enumerate(CASES)]
    rows += [(1, "hello", "Bank <a@maplebank.test>", None, None, None), (1, "hello", "X <a@evil.test>", None, None, None)] * 2
    df = spark.createDataFrame(
        rows, "msg_id int, body string, from_hdr string, reply_to string, subject string, auth_results string")

    def verdicts():
        out = score_messages(df, lists(spark)[0], ORGS, rules)
        return sorted((r.msg_id or 0, r.score, r.verdict, sorted(ids(r)), r.sender_domain or "", r.sender_verified)
                      for r in out.collect())
    want = verdicts()
    monkeypatch.setattr("phishlake.plans.message_job.bounded_host_lists", lambda allow: None)
    assert verdicts() == want

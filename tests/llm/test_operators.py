"""Each operator against a brute-force version, with nulls, empty texts, ties, repeated rows, clashing columns."""

import base64
import collections
import hashlib
import itertools
import random
import re
import time

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import tiktoken
from pyspark.sql import functions as F

from llm import quality_gam, template_decontam, toxicity, warc_store
from llm.byte_bpe import Vocabulary, tokenize
from llm.chat_format import END, START, format_turns, parse, read_back, render
from llm.html_extraction import common_lines, main_texts
from llm.ngram_jaccard_join import block_counts, near_duplicates
from llm.page_blocks import blocks
from llm.quality_rules import judge
from llm.substring_dedup import dedup_substrings, edges, layout_of, repeated_spans
from llm.words import of_column, spans

SF = "/root/testdata/sf0.001"
WORD = re.compile("[^\x20\x09-\x0d]+")
#: Names that operators use inside; the input may have them too.
CLASH = ("id", "doc", "twin", "cuts", "hash", "mark", "page", "host", "row", "key", "label", "bin", "group", "block", "kept",
         "owner", "_id", "_text")


def clashing(frame, names=CLASH):
    return frame.withColumns({c: F.lit(7) for c in names if c not in frame.columns})


@pytest.fixture(scope="module")
def corpus(spark):
    """Rows of every kind the contracts name: (doc_id, text)."""
    random.seed(11)
    vocabulary = [f"w{i}" for i in range(400)]

    def words(n):
        return [random.choice(vocabulary) for _ in range(n)]
    base, passage = words(120), words(40)
    rows = [(1, " ".join(base)), (2, " ".join(base)), (3, " ".join(base[:118] + ["new", "end"])),
            (4, None), (5, ""), (6, " \n\t "), (7, "a b"), (8, "a b"), (9, "a b c"),
            (10, " ".join(words(30) + passage + words(30))), (11, "\n".join(words(10) + passage + words(5))),
            (12, " ".join(passage)), (12, " ".join(passage)), (13, " ".join(words(20))), (13, " ".join(base[5:60])),
            (None, " ".join(base)), (14, " ".join(["again"] * 60)), (15, " ".join(words(5000)))]
    for i in range(30):
        changed = list(base)
        changed[random.randrange(120)] = f"c{i}"
        rows.append((100 + i, " ".join(changed)))
    return rows


@pytest.fixture(scope="module")
def docs(spark, corpus):
    return clashing(spark.createDataFrame(corpus, "doc_id long, text string")).repartition(4)


def empty(spark, *extra):
    return spark.createDataFrame([], ", ".join(("doc_id long, text string", *extra)))


def test_substring_dedup(spark, corpus, docs):
    found = {i: set() for i, _ in corpus}
    first = {}
    for i, text in corpus:
        w = WORD.findall(text or "")
        for k in range(len(w) - 12):
            if i is not None:
                first[tuple(w[k:k + 13])] = min(i, first.get(tuple(w[k:k + 13]), i))
    del found
    want = []
    for i, text in corpus:
        w = WORD.findall(text or "")
        gone = {j for k in range(len(w) - 12) if i is not None and first[tuple(w[k:k + 13])] < i for j in range(k, k + 13)}
        want.append((i, len(w), len(gone), " ".join(x for j, x in enumerate(w) if j not in gone)))
    got = [tuple(r) for r in dedup_substrings(docs).collect()]
    assert sorted(got, key=repr) == sorted(want, key=repr)
    assert dedup_substrings(empty(spark)).count() == 0


def test_spans_name_their_source(spark, corpus):
    rows = [(i, t) for i, t in corpus if i is not None and i not in (12, 13)]
    text = {i: WORD.findall(t or "") for i, t in rows}
    spans = repeated_spans(spark.createDataFrame(rows, "doc long, text string").withColumn("twin", F.lit(0))).collect()
    assert spans and all(s.src_doc < s.doc for s in spans)
    for s in spans:
        n = s.n + 12
        assert text[s.doc][s.at:s.at + n] == text[s.src_doc][s.src_at:s.src_at + n]


def _jaccard_truth(rows):
    sets = {}
    for i, text in rows:
        w = WORD.findall(text or "")
        sets[i] = {tuple(w[k:k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()
    links, root = collections.Counter(), {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x
    for a, b in itertools.combinations(sorted(sets), 2):
        union = len(sets[a] | sets[b])
        if union and len(sets[a] & sets[b]) >= 0.8 * union:
            links[a] += 1
            links[b] += 1
            x, y = find(a), find(b)
            root[max(x, y)] = min(x, y)
    return {i: (find(i), links[i]) for i in sets}


def test_jaccard_join(spark, corpus):
    rows = [(i, t) for i, t in corpus if i not in (12, 13)]
    got = near_duplicates(clashing(spark.createDataFrame(rows, "doc_id long, text string"))).collect()
    want = _jaccard_truth([r for r in rows if r[0] is not None])
    assert {r.doc_id: (r.class_id, r.n_links) for r in got} == want | {None: (None, 0)}
    assert near_duplicates(empty(spark)).count() == 0


def test_jaccard_join_in_blocks(spark, corpus, monkeypatch):
    monkeypatch.setattr("llm.ngram_jaccard_join.BLOCK_SHINGLES", 500)
    rows = [(i, t) for i, t in corpus if i is not None and i not in (12, 13)]
    got = near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r.doc_id: (r.class_id, r.n_links) for r in got} == _jaccard_truth(rows)


def test_byte_bpe_equals_library(spark, corpus, docs):
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    with open(path, "rb") as file:
        vocabulary = Vocabulary(file.read(), public_tokenizers.PATTERN)
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=vocabulary.ranks, special_tokens={})
    random.seed(5)
    signs = " \n\t\r ab'sABéñ1٣中文😀 　\x85.,!-_<|endoftext|>"
    texts = ["".join(random.choice(signs) for _ in range(random.randint(0, 50))) for _ in range(1500)]
    texts += ["a" * 3000, "é" * 1000, " " * 700, "ab" * 5000, ""]
    for text, ids in zip(texts, vocabulary.encode(texts), strict=True):
        assert np.frombuffer(ids, "<u4").tolist() == library.encode_ordinary(text)
        assert vocabulary.decode(ids) == text.encode()
    got = tokenize(docs, path, public_tokenizers.PATTERN).collect()
    want = [(i, np.array(library.encode_ordinary(t or ""), "<u4").tobytes(), (t or "").encode()) for i, t in corpus]
    assert sorted(((r.doc_id, bytes(r.ids), bytes(r.decoded)) for r in got), key=repr) == sorted(want, key=repr)
    assert tokenize(empty(spark), path, public_tokenizers.PATTERN).count() == 0


def test_bpe_cache_generations(monkeypatch):
    monkeypatch.setattr("llm.byte_bpe.CACHE_BYTES", 4_200)  # some eight pieces a generation
    with open(public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb") as file:
        vocabulary = Vocabulary(file.read(), public_tokenizers.PATTERN)
    for i in range(6):
        texts = [f"alpha{i} beta gamma{i % 2}", "beta alpha0"]
        assert [vocabulary.decode(x).decode() for x in vocabulary.encode(texts)] == texts
    assert len(vocabulary.young) <= 16
    long = ["x" * 600, "y" * 600]
    assert [vocabulary.decode(x).decode() for x in vocabulary.encode(long)] == long
    assert not set(long) & set(vocabulary.young) and vocabulary.size <= 4_200


def test_bpe_of_one_long_piece():
    """A piece of 300 KB, as one tree; its merges are those of the vectorised trees."""
    with open(public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb") as file:
        vocabulary = Vocabulary(file.read(), public_tokenizers.PATTERN)
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=vocabulary.ranks, special_tokens={})
    random.seed(6)
    piece = "".join(random.choice("etaoinshr") for _ in range(300_000))
    start = time.process_time()
    ids = np.frombuffer(vocabulary.encode([piece])[0], "<u4")
    assert time.process_time() - start < 60
    assert vocabulary.decode(ids.tobytes()).decode() == piece
    short = piece[:3_000]
    assert np.frombuffer(vocabulary.encode([short])[0], "<u4").tolist() == library.encode_ordinary(short)
    some = [piece[i:i + 90].encode() for i in range(0, 9_000, 90)]
    assert [vocabulary._merge_one(p, 128) for p in some] == vocabulary._merge_equal(some, 128)


def test_toxicity(spark):
    random.seed(2)
    calm = [f"calm{i}" for i in range(80)]
    rows, labels = [], []
    for i in range(600):
        bad = i % 6 == 0
        w = [random.choice(calm) for _ in range(40)] + (["vilexa", "vilezo"][:1 + i % 2] * (1 + i % 5) if bad else [])
        random.shuffle(w)
        rows.append((i, " ".join(w)))
        labels.append((i, int(bad)))
    rows += [(None, "vilexa vilexa vilezo"), (900, None), (901, ""), (902, "VILEXA, vilenew! vilezo")]
    docs = clashing(spark.createDataFrame(rows, "doc_id long, text string"))
    marks = spark.createDataFrame(labels + [(3, None), (None, 1)], "doc_id long, toxic int")
    model = toxicity.fit(docs, marks)
    assert list(model.thresholds) == sorted(model.thresholds)
    got = {r.doc_id: r for r in toxicity.score(docs, model).collect()}
    assert all(got[i].toxic == bool(bad) for i, bad in labels)
    assert got[902].toxic and got[None].toxic and not got[900].toxic and got[900].severity == got[901].severity
    assert got[902].severity > got[900].severity
    assert toxicity.keep_clean(docs, model).columns == docs.columns
    assert toxicity.keep_clean(docs, model).count() == sum(not r.toxic for r in got.values())
    nothing = toxicity.fit(docs, marks.where("false"))
    assert not any(r.toxic for r in toxicity.score(docs, nothing).collect())
    assert toxicity.score(empty(spark), nothing).count() == 0


def test_quality_held_out(spark):
    base = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{base}/documents.parquet"), spark.read.parquet(f"{base}/labels.parquet")
    held = F.crc32(F.col("doc_id").cast("string")) % 5 == 0
    model = quality_gam.fit(docs, labels.where(~held))
    rows = quality_gam.score(docs, model).join(labels, "doc_id").where(held).collect()
    good = [r.score for r in rows if r.quality == 1]
    bad = [r.score for r in rows if r.quality == 0]
    wins = np.mean([[(g > b) + (g == b) / 2 for b in bad] for g in good])
    assert wins > 0.95 and all(0 <= r.score <= 1 for r in rows)


def test_quality_edges(spark, docs):
    flat = quality_gam.fit(docs, spark.createDataFrame([(1, 1), (2, 1)], "doc_id long, quality int"))
    got = quality_gam.score(docs, flat).collect()
    assert len(got) == docs.count() and len({r.score for r in got}) == 1
    assert quality_gam.score(empty(spark), flat).count() == 0


def test_gam_learns_an_interaction():
    rng = np.random.default_rng(1)
    x = rng.random((4000, 3))
    y = ((x[:, 0] > 0.5) ^ (x[:, 1] > 0.5)).astype(float)
    model = quality_gam.fit_tables(x, y)
    assert {0, 1} in [set(p) for p in model.pairs]
    assert ((model.score(x) > 0.5) == y).mean() > 0.95


def test_quality_rules(spark, corpus, docs):
    extra = [(200, "x | y\nx | y\n\nx | y " + "# " * 30), (201, "one two three four five six seven eight " * 2 + "q")]
    both = clashing(spark.createDataFrame([*corpus, *extra], "doc_id long, text string"))
    trusted = spark.createDataFrame([(1,), (10,), (None,)], "doc_id long")
    rows = judge(both, trusted).collect()
    want = []
    for i, text in [*corpus, *extra]:
        t = text or ""
        w = WORD.findall(t)
        seen = collections.Counter(tuple(w[k:k + 8]) for k in range(len(w) - 7))
        hit = {j for k in range(len(w) - 7) if seen[tuple(w[k:k + 8])] > 1 for j in range(k, k + 8)}
        lines = [x for x in t.split("\n") if WORD.search(x)]
        want.append((i, len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), len(lines) - len(set(lines)), len(hit),
                     len(w) < 20 or 100 * len(hit) > 30 * len(w)))
    got = [(r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in rows]
    assert sorted(got, key=repr) == sorted(want, key=repr)
    assert not any(r.kept and r.base_failed for r in rows)
    assert all(r.ratio > 0 for r in rows if r.doc_id == 1)
    plan = judge(both, trusted)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan
    assert judge(empty(spark), trusted).count() == 0
    assert {r.ratio for r in judge(both, trusted.where("false")).collect()} == {0.0}


def test_log_ratio_by_hand(spark):
    rows = [(1, "a b c d"), (2, "a b x y z")]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r.ratio for r in judge(frame, frame.where("doc_id = 1"), buckets=1 << 12).collect()}
    assert got[1] > 0 > got[2]


def test_decontamination(spark):
    item = "The train from Lyon left at 9 and ran 120 km before it met the second train of the same line at noon"
    other = "Blue birds sing early while the old miller carries heavy sacks over the narrow wooden bridge every single day"
    items = spark.createDataFrame([(1, item), (2, other), (3, None), (4, ""), (5, "too short")], "item_id long, text string")
    changed = item.replace("Lyon", "Turin").replace("9", "7").replace("120", "300").replace("km", "miles")
    twice = "If the shop sells 5 pens to each child and every child gives 5 pens back to the shop at night nothing is lost"
    items = items.unionByName(spark.createDataFrame([(6, twice), (7, other)], "item_id long, text string"))
    rows = [(1, f"Noise before. {item} Noise after"), (2, changed), (3, other.upper()), (4, other.replace(" ", "*** ")),
            (5, twice.replace("5", "8")), (6, twice.replace("5 pens to", "8 pens to")), (7, None), (8, ""),
            (9, "too short"), (10, "a clean text with nothing of the kind in it at all, not even a piece of one"),
            (1, "another row of one id"), (None, item)]
    docs = clashing(spark.createDataFrame(rows, "doc_id long, text string"))
    want = {(1, 1, True), (2, 1, False), (3, 2, True), (3, 7, True), (4, 2, True), (4, 7, True), (5, 6, False),
            (None, 1, True)}
    for limit in (1_000_000, 0):
        got = template_decontam.contaminated(docs, items, filter_windows=limit).collect()
        assert {(r.doc_id, r.item_id, r.exact) for r in got} == want
        kept = template_decontam.remove_contaminated(docs, items, filter_windows=limit)
        assert kept.columns == docs.columns
        assert sorted(str(r.doc_id) + (r.text or "") for r in kept.collect()) == sorted(
            str(i) + (t or "") for i, t in rows if i in (6, 7, 8, 9, 10) or t == "another row of one id")
    assert template_decontam.contaminated(empty(spark), items).count() == 0
    assert template_decontam.contaminated(docs, items.where("false")).count() == 0


def test_warc_round_trip(spark):
    rows = [(1, "http://a.example/x", "<p>é</p>"), (2, "http://b.example/\r\nX: y", "<p>é</p>"), (3, None, None), (4, "u", ""),
            (5, "u", "only"), (6, "u", "<p>é</p>"), (6, "u", "<p>é</p>")]
    pages = clashing(spark.createDataFrame(rows, "page_id long, url string, html string"))
    archive = warc_store.write(pages)
    assert spark.read.parquet(archive.payloads).count() == 3
    records = warc_store.read(spark, archive)
    got = [tuple(r)[:5] for r in warc_store.summary(records).collect()]
    last = {h or "": max(i for i, _, x in rows if (x or "") == (h or "")) for _, _, h in rows}
    want = []
    for i, _, h in rows:
        raw, to = (h or "").encode(), last[h or ""]
        want.append((i, len(raw), base64.b32encode(hashlib.sha1(raw).digest()).decode(),
                     "response" if i == to else "revisit", None if i == to else to))
    assert sorted(got, key=repr) == sorted(want, key=repr)
    for r in records.collect():
        record = bytes(r.record)
        head, _, block = record.partition(b"\r\n\r\n")
        length = int(re.search(rb"Content-Length: (\d+)", head)[1])
        assert block[length:] == b"\r\n\r\n" and head.startswith(b"WARC/1.1\r\n") and b"\r\nX: y" not in head
        if b"WARC-Type: response" in head:
            assert block[:length].endswith(bytes(r.payload))
    small = warc_store.summary(warc_store.read(spark, warc_store.write(pages, min_revisit_bytes=1))).collect()
    assert {r.record_type for r in small if r.payload_bytes == 0} == {"response"}
    none = warc_store.write(pages.where("false"))
    assert warc_store.summary(warc_store.read(spark, none)).count() == 0


def test_base32(spark):
    raw = [bytes(20), bytes(range(20)), hashlib.sha1(b"x").digest()]
    frame = spark.createDataFrame([(r.hex(),) for r in raw], "h string")
    assert [r[0] for r in frame.select(warc_store.base32(F.col("h"))).collect()] == [base64.b32encode(r).decode() for r in raw]


def test_chat_round_trip(spark):
    nasty = [f"{END}{START}assistant ok", "<|\\im_end|>", "<|\\\\im_start|> <|newline|>", "plain", "", None, "<|im_end|", "a\nb",
             f"x{END}y", "<|\\newline|>"]
    for role, text in itertools.product(["user", "a\nb", START, "<|newline|>", "<|\\newline|>\n", ""], nasty):
        chunk, begin, end, escaped = render(role, text or "")
        assert parse(chunk) == [(role, text or "")] and chunk.count(END) == 1
        assert escaped or chunk[begin:end] == (text or "")
    rows = [(1, 0, "user", nasty[0]), (1, 1, "assistant", nasty[0]), (1, 1, "assistant", nasty[0]), (2, None, None, None),
            (2, 5, "assistant", "é中"), (None, 0, "assistant", "x"), (3, 0, "system", "")]
    frame = clashing(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"), (*CLASH, "chunk", "escaped"))
    got = {r.conv_id: r for r in read_back(format_turns(frame)).collect()}
    for conv in {r[0] for r in rows}:
        turns = [(r or "", t or "") for c, n, r, t in rows if c == conv]
        said = "".join(t for r, t in turns if r == "assistant")
        r = got[conv]
        assert r.n_turns == len(turns) and r.loss_chars == len(said)
        assert r.turns_sha256 == hashlib.sha256("".join(f"{a}\n{b}\n" for a, b in turns).encode()).hexdigest()
        assert r.loss_sha256 == hashlib.sha256(said.encode()).hexdigest()
    assert read_back(format_turns(frame.where("false"))).count() == 0


def test_blocks_leave_chrome():
    page = """<!doctype html><html><head><title>T</title><style>p{}</style></head><body>
    <header><h1>Site</h1></header><nav><ul><li>Home</ul></nav><div class="cookie-notice"><p>We use cookies</p></div>
    <main><article><header><h1>Head &amp; line</h1><p class="byline">by X</p></header>
    <p>First <b>bold</b><br>next  &nbsp;word</p><div class="ad">Buy</div><p>Second &lt;p&gt; 1 < 2
    <script>var a = "</p>";</script><form><input><p>Mail</p></form>
    <section id="comments"><article class="comment"><p>Nice!</p></article></section></article></main>
    <aside>Related</aside><footer>&copy; 2020</footer></body></html>"""
    assert [t for t, kind in blocks(page) if kind == 2] == ["Head & line", "First bold next word", "Second <p> 1 < 2"]
    hostile = '<a "' * 20_000 + "<!--" * 5_000 + "<div class='" * 5_000
    assert isinstance(blocks(hostile), list)


def test_common_lines_are_longest():
    random.seed(9)
    for _ in range(150):
        a = [random.randrange(6) for _ in range(random.randrange(14))]
        b = [random.randrange(6) for _ in range(random.randrange(14))]
        table = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, j in itertools.product(range(len(a)), range(len(b))):
            table[i + 1][j + 1] = table[i][j] + 1 if a[i] == b[j] else max(table[i][j + 1], table[i + 1][j])
        got = common_lines(a, b)
        assert len(got) == table[-1][-1] and got == sorted(set(got))
        rest = iter(b)
        assert all(any(x == y for y in rest) for x in (a[i] for i in got))


def test_page_differencing(spark):
    def page(*lines):
        return "".join(f"<div>{x}</div>" for x in lines)
    rows = [(1, "http://a.example/n/1", page("Menu", "Story one", "Contact")),
            (2, "http://a.example/n/2", page("Menu", "Story two", "Contact")),
            (3, "http://a.example/n/2", page("Menu", "Story two", "Contact")),
            (4, "http://b.example/x", page("Menu", "Alone")), (5, None, None), (6, "bad url", ""),
            (7, "http://a.example/z", "<nav>Menu</nav><article><p>Story two</p></article>")]
    pages = clashing(spark.createDataFrame(rows, "page_id long, url string, html string"), (*CLASH, "path", "cut", "lines"))
    got = {r.page_id: r.text for r in main_texts(pages).collect()}
    assert got == {1: "Story one", 2: "Story two", 3: "Story two", 4: "Menu\nAlone", 5: "", 6: "", 7: "Story two"}
    assert main_texts(pages.where("false")).count() == 0


def test_page_differencing_inside_articles(spark):
    """A line on most pages of a host goes from their articles; quotations and copies of articles stay."""
    def page(*lines):
        return "<nav>Menu</nav><article>" + "".join(f"<p>{x}</p>" for x in lines) + "</article>"
    told = {i: [f"Head {i}", f"Story {i}", "Share this page"] for i in range(40)}
    told[7].insert(1, "A quoted passage")
    told[8].insert(1, "A quoted passage")
    told[20] = ["Share this page"]  # nothing else: it stays
    told[21] = ["Head 21", "Story 21"]  # the neighbour of 22, which therefore keeps the line
    rows = [(i, f"http://a.example/n/{i:02}", page(*lines)) for i, lines in told.items()]
    rows += [(100 + i, f"http://b.example/n/{i}", page("Head", "One", "Two", f"Copy {i}")) for i in range(12)]  # copies
    rows += [(200 + i, f"http://c.example/n/{i}", page(f"Head {i}", f"Story {i}", "Share this page")) for i in range(3)]  # too few
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    want = {i: "\n".join(lines if i in (20, 22) else [x for x in lines if x != "Share this page"]) for i, lines in told.items()}
    want |= {100 + i: f"Head\nOne\nTwo\nCopy {i}" for i in range(12)}
    want |= {200 + i: f"Head {i}\nStory {i}\nShare this page" for i in range(3)}
    for partitions in (1, 3, 30):  # neighbours in one partition, and across partitions of one or two rows
        spark.conf.set("spark.sql.shuffle.partitions", partitions)
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", partitions == 1)
        try:
            assert {r.page_id: r.text for r in main_texts(pages).collect()} == want
        finally:
            spark.conf.unset("spark.sql.shuffle.partitions")
            spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def _substring_truth(rows):
    first, want = {}, []
    for i, text in rows:
        w = WORD.findall(text)
        for k in range(len(w) - 12):
            first[tuple(w[k:k + 13])] = min(i, first.get(tuple(w[k:k + 13]), i))
    for i, text in rows:
        w = WORD.findall(text)
        gone = {j for k in range(len(w) - 12) if first[tuple(w[k:k + 13])] < i for j in range(k, k + 13)}
        want.append((i, len(w), len(gone), " ".join(x for j, x in enumerate(w) if j not in gone)))
    return want


def _smallest_phrase(seed=4):
    """A phrase whose hash is the minimum in nearly every window."""
    words = of_column(pa.array([" ".join(f"s{i}" for i in range(20_000))]))
    at = int(spans(words.hash, seed).argmin())
    return " ".join(f"s{i}" for i in range(at, at + seed))


def test_windows_are_equal_by_their_whole_hash(spark):
    """The first two windows share a minimizer and 40 bits of their hash, but not the last word."""
    start = "the quiet harbour town keeps its old lamps burning through every storm"
    s = _smallest_phrase()

    def periodic(word):  # one minimizer, equal ends, another middle
        return f"{s} a1 a2 a3 a4 a5 a6 {s} b1 b2 {word} b4 b5 b6 {s} c1 c2 c3 c4 c5 c6 {s} d1 d2 d3 d4 d5 d6 {s}"
    rows = [(1, f"{start} v1426229"), (2, f"{start} v633436"), (3, f"{start} v925128"), (4, f"{start} v2798425"),
            (5, periodic("b3")), (6, periodic("other"))]
    want = _substring_truth(rows)
    assert [r[2] for r in want[:5]] == [0] * 5 and 0 < want[5][2] < want[5][1]
    got = dedup_substrings(spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)).collect()
    assert sorted(tuple(r) for r in got) == want


def test_hot_minimizer_is_split(spark, monkeypatch):
    """One frequent phrase in differing contexts is not one group, and the result stays the same."""
    monkeypatch.setattr("llm.substring_dedup.HOT_WINDOWS", 200)
    random.seed(8)
    s = _smallest_phrase()

    def some(n):
        return " ".join(f"t{random.randrange(5000)}" for _ in range(n))
    rows = [(i, f"{some(14)} {s} {some(14)}") for i in range(300)]
    rows += [(1000 + i, f"{some(3)} {rows[i * 7][1]} {some(4)}") for i in range(40)]
    frame = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = dedup_substrings(frame).collect()
    want = _substring_truth(rows)
    assert sum(r[2] > 0 for r in want) == 40
    assert sorted(tuple(r) for r in got) == want
    named = frame.select(F.col("doc_id").alias("doc"), F.lit(0).alias("twin"), "text")
    layout = layout_of(named)  # no riders here: a row is its head and its windows
    held = edges(named, 13, 4, layout).groupBy(F.substring("edge", 1, 4).alias("anchor")).agg(
        F.sum((F.octet_length("edge") - layout.head) / 8).alias("n"))
    assert held.agg(F.max("n")).first()[0] < 600  # of over 3,000


def test_decontamination_finds_verbatim_passages(spark):
    """Lower-cased names, mostly numbers, and a run spoilt only beyond a gap."""
    named = "yesterday the old ferry from Lyon carried Maria and Pierre across the wide river before the heavy evening storm began"
    numbers = "add 1 2 3 4 5 6 7 8 9 10 11 12 now"
    gap = ("Start with 5 red balls and give every child in the big yellow house one small ball today while "
           "all others wait outside near 5 green doors until 5 friendly dogs come running down the long dusty road home")
    items = spark.createDataFrame([(1, named), (2, numbers), (3, gap)], "item_id long, text string")
    spoilt = gap.replace("while", "whereas").replace("5 friendly", "9 friendly")
    rows = [(1, named.lower()), (2, f"so {numbers} then"), (3, spoilt), (4, named.replace("Maria", "Anna").replace("Pierre", "Anna")),
            (5, named)]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    whole = len(named.split()) - 11
    for limit in (1_000_000, 0):
        got = {(r.doc_id, r.item_id): r for r in template_decontam.contaminated(frame, items, filter_windows=limit).collect()}
        assert {(1, 1), (2, 2), (3, 3), (5, 1)} <= set(got)
        assert got[1, 1].exact and got[5, 1].exact and got[1, 1].n_windows == got[5, 1].n_windows == whole


def test_blocks_keep_articles_of_common_markup():
    page = """<html class="no-social"><body class="home has-sidebar cookie-notice-shown" style="visibility:hidden">
    <div class="site-footer">Foot</div><div class="widget_text">Widget</div><div id="ad1">Buy</div>
    <main class="related widget"><article class="post category-social notice" id="comments-on-trade">
    <h1 title="The hidden valley">Head</h1><p data-hidden="false">First</p><div class="with-comments">Second</div>
    <p title='a class="ad" here'>Third</p><p hidden>Gone</p><p HIDDEN="">Gone</p><p aria-hidden=true>Gone</p>
    <article class="comment depth-1"><p>Nice!</p></article></article></main></body></html>"""
    assert [t for t, kind in blocks(page) if kind == 2] == ["Head", "First", "Second", "Third"]
    assert [t for t, kind in blocks(page) if kind == 0] == ["Foot", "Widget", "Buy", "Gone", "Gone", "Gone", "Nice!"]
    plain = blocks('<body class="sidebar"><div class="has-widget">One</div><div class="no-share">Two</div></body>')
    assert plain == [("One", 1), ("Two", 1)]


def test_blocks_of_table_cells_and_of_many_quotes():
    table = "<article><table><caption>Sizes</caption><tr><th>a</th><th>b</th></tr><tr><td>one</td><td>two <b>x</b></td></tr></table></article>"
    assert [t for t, _ in blocks(table)] == ["Sizes", "a", "b", "one", "two x"]
    quoted = '<p class="x">y</p>' * 150_000  # 2.7 MB: minutes, if the page were copied for each quote
    start = time.process_time()
    assert len(blocks(quoted)) == 150_000
    assert time.process_time() - start < 30


def test_jaccard_blocks_are_bounded_in_texts(spark, monkeypatch):
    """Many short texts are few shingles, but the matrices of a block grow with its texts."""
    members = spark.range(15_000).select(F.lit(1).alias("group"), F.lit(26).alias("size")).unionByName(
        spark.createDataFrame([(2, 900_000), (2, 50), (3, 1), (3, 1)], "group int, size int"))
    assert {r.group: r.blocks for r in block_counts(members).collect()} == {1: 10, 2: 5, 3: 1}
    monkeypatch.setattr("llm.ngram_jaccard_join.BLOCK_TEXTS", 6)
    base = [f"b{i}" for i in range(30)]
    rows = [(i, " ".join([*base, f"c{i}"])) for i in range(40)] + [(50, " ".join(base[:12]))]
    got = near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r.doc_id: (r.class_id, r.n_links) for r in got} == _jaccard_truth(rows)


def test_all_trusted_texts_count(spark):
    """With every text trusted, target and corpus are the same, however many there are."""
    many = spark.range(51_000).select(
        F.col("id").alias("doc_id"), F.concat_ws(" ", F.lit("word"), F.concat(F.lit("x"), F.col("id"))).alias("text"))
    assert judge(many, many).agg(F.max(F.abs("ratio"))).first()[0] < 1e-9
    ids = [-70_000, -32_768, -9, -1, 0, 1, 8, 9, 32_767, 32_768, 32_769, 2**40, None]
    rows = spark.createDataFrame([(i, f"w{n % 5} v{n % 3} u{n}") for n, i in enumerate(ids)], "doc_id long, text string")
    some = rows.where("doc_id in (-32768, -1, 1, 9, 32768, 1099511627776)").select("doc_id")
    got = [sorted(map(tuple, judge(rows, some.unionByName(some), bitmaps=most).collect()), key=repr) for most in (10_000, 0)]
    assert got[0] == got[1]
    ratio = {r[0]: r[7] for r in got[0]}
    assert min(ratio[i] for i in (-1, 1, 9, 2**40)) > 0 > ratio[8]


def _thue_morse(size):
    word = "a"
    while len(word) < size:
        word += word.translate(str.maketrans("ab", "ba"))
    return word, word.translate(str.maketrans("ab", "ba"))


def test_crafted_words_are_not_equal(spark):
    """Two words that a polynomial hash modulo 2**64 holds for one."""
    x, y = _thue_morse(1024)
    start = " ".join(f"w{i}" for i in range(12))
    frame = spark.createDataFrame([(1, f"{start} {x}"), (2, f"{start} {y}"), (3, f"{start} {x}")], "doc_id long, text string")
    assert {r.doc_id: r.n_removed for r in dedup_substrings(frame).collect()} == {1: 0, 2: 0, 3: 13}
    single = spark.createDataFrame([(1, x), (2, y), (3, x)], "doc_id long, text string")
    assert {tuple(r) for r in near_duplicates(single).collect()} == {(1, 1, 1), (2, 2, 0), (3, 1, 1)}


def test_ids_of_any_range(spark):
    """Edge rows hold ids in as few bytes as their range needs."""
    text = " ".join(f"w{i}" for i in range(40))
    for ids in ([-2**63, -1, 0, 2**63 - 1], [5], [-300, -44], [2**40, 2**40 + 255, 2**40 + 256]):
        frame = spark.createDataFrame([(i, text) for i in ids], "doc_id long, text string").repartition(3)
        assert {r.doc_id: r.n_removed for r in dedup_substrings(frame).collect()} == {i: 40 * (i > ids[0]) for i in ids}

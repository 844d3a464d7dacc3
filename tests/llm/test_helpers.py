"""Words, components, sketches and small frames helpers."""

import random
import re

import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from llm.components import components
from llm.frames import labelled_sample, with_twin
from llm.ngram_jaccard_join import match_depth, shingles, sketches
from llm.words import Words, joined, of_column, sliced, spans, text_bytes, whole_spans

WORD = re.compile("[^\x20\x09-\x0d]+")
texts = st.lists(st.one_of(st.none(), st.text("ab é\n\t 中", max_size=12)), max_size=6)


@settings(max_examples=200, deadline=None)
@given(texts)
def test_words_equal_pattern(some):
    words = of_column(pa.array(some, pa.string()))
    want = [[w.encode() for w in WORD.findall(t or "")] for t in some]
    flat, _ = text_bytes(pa.array(some, pa.string()))
    got = [flat[a:b].tobytes() for a, b in zip(words.starts, words.ends, strict=True)]
    assert got == [w for ws in want for w in ws]
    assert words.counts.tolist() == [len(w) for w in want]
    by_word = dict(zip(got, words.hash.tolist(), strict=True))
    assert all(by_word[w] == h for w, h in zip(got, words.hash.tolist(), strict=True))
    assert len(set(by_word.values())) == len(by_word)


def test_hash_of_crafted_words():
    """Thue-Morse words are equal under every polynomial modulo 2**64; also shifted, swapped and padded blocks."""
    word = "a"
    for _ in range(11):
        word += word.translate(str.maketrans("ab", "ba"))
    crafted = [word, word.translate(str.maketrans("ab", "ba"))]
    crafted += ["abcdefgh" * n for n in range(1, 6)] + ["abcdefgh" * n + "a" for n in range(5)]
    crafted += ["abcdefghABCDEFGH", "ABCDEFGHabcdefgh", "abcdefgh" + "\0" * 8, "abcdefgh" + "\0" * 7, "a\0", "a\0\0"]
    assert len(set(of_column(pa.array(crafted)).hash.tolist())) == len(crafted)
    text = " ".join(crafted)
    assert of_column(pa.array([text])).hash.tolist() == of_column(pa.array(crafted)).hash.tolist()


@settings(max_examples=100, deadline=None)
@given(texts)
def test_joined_keeps_words(some):
    column = pa.array(some, pa.string())
    flat, bounds = text_bytes(column)
    words = Words(flat, bounds)
    keep = np.arange(len(words)) % 3 != 1
    got = joined(words, flat, keep).to_pylist()
    at = 0
    for text, out in zip(some, got, strict=True):
        found = WORD.findall(text or "")
        assert out == " ".join(w for i, w in enumerate(found) if keep[at + i])
        at += len(found)


def test_spans_stay_in_texts():
    words = of_column(pa.array(["a b c", "", "d", "a b"]))
    two = spans(words.hash, 2)
    ok = whole_spans(words, 2)
    assert ok.tolist() == [True, True, False, False, True, False]
    assert two[0] == two[4] and two[0] != two[1]


def test_slices_hold_long_texts():
    batch = pa.RecordBatch.from_arrays([pa.array(["x" * 50, "y", None, "z" * 10])], ["text"])
    assert [p.num_rows for p in sliced(batch, "text", 20)] == [1, 3]


def test_components_match_union(spark):
    random.seed(3)
    links = [(random.randrange(300), random.randrange(300)) for _ in range(260)] + [(5, 5), (7, None)]
    links += [(i, i + 1) for i in range(1000, 1100)]
    got = {r.id: r.root for r in components(spark.createDataFrame(links, "id long, other long")).collect()}
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x
    for a, b in links:
        if b is not None and a != b:
            a, b = find(a), find(b)
            root[max(a, b)] = min(a, b)
    assert got == {x: find(x) for x in list(root)}
    assert components(spark.createDataFrame([], "id long, other long")).count() == 0


def test_sketch_estimates_similarity():
    base = [f"w{i}" for i in range(60)]
    close = base[:57] + ["q1", "q2"]
    h, owner = shingles(of_column(pa.array([" ".join(base), " ".join(close), "a b", ""])), 5)
    values, some = sketches(h, owner, 4, 512)
    sets = [set(h[owner == i].tolist()) for i in range(4)]
    want = len(sets[0] & sets[1]) / len(sets[0] | sets[1])
    assert abs((values[0] == values[1]).mean() - want) < 0.08
    assert some.tolist() == [True, True, True, False] and len(sets[2]) == 1


def test_depth_reaches_recall():
    depth = match_depth(0.8, 32, 8, 0.9999)
    assert 1 - (1 - 0.8 ** depth) ** 32 >= 0.9999 > 1 - (1 - 0.8 ** (depth + 1)) ** 32


def test_twins(spark):
    rows = [(1, "a"), (2, "b"), (2, "c"), (2, "b"), (None, "x")]
    got = with_twin(spark.createDataFrame(rows, "doc long, text string"), "doc", "text").collect()
    assert len(got) == 5 and {r.twin for r in got if r.doc == 1} == {0}
    assert len({(r.text, r.twin) for r in got if r.doc == 2}) == 2


def test_sample_is_bounded(spark):
    docs = spark.createDataFrame([(i, f"t{i}") for i in range(50)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(50)] + [(3, None), (None, 1)], "doc_id long, toxic int")
    assert labelled_sample(docs, labels, "toxic", 20).count() == 20

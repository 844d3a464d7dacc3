"""Alignment and archive of tokens against the libraries on whole texts, one document at a time."""

import bisect
import hashlib
import itertools
import random
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from llm import simple8b, token_alignment, token_archive
from llm.chunk_cache import ChunkCache
from llm.queries import BYTE_BPE, PIECE_BPE, PIECES, QUERIES, WORD_BPE

A, B, WORDS = map(public_tokenizers.path, (BYTE_BPE, PIECE_BPE, WORD_BPE))
SF = "/root/testdata/sf0.001"
ODD = ["", " ", "  ", "\n", "a\n\n  b ", " x", "tab\tand  two", "end   odd　", "▁mark", "nul\x00 byte", "\x1cx\x1d y",
       "<|endoftext|> and <s> </s> <unk> <0x41>", "café é ́x ΣαΣ Σ", "\U0001f600\U0001f468‍\U0001f469 ok",
       "ﬁne 가가 İI", "it's  'll 've we're", "12 345 6.78", "日本語のテキスト です", "don 't", "a" * 700, "!" * 90 + " ."]


def rows_of_all_kinds():
    random.seed(5)
    letters = ["alpha", "Beta,", "gamma.", "d'or", "(eps)", "\n", "42", "ünd", "naïve", "x-y", "\n\n", "  "]
    rows = [(i, text) for i, text in enumerate(ODD)]
    rows += [(100, None), (None, "no id here"), (None, None), (7, "seven"), (7, "seven"), (7, "other seven"), (-5, "first of all")]
    rows += [(200 + i, " ".join(random.choices(letters, k=random.randrange(1, 60)))) for i in range(60)]
    rows.append((900, " ".join(random.choices(letters, k=30_000))))
    return rows


@pytest.fixture(scope="module")
def docs(spark):
    frame = spark.createDataFrame(rows_of_all_kinds(), "doc_id long, text string").repartition(5)
    return frame.withColumns({c: F.lit(3) for c in ("key", "pairs", "times", "n", "best", "part", "seq", "_row", "start", "ids")})


@pytest.fixture(scope="module")
def libraries():
    a = Tokenizer.from_file(A)
    a.encode_special_tokens = True
    return a, sentencepiece.SentencePieceProcessor(model_file=B)


def plainly_aligned(libraries, texts):
    """Per text (n_a, n_b, n_groups, n_links, n_best, count_sum, groups), by byte ranges and sets."""
    a, b = libraries
    alphabet = token_alignment.byte_level_alphabet()
    links, groups, sizes = [], [], []
    for text in texts:
        want = (" " + (text or "")).encode()
        ids_a = a.encode(" " + text, add_special_tokens=False).ids if text else []
        ids_b = b.encode(text) if text else []
        ranges = []
        for ids, bytes_of in ((ids_a, lambda i: bytes(alphabet[c] for c in a.id_to_token(i))),
                              (ids_b, lambda i: token_alignment.piece_bytes(b.id_to_piece(i)))):
            at, out, whole = 0, [], b""
            for i in ids:
                out.append((at, at + len(bytes_of(i)), i))
                at = out[-1][1]
                whole += bytes_of(i)
            ranges.append(out if whole == want else None)
        if not text or None in ranges:
            ranges = [[], []]
        ends = sorted({e for _, e, _ in ranges[0]} & {e for _, e, _ in ranges[1]})
        said = [[[], []] for _ in ends]
        for side in (0, 1):
            for _, e, i in ranges[side]:
                said[bisect.bisect_left(ends, e)][side].append(str(i))
        said = ["|".join(map(",".join, group)) for group in said]
        found, low = [], 0
        for s, e, i in ranges[0]:
            while ranges[1][low][1] <= s:
                low += 1
            for _, _, j in itertools.takewhile(lambda r, e=e: r[0] < e, map(ranges[1].__getitem__, range(low, len(ranges[1])))):
                found.append((i, j))
        links.append(found)
        groups.append(";".join(said))
        sizes.append((len(ranges[0]), len(ranges[1]), len(said)))
    count, top = {}, {}
    for pair in (p for found in links for p in found):
        count[pair] = count.get(pair, 0) + 1
    for (_, j), n in count.items():
        top[j] = max(n, top.get(j, 0))
    return [(*size, len(found), sum(count[p] == top[p[1]] for p in found), sum(count[p] for p in found), said)
            for size, found, said in zip(sizes, links, groups, strict=True)]


def test_alignment_equals_byte_ranges(docs, libraries):
    rows = rows_of_all_kinds()
    want = sorted(((i, *w) for (i, _), w in zip(rows, plainly_aligned(libraries, [t for _, t in rows]), strict=True)), key=repr)
    assert sum(w[1] > 0 for w in want) > 70 and any(w[1] == 0 for w in want)
    stored = token_alignment.stored(token_alignment.align(docs, A, B))
    for head in (token_alignment.HEAD_PAIRS, 40, 0):  # all pairs sent; some; none
        got = token_alignment.link_scores(stored, PIECES, head).select(
            "doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups")
        assert sorted(map(tuple, got.collect()), key=repr) == want


def test_alignment_query_digests(spark, libraries):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    want = dict(zip(texts, plainly_aligned(libraries, texts.values()), strict=True))
    got = QUERIES["op11_token_alignment"](spark, SF).collect()
    assert len(got) == len(texts)
    for r in got:
        *numbers, groups = want[r.doc_id]
        assert (r.n_a, r.n_b, r.n_groups, r.n_links, r.n_best, r.count_sum) == tuple(numbers)
        assert r.groups_sha256 == (hashlib.sha256(groups.encode()).hexdigest() if groups else "")


def test_long_documents_take_several_places():
    rng = np.random.default_rng(3)
    ends = [np.unique(np.append(rng.integers(1, 4000, 900), 4000)) for _ in range(2)]
    bounds = [np.array([0, 0, len(e), len(e)]) for e in ends]
    whole = token_alignment.merge_in_step(*ends, *bounds, lane=10_000)
    links = sorted(zip(*(x.tolist() for x in whole[:2]), strict=True))
    assert links == [(i, j) for i in range(len(ends[0])) for j in range(len(ends[1]))
                     if (ends[0][i - 1] if i else 0) < ends[1][j] and (ends[1][j - 1] if j else 0) < ends[0][i]]
    for lane in (1, 7, 512):
        some = token_alignment.merge_in_step(*ends, *bounds, lane=lane)
        assert sorted(zip(*(x.tolist() for x in some[:2]), strict=True)) == links
        assert (some[2] == whole[2]).all() and (some[3] == whole[3]).all()


def test_empty_tables(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert token_alignment.link_scores(token_alignment.stored(token_alignment.align(none, A, B)), PIECES).count() == 0
    assert token_archive.read(spark, token_archive.write(none, WORDS, 1)).count() == 0


@settings(max_examples=150, deadline=None)
@given(st.text(st.sampled_from("ab ÉΣ \n\t  '.9!<|endofx>\x1c\x85▁ é"), max_size=40))
def test_chunks_give_the_ids_of_the_whole_text(text):
    pair, words = _kept("pair"), _kept("words")
    a, bounds_a, b, bounds_b = pair.encode([text])
    whole_a = pair.a.encode(" " + text, add_special_tokens=False).ids if text else []
    whole_b = pair.b.encode(text)
    want = (" " + text).encode()
    if text and b"".join(pair.b_bytes[i] for i in whole_b) == want:
        assert a.tolist() == whole_a and b.tolist() == whole_b
    else:
        assert not len(a) and not len(b)
    ids, bounds = words.encode(pa.array([text, None, text]))
    want = words.library.encode(text, add_special_tokens=False).ids
    assert ids.tolist() == want * 2 and bounds.tolist() == [0, len(want), len(want), 2 * len(want)]


def _kept(name, kept={}):  # noqa: B006
    if not kept:
        kept.update(pair=token_alignment.TokenizerPair(A, B), words=token_archive.LibraryTokenizer(WORDS))
    return kept[name]


def test_cache_is_bounded_in_bytes():
    asked = []
    cache = ChunkCache(lambda new: (asked.extend(new), [c.upper() for c in new])[1], most_bytes=30_000)
    for i in range(40):
        chunks = [*(f"w{i}-{j}" for j in range(20)), "often", "x" * 600, "often"]
        values, place = cache.look(pa.array(chunks))
        assert [values[k] for k in place] == [c.upper() for c in chunks]
        assert cache.size <= 30_000 and len(cache.young) <= 120 and "x" * 600 not in cache.young
    assert asked.count("often") == 1 and asked.count("x" * 600) == 40


@settings(max_examples=200, deadline=None)
@given(st.lists(st.one_of(st.integers(0, 1), st.integers(0, 70_000), st.integers(0, 2**64 - 1)), max_size=400))
def test_simple8b_round_trip(values):
    array = np.array(values, np.uint64)
    words, first, escaped = simple8b.pack(array)
    assert simple8b.unpack(words, first, escaped, len(array)).tolist() == values
    assert len(first) == -(-len(array) // simple8b.BLOCK) and len(escaped) == sum(v >= 2**60 for v in values)
    # every block can be read alone
    for k, at in enumerate(first.tolist()):
        end = first[k + 1] if k + 1 < len(first) else len(words)
        part = values[k * simple8b.BLOCK:(k + 1) * simple8b.BLOCK]
        assert simple8b.unpack(words[at:end], np.array([0]), escaped, len(part)).tolist() == part


def test_simple8b_packs_and_checks():
    assert len(simple8b.pack(np.ones(128, np.uint64))[0]) == 3  # 60 + 60 + 8
    assert len(simple8b.pack(np.full(128, 49_407, np.uint64))[0]) == 43
    data = simple8b.to_segment(np.arange(300), np.array([100, 0, 200]))
    assert simple8b.from_segment(data)[1].tolist() == [100, 0, 200]
    with pytest.raises(ValueError, match="checksum"):
        simple8b.from_segment(data[:-1] + bytes([data[-1] ^ 1]))
    with pytest.raises(ValueError, match="format"):
        simple8b.from_segment(b"none" + data[4:])


@pytest.mark.parametrize("segment_ids", [1, 500, token_archive.SEGMENT_IDS])
def test_archive_equals_library(spark, docs, segment_ids):
    library = Tokenizer.from_file(WORDS)
    archive = token_archive.write(docs, WORDS, 1, segment_ids=segment_ids)
    got = token_archive.read(spark, archive).collect()
    rows = rows_of_all_kinds()
    ids = {text: [*library.encode(text or "", add_special_tokens=False).ids, 1] for _, text in rows}
    read = sorted(((r.doc_id, np.frombuffer(r.ids, "<u4").tolist()) for r in got), key=repr)
    assert read == sorted(((i, ids[t]) for i, t in rows), key=repr)
    got.sort(key=lambda r: r.start)
    assert [r.doc_id for r in got] == sorted((i for i, _ in rows), key=lambda i: (i is not None, i or 0))
    at = 0
    for r in got:
        assert r.start == at
        at += len(r.ids) // 4


def test_archive_query(spark):
    library = Tokenizer.from_file(WORDS)
    at = 0
    want = []
    for r in spark.read.parquet(f"{SF}/documents.parquet").orderBy("doc_id").collect():
        ids = np.array([*library.encode(r.text or "", add_special_tokens=False).ids, 1], "<u4")
        want.append((r.doc_id, at, len(ids), zlib.crc32(ids.tobytes())))
        at += len(ids)
    got = QUERIES["op13_token_archive"](spark, SF).select("doc_id", "start", "n_tokens", "ids_crc32").orderBy("doc_id")
    assert list(map(tuple, got.collect())) == want

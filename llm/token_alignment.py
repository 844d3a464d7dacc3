"""Cross-tokenizer alignment: tokens of two tokenizers over the same bytes, linked where they overlap.

A is a byte-level BPE of the ``tokenizers`` library over space+text, B a ``sentencepiece`` model
over the text (it adds that space). All documents of a batch are merged in step: one state vector
holds an A and a B pointer per document; a step links the two tokens pointed at, notes a cut
where both end, moves the pointers whose token ends first, and drops finished documents from the
vector. A long document takes several places in the vector, each from one A token's end to
another's, so the number of steps does not grow with the longest text.

Counts of id pairs cover the whole corpus. They are summed per task and then by a shuffle on the
pair. Documents look their pairs up in two ways with one meaning: the most frequent pairs (at most
``head_pairs``) travel to the tasks as two sorted arrays; rarer pairs, each of them at most one
in ``head_pairs`` of all links, meet their counts in a shuffle join.

Defined cases: a null or empty text, and one whose joined A or B bytes differ from space+text, has
no tokens: zeros and empty groups. Special tokens' strings are plain text. Repeated rows and ids
are rows of their own and count each time. Ties for the highest count are all best. Texts of any
length pass; one text is held by one task. An empty table gives an empty table. Other columns of the input
play no part, whatever their names.
"""

from __future__ import annotations

import functools
import itertools
import json
import operator
import re
from array import array

import numpy as np
import pyarrow as pa
from pyspark import SparkFiles
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from llm.chunk_cache import ChunkCache, dealt, one_thread_each
from llm.words import sliced
from phishlake.sources.workdir import materialised, work_dir

#: Up to so many pairs (17 bytes each) are sent to every task.
HEAD_PAIRS = 1 << 20
#: A tokens of one place in the state vector.
LANE = 512
#: Distinct pairs a task holds while it counts.
HELD_PAIRS = 1 << 21
#: From one single space between two words to the next; other white space stays inside.
_CHUNK = re.compile(r"(?: ?\S+|\s+\S*)(?:(?! \S)\s+\S*)*")


def byte_level_alphabet() -> dict[str, int]:
    """The byte that each character of a byte-level vocabulary stands for (fixed by the format)."""
    plain = [*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)]
    others = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(others)}


def piece_bytes(piece: str) -> bytes:
    if re.fullmatch("<0x[0-9A-F]{2}>", piece):
        return bytes([int(piece[3:5], 16)])
    return piece.replace("▁", " ").encode()


class TokenizerPair:
    """Both tokenizers, the bytes of their tokens, and ids of texts by way of a chunk cache."""

    def __init__(self, a_path: str, b_path: str):
        one_thread_each()
        import sentencepiece
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(a_path)
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_file=b_path)
        alphabet = byte_level_alphabet()
        size = self.a.get_vocab_size(with_added_tokens=True)
        entries = [self.a.id_to_token(i) or "" for i in range(size)]
        self.a_bytes = [bytes(alphabet[c] for c in e) if all(c in alphabet for c in e) else e.encode() for e in entries]
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        self.b_bytes = [piece_bytes(p) for p in pieces]
        self.a_size = np.array(list(map(len, self.a_bytes)), np.int64)
        self.b_size = np.array(list(map(len, self.b_bytes)), np.int64)
        self.names = [str(i) + end for end in ",|;" for i in range(max(len(entries), len(pieces)))]
        with open(a_path, encoding="utf-8") as file:
            shape = json.load(file)
        split = shape.get("pre_tokenizer") or {}
        self.space = next(c for c, b in alphabet.items() if b == 0x20)
        self.cuts = (shape.get("normalizer") is None and split.get("type") == "ByteLevel" and split.get("use_regex")
                     and not any(re.search("[^▁]▁", p) for p in pieces))
        #: Neither tokenizer joins a word to the space after it, or the whole text is one chunk.
        self.find = _CHUNK.findall if self.cuts else lambda text: [text]
        self.cache = ChunkCache(self.encode_chunks)

    def _a_ids(self, chunks: list[str]) -> list[list[int]]:
        """A's ids; a space and plain letters are one piece to A, spelt as they are but for the space."""
        plain = [self.cuts and c.isascii() and c[1:].isalpha() and c[0] == " " for c in chunks]
        rest = iter(self.a.encode_batch_fast(list(itertools.compress(chunks, map(operator.not_, plain))), add_special_tokens=False))
        merge = self.a.model.tokenize
        return [[t.id for t in merge(self.space + c[1:])] if known else next(rest).ids
                for c, known in zip(chunks, plain, strict=True)]

    def encode_chunks(self, chunks: list[str]) -> list[tuple[bytes, bytes] | tuple[()]]:
        """Ids of A and B as 32-bit integers; nothing where either's bytes are not the chunk's."""
        ids = (self._a_ids(chunks), self.b.encode([c[1:] for c in chunks], num_threads=1))
        raw = [c.encode() for c in chunks]
        whole, sizes = b"".join(raw), np.fromiter(map(len, raw), np.int64, len(raw))
        flat, same = [], True
        for side, of in zip(ids, (self.a_bytes, self.b_bytes), strict=True):
            every = list(itertools.chain.from_iterable(side))
            ends = np.cumsum(np.fromiter(map(len, side), np.int64, len(side)))
            read = np.concatenate([[0], np.cumsum(np.fromiter(map(len, map(of.__getitem__, every)), np.int64, len(every)))])
            same &= b"".join(map(of.__getitem__, every)) == whole and (read[ends] == np.cumsum(sizes)).all()
            data = array("i", every).tobytes()
            ends = (ends * 4).tolist()
            flat.append([data[x:y] for x, y in itertools.pairwise([0, *ends])])
        out = list(zip(*flat, strict=True))
        if not same:  # rare: find the chunks
            for k, want in enumerate(raw):
                if any(b"".join(map(of.__getitem__, side[k])) != want
                       for side, of in zip(ids, (self.a_bytes, self.b_bytes), strict=True)):
                    out[k] = ()
        return out

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(A ids, A bounds, B ids, B bounds) of all texts end to end."""
        found = [self.find(" " + text) if text else [] for text in texts]
        bounds = np.concatenate([[0], np.cumsum(np.fromiter(map(len, found), np.int64, len(found)))])
        values, place = self.cache.look(pa.array(itertools.chain.from_iterable(found), pa.large_string(), size=int(bounds[-1])))
        if () in values:  # a text with such a chunk has no tokens
            bad = np.fromiter((not v for v in values), bool, len(values))
            text_of = np.repeat(np.arange(len(texts)), np.diff(bounds))
            gone = np.zeros(len(texts), bool)
            gone[text_of[bad[place]]] = True
            place = place[~gone[text_of]]
            bounds = np.concatenate([[0], np.cumsum(np.where(gone, 0, np.diff(bounds)))])
            values = [v or (b"", b"") for v in values]
        out = []
        for side in (0, 1):
            ids, ends = dealt([v[side] for v in values], place, bounds, np.int32)
            out += [ids.astype(np.int64), ends]
        return tuple(out)


def merge_in_step(a_end: np.ndarray, b_end: np.ndarray, a_bounds: np.ndarray, b_bounds: np.ndarray,
                  lane: int = LANE) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Links and cuts of all documents, whose tokens lie end to end on one byte axis.

    Returns (A token, B token) of every link, and masks of the A and B tokens at whose end both
    tokenizers end.
    """
    sizes = np.diff(a_bounds)
    places = -(-sizes // lane)
    nth = np.arange(places.sum()) - np.repeat(np.cumsum(places) - places, places)
    a = np.repeat(a_bounds[:-1], places) + nth * lane
    stop = np.minimum(a + lane, np.repeat(a_bounds[1:], places))
    # the B token that holds the first byte of the place
    b = np.where(nth == 0, np.repeat(b_bounds[:-1], places),
                 np.searchsorted(b_end, np.where(a > 0, a_end[a - 1], 0) if len(a) else a, side="right"))
    a_cut, b_cut = np.zeros(len(a_end), bool), np.zeros(len(b_end), bool)
    links_a, links_b = [], []
    while len(a):
        ends_a, ends_b = a_end[a], b_end[b]
        links_a.append(a)
        links_b.append(b)
        both = ends_a == ends_b
        a_cut[a[both]] = True
        b_cut[b[both]] = True
        a = a + (ends_a <= ends_b)
        b = b + (ends_b <= ends_a)
        live = a < stop
        if not live.all():
            a, b, stop = a[live], b[live], stop[live]
    none = np.zeros(0, np.int64)
    return np.concatenate([none, *links_a]), np.concatenate([none, *links_b]), a_cut, b_cut


def aligned(pair: TokenizerPair, texts: list[str]) -> dict[str, pa.Array]:
    """Counts, groups and linked id pairs of every text."""
    a_ids, a_bounds, b_ids, b_bounds = pair.encode(texts)
    n = len(texts)
    link_a, link_b, a_cut, b_cut = merge_in_step(
        np.cumsum(pair.a_size[a_ids]), np.cumsum(pair.b_size[b_ids]), a_bounds, b_bounds)

    # groups as text: A ids, a bar, B ids; every token's place is its own number plus the other side's before it
    a_group = np.cumsum(a_cut) - a_cut
    b_group = np.cumsum(b_cut) - b_cut
    a_upto = np.cumsum(np.bincount(a_group, minlength=int(a_cut.sum())))
    b_upto = np.concatenate([[0], np.cumsum(np.bincount(b_group, minlength=int(b_cut.sum())))])
    width = len(pair.names) // 3
    names = np.zeros(len(a_ids) + len(b_ids), np.int64)
    names[np.arange(len(a_ids)) + b_upto[a_group]] = a_ids + np.where(a_cut, width, 0)
    names[np.arange(len(b_ids)) + a_upto[b_group]] = b_ids + np.where(b_cut, 2 * width, 0)
    named = list(map(pair.names.__getitem__, names.tolist()))
    bounds = (a_bounds + b_bounds).tolist()
    groups = ["".join(named[x:y])[:-1] for x, y in itertools.pairwise(bounds)]

    # distinct id pairs of every text with the number of links that hold them
    doc = np.searchsorted(a_bounds, link_a, side="right") - 1
    code = a_ids[link_a] * len(pair.b_bytes) + b_ids[link_b]
    span = len(pair.a_bytes) * len(pair.b_bytes)
    keys, times = np.unique(doc * span + code, return_counts=True)
    per_doc = np.concatenate([[0], np.cumsum(np.bincount(keys // span, minlength=n))]).astype(np.int32)
    return {
        "n_a": pa.array(np.diff(a_bounds)), "n_b": pa.array(np.diff(b_bounds)),
        "n_groups": pa.array(np.diff(np.concatenate([[0], np.cumsum(a_cut)])[a_bounds])),
        "n_links": pa.array(np.bincount(doc, minlength=n).astype(np.int64)),
        "groups": pa.array(groups, pa.string()),
        "pairs": pa.ListArray.from_arrays(pa.array(per_doc), pa.array(keys % span)),
        "times": pa.ListArray.from_arrays(pa.array(per_doc), pa.array(times.astype(np.int32))),
    }


@functools.lru_cache(maxsize=2)
def _pair(a_name: str, b_name: str) -> TokenizerPair:
    return TokenizerPair(SparkFiles.get(a_name), SparkFiles.get(b_name))


def align(docs: DataFrame, a_file: str, b_file: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: key, n_a, n_b, n_groups, n_links, groups, pairs, times; no shuffle.

    ``groups`` reads ``a1,a2|b1;a3|b2,b3``: ids of A and B between two cuts. ``pairs`` holds the
    distinct linked id pairs as ``A id * (number of B ids) + B id``, ``times`` their links. The two files
    (paths on the driver) are shipped to the executors; their size does not depend on the data.
    """
    context = docs.sparkSession.sparkContext
    names = []
    for file in (a_file, b_file):
        context.addFile(file)
        names.append(file.rstrip("/").rsplit("/", 1)[-1])

    def run(batches):
        pair = _pair(*names)
        for batch in batches:
            for part in sliced(batch, "text", 1 << 20):
                out = aligned(pair, [t or "" for t in part.column("text").to_pylist()])
                yield pa.RecordBatch.from_arrays([part.column("key"), *out.values()], ["key", *out])

    named = docs.select(F.col(key).alias("key"), F.col(text).alias("text"))
    kind = named.schema["key"].dataType.simpleString()
    return named.mapInArrow(
        run, f"key {kind}, n_a long, n_b long, n_groups long, n_links long, groups string, "
        "pairs array<long>, times array<int>").withColumnRenamed("key", key)


def stored(rows: DataFrame) -> DataFrame:
    """``align``'s rows written once to the shared folder; id pairs are most of them, so packed well."""
    path = work_dir(rows.sparkSession, "aligned")
    rows.write.option("compression", "zstd").parquet(path)
    return rows.sparkSession.read.schema(rows.schema).parquet(path)


def pair_counts(rows: DataFrame, b_ids: int) -> DataFrame:
    """(pair, n, best) over all rows: n links hold the pair, best if none of its B id's pairs has more."""
    def run(batches):
        held, size = [], 0

        def summed():
            pairs, at = np.unique(np.concatenate([p for p, _ in held]), return_inverse=True)
            return pairs, np.bincount(at, np.concatenate([t for _, t in held]), len(pairs)).astype(np.int64)

        def batch_of(pairs, n):
            return pa.RecordBatch.from_arrays([pa.array(pairs), pa.array(n)], ["pair", "n"])
        for batch in batches:
            pairs = batch.column("pairs").flatten().to_numpy(zero_copy_only=False)
            held.append((pairs, batch.column("times").flatten().to_numpy(zero_copy_only=False).astype(np.int64)))
            size += len(pairs)
            if size > 2 * HELD_PAIRS:
                held = [summed()]
                size = len(held[0][0])
                if size > HELD_PAIRS:
                    yield batch_of(*held[0])
                    held, size = [], 0
        if held:
            yield batch_of(*summed())

    counts = rows.select("pairs", "times").mapInArrow(run, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n"))
    counts = materialised(counts, "pair-counts")
    # one row per B id: bounded by the vocabulary
    top = counts.groupBy((F.col("pair") % b_ids).alias("b")).agg(F.max("n").alias("most"))
    return counts.join(F.broadcast(top), F.col("pair") % b_ids == F.col("b")).select(
        "pair", "n", (F.col("n") == F.col("most")).alias("best"))


def _head(counts: DataFrame, most: int):
    """(pairs, n, best) of the most frequent pairs as sorted arrays, and whether these are all.

    The frequency from which a pair belongs to the head is a power of two, found from the number of pairs per power.
    """
    power = F.length(F.bin("n"))
    per_power = sorted((r[0], r[1]) for r in counts.groupBy(power.alias("power")).count().collect())
    total, least = 0, 0
    for at, many in reversed(per_power):
        if total + many > most:
            least = at + 1
            break
        total += many
    head = counts.where(power >= least).toArrow()
    pairs, n, best = (head.column(c).to_numpy() for c in ("pair", "n", "best"))
    order = np.argsort(pairs)
    return (pairs[order], n[order], best[order]), least == 0


def link_scores(rows: DataFrame, b_ids: int, head_pairs: int = HEAD_PAIRS) -> DataFrame:
    """``rows`` (stored rows of ``align``) without pairs, with n_best and count_sum.

    count_sum adds up over the row's links how often the corpus links their pair of ids; n_best
    counts the links whose pair has its B id's highest count.
    """
    spark = rows.sparkSession
    counts = materialised(pair_counts(rows, b_ids), "counts")
    head, whole = _head(counts, head_pairs)
    sent = spark.sparkContext.broadcast(head)

    def run(batches):
        known, n, best = sent.value
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                pairs = part.column("pairs").flatten().to_numpy(zero_copy_only=False)
                times = part.column("times").flatten().to_numpy(zero_copy_only=False).astype(np.int64)
                row = np.repeat(np.arange(part.num_rows), part.column("pairs").value_lengths().to_numpy(zero_copy_only=False))
                place = np.minimum(np.searchsorted(known, pairs), max(len(known) - 1, 0))
                found = known[place] == pairs if len(known) else np.zeros(len(pairs), bool)
                n_best, count_sum = np.zeros(part.num_rows, np.int64), np.zeros(part.num_rows, np.int64)
                np.add.at(n_best, row[found], times[found] * best[place[found]])
                np.add.at(count_sum, row[found], times[found] * n[place[found]])
                ends = np.concatenate([[0], np.cumsum(np.bincount(row[~found], minlength=part.num_rows))]).astype(np.int32)
                rest = [pa.ListArray.from_arrays(pa.array(ends), pa.array(v[~found])) for v in (pairs, times)]
                kept = [part.column(c) for c in part.schema.names if c not in ("pairs", "times")]
                yield pa.RecordBatch.from_arrays([*kept, pa.array(n_best), pa.array(count_sum), *rest], names)

    plain = [c for c in rows.columns if c not in ("pairs", "times")]
    names = [*plain, "n_best", "count_sum", "rare", "rare_times"]
    kinds = ", ".join(f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in plain)
    scored = rows.select(*plain, "pairs", "times").mapInArrow(
        run, f"{kinds}, n_best long, count_sum long, rare array<long>, rare_times array<long>")
    if whole:
        return scored.drop("rare", "rare_times")
    scored = materialised(scored.withColumn("_row", F.monotonically_increasing_id()), "scored")
    rare = scored.select("_row", F.explode(F.arrays_zip("rare", "rare_times")).alias("link")).select(
        "_row", F.col("link.rare").alias("pair"), F.col("link.rare_times").alias("times"))
    more = rare.join(counts, "pair").groupBy("_row").agg(
        F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).alias("_best"),
        F.sum(F.col("times") * F.col("n")).alias("_sum"))
    return scored.join(more, "_row", "left").select(
        *plain, (F.col("n_best") + F.coalesce("_best", F.lit(0))).alias("n_best"),
        (F.col("count_sum") + F.coalesce("_sum", F.lit(0))).alias("count_sum"))

"""Token-ID archive: ids of a corpus as Simple-8b segments in ascending order of document ids.

Documents are dealt to tasks by ranges of their id and sorted there; each task encodes its texts
with the ``tokenizers`` library, ends every document with the end id, and packs whole documents
into segments (``llm/simple8b.py``). A segment is one row of a Parquet folder with its place: the
range's number, its number in the range and the ids of the range before it. Readers add the ids
of all ranges before, one number per task of the writer, and decode segments on their own.

Defined cases: a null or empty text is a document of one id, the end id. Null document ids come
first. Repeated ids are documents of their own, ordered by a hash of their text; equal rows take
consecutive places. Texts of any length pass; a document is never split between segments, and
one text is held by one task. An empty table gives an empty archive. Other columns of the input play
no part, whatever their names.
"""

from __future__ import annotations

import functools
import itertools
import json
import operator
from array import array

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import SparkFiles, TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from llm.chunk_cache import ChunkCache, dealt, one_thread_each
from llm.simple8b import from_segment, to_segment
from llm.words import sliced
from phishlake.sources.workdir import work_dir

#: A segment ends after the document that reaches so many ids.
SEGMENT_IDS = 1 << 19
#: Text that is encoded at once, and the cache of words (each of its two generations).
SLICE_BYTES = 8 << 20
CACHE_BYTES = 128 << 20


#: The shape of a tokenizer whose texts may be cut at spaces and between a word and the points after it: it
#: drops white space and folds case, and its pattern never joins letters to anything else, an apostrophe
#: with certain letters apart (fixed value, from the public vocabulary file).
WORD_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
POINTS_AFTER_A_WORD = r"(\pL)([,.;:!?)]+)( |$)"


def _parts_words(shape: dict) -> bool:
    steps = (shape.get("normalizer") or {}).get("normalizers", [])
    split = ((shape.get("pre_tokenizer") or {}).get("pretokenizers") or [{}])[0]
    return ([s["type"] for s in steps] == ["NFC", "Replace", "Lowercase"] and split.get("type") == "Split"
            and split.get("behavior") == "Removed" and split.get("pattern") == {"Regex": WORD_PATTERN})


class LibraryTokenizer:
    """Ids of texts; words are encoded once and looked up where the tokenizer is known to part them."""

    def __init__(self, path: str):
        one_thread_each()
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as file:
            self.parts_words = _parts_words(json.load(file))
        self.cache = ChunkCache(self._encode, CACHE_BYTES)

    def _encode(self, chunks: list[str]) -> list[bytes]:
        if not self.parts_words:
            return [array("I", c.ids).tobytes() for c in self.library.encode_batch_fast(chunks, add_special_tokens=False)]
        # a word of plain small letters passes the steps before the library's merges unchanged and in one piece
        plain = [c.isascii() and c.isalpha() and c.islower() for c in chunks]
        rest = iter(self.library.encode_batch_fast(list(itertools.compress(chunks, map(operator.not_, plain))), add_special_tokens=False))
        merge = self.library.model.tokenize
        return [array("I", [t.id for t in merge(c)] if known else next(rest).ids).tobytes()
                for c, known in zip(chunks, plain, strict=True)]

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts end to end, bounds); a null text has none."""
        texts = texts.cast(pa.large_string()).fill_null("")
        if not self.parts_words:
            values, place = self.cache.look(texts)
            return dealt(values, place, np.arange(len(texts) + 1))
        spaced = pc.replace_substring_regex(texts, POINTS_AFTER_A_WORD, r"\1 \2\3")
        split = pc.split_pattern(spaced, " ")
        bounds = split.offsets.to_numpy().astype(np.int64)
        words = split.flatten()
        # case may be folded early in words of plain letters; special tokens' strings are of a fixed case
        folds = pc.and_(pc.string_is_ascii(words), pc.invert(pc.match_substring(words, "<|")))
        values, place = self.cache.look(pc.if_else(folds, pc.ascii_lower(words), words))
        return dealt(values, place, bounds - bounds[0])


@functools.lru_cache(maxsize=2)
def _tokenizer(name: str) -> LibraryTokenizer:
    return LibraryTokenizer(SparkFiles.get(name))


def write(docs: DataFrame, tokenizer_file: str, end_id: int, key: str = "doc_id", text: str = "text",
          segment_ids: int = SEGMENT_IDS) -> str:
    """Write the archive to a fresh shared folder and return its path.

    The tokenizer's file (a path on the driver) is shipped to the executors.
    """
    spark = docs.sparkSession
    spark.sparkContext.addFile(tokenizer_file)
    name = tokenizer_file.rstrip("/").rsplit("/", 1)[-1]

    def run(batches):
        tokenizer = _tokenizer(name)
        part, seq, before = TaskContext.get().partitionId(), 0, 0
        keys, ids, lengths, held = [], [], [], 0

        def segment():
            values = np.concatenate(ids)
            return pa.RecordBatch.from_arrays(
                [pa.array([part], pa.int32()), pa.array([seq], pa.int32()), pa.array([before], pa.int64()),
                 pa.array([len(values)], pa.int64()),
                 pa.ListArray.from_arrays(pa.array([0, len(lengths)], pa.int32()), pa.concat_arrays(keys)),
                 pa.array([to_segment(values, np.array(lengths))], pa.binary())],
                ["part", "seq", "before", "n_ids", "keys", "data"])

        for batch in batches:
            for some in sliced(batch, "text", SLICE_BYTES):
                coded, ends = tokenizer.encode(some.column("text"))
                # the end id goes after every document
                coded = np.insert(coded, ends[1:], np.uint32(end_id))
                ends = ends + np.arange(len(ends))
                at = 0
                while at < some.num_rows:
                    # as many documents as the segment takes, the one that fills it included
                    to = min(int(np.searchsorted(ends, ends[at] + segment_ids - held)), some.num_rows)
                    to = max(to, at + 1)
                    keys.append(some.column("key").slice(at, to - at))
                    ids.append(coded[ends[at]:ends[to]])
                    lengths += np.diff(ends[at:to + 1]).tolist()
                    held += int(ends[to] - ends[at])
                    at = to
                    if held >= segment_ids:
                        yield segment()
                        seq, before = seq + 1, before + held
                        keys, ids, lengths, held = [], [], [], 0
        if lengths:
            yield segment()

    named = docs.select(F.col(key).alias("key"), F.col(text).alias("text"))
    kind = named.schema["key"].dataType.simpleString()
    order = [F.asc_nulls_first("key"), F.xxhash64("text")]
    # equal rows are dealt out too: any order of theirs reads the same
    dealt = named.repartitionByRange(*order, F.monotonically_increasing_id()).sortWithinPartitions(*order)
    path = work_dir(spark, "token-archive")
    dealt.mapInArrow(run, f"part int, seq int, before long, n_ids long, keys array<{kind}>, data binary").write.option(
        "compression", "zstd").parquet(path)
    return path


def read(spark: SparkSession, path: str, key: str = "doc_id") -> DataFrame:
    """(key, start, ids) of every document: ids before it in the archive, and its own as little-endian 32-bit integers."""
    segments = spark.read.parquet(path)
    # one row per task of the writer
    totals = sorted(segments.groupBy("part").agg(F.sum("n_ids").alias("n")).collect())
    sums = np.cumsum([0, *(r.n for r in totals)]).tolist()
    bases = spark.createDataFrame(
        [(r.part, s) for r, s in zip(totals, sums, strict=False)], "part int, base long")
    kind = segments.schema["keys"].dataType.elementType.simpleString()

    def run(batches):
        for batch in batches:
            for at in range(batch.num_rows):
                values, lengths = from_segment(batch.column("data")[at].as_py())
                ends = np.concatenate([[0], np.cumsum(lengths)])
                ids = pa.BinaryArray.from_buffers(
                    pa.binary(), len(lengths),
                    [None, pa.py_buffer((ends * 4).astype(np.int32)), pa.py_buffer(values.astype("<u4"))])
                yield pa.RecordBatch.from_arrays(
                    [batch.column("keys")[at].values, pa.array(batch.column("start")[at].as_py() + ends[:-1]), ids],
                    ["key", "start", "ids"])

    placed = segments.join(F.broadcast(bases), "part").select("keys", (F.col("base") + F.col("before")).alias("start"), "data")
    return placed.mapInArrow(run, f"key {kind}, start long, ids binary").withColumnRenamed("key", key)

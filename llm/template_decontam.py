"""Benchmark decontamination by template canonicalisation.

Tokens are runs of letters and digits in lower case; numbers, capitalised names inside sentences
and unit words become typed placeholders. Windows of ``width`` template tokens of the documents
are hash-joined with those of the benchmark items; each run of windows on one diagonal of a
document and an item is then checked slot by slot: one benchmark value must map to one document
value of the same type, so a re-parameterised question matches and a chance mixture does not.
Windows with placeholders are joined by their words as they are too (case folded), so a verbatim
passage matches whatever its case makes of its names and however many numbers it holds.

The benchmark's window hashes are sent to the tasks as a filter while there are at most
``filter_windows`` of them; beyond that the same windows meet in a shuffle join.

Defined cases: null texts have no windows; items shorter than ``width`` are one window of their
own length, items shorter than ``least`` tokens are no evidence; a template window needs literal
words in at least half its places; equal items all match; rows of one id with different texts are judged
apart; a null document id is a value like others in the filter and absent from the report. Case is folded for ASCII and Latin-1 letters.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from llm.words import PUNCTUATED, Words, sliced, spans, text_bytes, whole_spans

# Words that count as units.
UNITS = (
    "cm celsius cent cents centimeter centimeters centimetre centimetres day days degree degrees dollar dollars euro "
    "euros fahrenheit feet foot ft g gallon gallons gram grams hour hours inch inches kg kilogram kilograms kilometer "
    "kilometers kilometre kilometres km l lb lbs liter liters litre litres meter meters metre metres mg mile miles "
    "milligram milligrams minute minutes ml mm month months ounce ounces oz percent pound pounds second seconds week "
    "weeks yard yards year years"
)
NUMBER, NAME, UNIT = 1, 2, 3
_MARKS = np.array([0, 0xA5A5A5A5A5A5A5A1, 0xA5A5A5A5A5A5A5A2, 0xA5A5A5A5A5A5A5A3], np.uint64)
_END = np.zeros(256, np.int64)
_END[list(b".!?:\n")] = 1
_DIGIT = np.zeros(256, np.int64)
_DIGIT[list(b"0123456789")] = 1


def _lower(flat: np.ndarray) -> np.ndarray:
    low = flat.copy()
    low[(flat >= 0x41) & (flat <= 0x5A)] += 32
    after = np.flatnonzero(flat[:-1] == 0xC3) + 1
    after = after[(flat[after] >= 0x80) & (flat[after] <= 0x9E) & (flat[after] != 0x97)]
    low[after] += 0x20
    return low


def _hashes_of(words: list[str]) -> np.ndarray:
    return np.sort(Words(*text_bytes(pa.array(words))).hash)


class _Template:
    """Template tokens of every text: hashes, slot types and token bounds."""

    def __init__(self, column: pa.Array):
        self.flat, bounds = text_bytes(column)
        self.low = low = _lower(self.flat)
        self.words = words = Words(low, bounds, PUNCTUATED)

        def inside(table_values):
            total = np.concatenate([[0], np.cumsum(table_values)])
            return total[words.ends] - total[words.starts]

        size = words.ends - words.starts
        changed = inside(low != self.flat)
        big = low[words.starts] != self.flat[words.starts]
        big |= (self.flat[words.starts] == 0xC3) & (low[np.minimum(words.starts + 1, len(low) - 1)] != self.flat[np.minimum(words.starts + 1, len(low) - 1)])
        ends = np.concatenate([[0], np.cumsum(_END[self.flat])])
        opens = np.ones(len(words), bool)
        opens[1:] = ends[words.starts[1:]] > ends[words.ends[:-1]]
        opens[words.first[:-1][words.counts > 0]] = True
        self.kind = np.zeros(len(words), np.int64)
        self.kind[big & (changed == 1) & (size > 1) & ~opens] = NAME
        known = _hashes_of(UNITS.split())
        at = np.minimum(np.searchsorted(known, words.hash), len(known) - 1)
        self.kind[known[at] == words.hash] = UNIT
        self.kind[inside(_DIGIT[self.flat]) == size] = NUMBER
        self.hash = np.where(self.kind > 0, _MARKS[self.kind], words.hash)

    def slots(self, at: int, width: int) -> list[str]:
        """Type, place and value of every slot of a window."""
        out = []
        for i in range(at, at + width):
            if self.kind[i]:
                value = self.low[self.words.starts[i]:self.words.ends[i]].tobytes().decode(errors="replace")
                out.append(f"{i - at}:{self.kind[i]}:{value}")
        return out


_WINDOWS = "hash long, width int, owner long, mark long, at int, slots array<string>, tokens int"


def _windows(column, owner, mark, widths, wanted: np.ndarray | None, own_width: bool, least: int, most: int):
    """Windows of every text as a batch; ``own_width`` gives texts below ``most`` one window.

    A window with placeholders comes twice: as template, and verbatim without slots.
    """
    template = _Template(column)
    counts = template.words.counts
    of = template.words.doc_of()
    literal = np.concatenate([[0], np.cumsum(template.kind == 0)])
    parts = []
    for width in widths:
        fit = whole_spans(template.words, width)[:max(len(template.words) - width + 1, 0)]
        if own_width:
            fit &= (counts[of[:len(fit)]] == width) if width < most else True
            fit &= counts[of[:len(fit)]] >= least
        words_in = literal[width:][:len(fit)] - literal[:len(fit)]
        for hashes, usable, verbatim in ((template.hash, 2 * words_in >= width, False),
                                         (template.words.hash, words_in < width, True)):
            h, ok = spans(hashes, width, salt=width), fit & usable
            if wanted is not None and len(h):
                ok &= wanted[1][(h >> np.uint64(44)).astype(np.int64)]
                at = np.flatnonzero(ok)
                near = np.minimum(np.searchsorted(wanted[0], h[at]), len(wanted[0]) - 1)
                at = at[wanted[0][near] == h[at]]
            else:
                at = np.flatnonzero(ok)
            slotted = (words_in[at] < width) & (not verbatim)
            slots = [template.slots(i, width) if s else [] for i, s in zip(at.tolist(), slotted.tolist(), strict=True)]
            parts.append(pa.RecordBatch.from_arrays([
                pa.array(h[at].view(np.int64)), pa.array(np.full(len(at), width, np.int32)), owner.take(pa.array(of[at])),
                mark.take(pa.array(of[at])), pa.array((at - template.words.first[of[at]]).astype(np.int32)),
                pa.array(slots, pa.list_(pa.string())), pa.array(counts[of[at]].astype(np.int32))],
                ["hash", "width", "owner", "mark", "at", "slots", "tokens"]))
    return parts


def template_windows(texts: DataFrame, widths: list[int], wanted=None, own_width: bool = False,
                     least: int = 6, most: int = 12) -> DataFrame:
    """Windows of (owner, mark, text)."""
    def run(batches):
        hashes = None
        if wanted is not None:
            known = wanted.value
            table = np.zeros(1 << 20, bool)
            table[(known >> np.uint64(44)).astype(np.int64)] = True
            hashes = (known, table)
        for batch in batches:
            for part in sliced(batch, "text"):
                yield from _windows(part.column("text"), part.column("owner"), part.column("mark"), widths, hashes,
                                    own_width, least, most)
    return texts.select("owner", "mark", "text").mapInArrow(run, _WINDOWS)


def contaminated(docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text",
                 item: str = "item_id", item_text: str = "text", width: int = 12, least: int = 6,
                 filter_windows: int = 1_000_000) -> DataFrame:
    """(key, mark, item, n_windows, exact): documents that hold an item, slots consistent.

    ``mark`` is the hash of the text (rows of one id may differ); ``exact`` tells whether every
    slot has the item's own value.
    """
    items = benchmark.select(F.col(item).cast("long").alias("owner"), F.lit(0).cast("long").alias("mark"),
                             F.col(item_text).alias("text"))
    texts = docs.select(F.col(key).cast("long").alias("owner"), F.xxhash64(F.col(text)).alias("mark"),
                        F.col(text).alias("text"))
    every = list(range(least, width + 1))
    index = template_windows(items, every, own_width=True, least=least, most=width)
    shape = index.agg(F.collect_set("width"), F.count("*")).first()
    widths, wanted = sorted(shape[0]), None
    if shape[1] <= filter_windows:
        hashes = np.array([r.hash for r in index.select("hash").distinct().collect()], np.int64).view(np.uint64)
        wanted = docs.sparkSession.sparkContext.broadcast(np.sort(hashes))
    found = template_windows(texts, widths, wanted, least=least, most=width)
    index = index.select("hash", "width", F.col("owner").alias("item"), F.col("at").alias("item_at"),
                         F.col("slots").alias("item_slots"))
    pairs = F.expr(
        "transform(slots, (x, i) -> struct(substring_index(item_slots[i], ':', -1) AS was, "
        "split(x, ':')[1] AS type, substring_index(x, ':', -1) AS now))")
    lined = (
        found.drop("tokens").join(index, ["hash", "width"])
        .withColumn("pairs", pairs).withColumn("diagonal", F.col("at") - F.col("item_at"))
    )
    # a window without a match ends a run; a window that matches both ways counts once
    line = W.partitionBy("owner", "mark", "item", "diagonal").orderBy("at")
    runs = (
        lined.withColumn("before", F.lag("at").over(line))
        .withColumn("run", F.sum(F.when(F.col("at") - F.col("before") <= 1, 0).otherwise(1)).over(line))
        .groupBy("owner", "mark", "item", "diagonal", "run")
        .agg(F.size(F.collect_set("at")).cast("long").alias("n_windows"),
             F.array_distinct(F.flatten(F.collect_set("pairs"))).alias("pairs"))
    )
    sources = F.size(F.array_distinct(F.expr("transform(pairs, p -> struct(p.was, p.type))")))
    return (
        runs.where(sources == F.size("pairs"))
        .groupBy("owner", "mark", "item")
        .agg(F.sum("n_windows").alias("n_windows"), F.max(F.expr("forall(pairs, p -> p.was = p.now)")).alias("exact"))
        .withColumnRenamed("owner", key).withColumnRenamed("item", item)
    )


def remove_contaminated(docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text",
                        **options) -> DataFrame:
    """The rows of ``docs`` that hold no item, all columns unchanged."""
    bad = contaminated(docs, benchmark, key, text, **options).select(
        F.col(key).alias("_key"), F.col("mark").alias("_mark")).distinct()
    same = F.col(key).cast("long").eqNullSafe(F.col("_key")) & (F.xxhash64(F.col(text)) == F.col("_mark"))
    return docs.join(bad, same, "left_anti")

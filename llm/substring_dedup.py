"""Substring dedup by De Bruijn compaction.

Windows of ``k`` words are the edges of a De Bruijn graph over word (k-1)-mers. Edges are dealt
out by their minimizer (the smallest-hash run of ``seed`` words inside), so equal edges meet in
one place and consecutive edges of a document that share a minimizer travel as one row. A minimizer
under which more than ``HOT_WINDOWS`` different windows may meet is split by the windows' own hash,
so equal edges still meet but no minimizer is one task. There,
edges that an earlier document also has are compacted into local paths that advance in step with
their source coordinates; a Spark window over each document glues local paths into maximal
repeated spans, and a join on the document applies them to the text. Edges travel as packed rows, texts
compressed.

Defined cases: a null text has no words; a document with a null id is never reduced and counts as
nobody's source; equal ids never reduce each other, whatever their texts; repeated rows give
repeated results; a text of fewer than ``k`` words stays whole. Other columns pass through.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from llm.frames import materialised, with_twin
from llm.words import Words, by_size, joined, mix, sliced, spans, text_bytes, whole_spans

SLICE = 600_000  # bytes of text that are windowed at once, about
HOT_WINDOWS = 250_000  # windows that one anchor holds, about; more are split by their hash
MOST_BINS = 1 << 22  # bins of anchors that a task counts at most
_EDGES = "edge binary"
_PATHS = "doc long, twin int, at int, n int, src_doc long, src_at int"


class Layout:
    """Bytes of an edge row: anchor, document, place (big-endian, so they sort), whether others ride along,
    windows, then the riders' documents and places and their number.

    Documents count from the smallest id in as many bytes as the range of ids asks for; a place is a
    word number, behind the number of the twin where ids repeat.
    """

    ANCHOR, WINDOW, COUNT = 4, 8, 4

    def __init__(self, least: int, most: int, twins: bool):
        self.least = least
        self.doc = max(1, ((most - least).bit_length() + 7) // 8)
        self.place = 8 if twins else 4
        self.rider = self.doc + self.place
        self.head = self.ANCHOR + self.rider + 1

    def where(self, doc: np.ndarray, place: np.ndarray) -> np.ndarray:
        """Rows of bytes of documents and places."""
        from_least = doc.view(np.uint64) - np.uint64(self.least % 2**64)  # wraps: right for any two ids
        return np.concatenate([_big(from_least, self.doc), _big(place, self.place)], 1)

    def doc_place(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        doc = _from_big(rows[:, :self.doc]).view(np.uint64) + np.uint64(self.least % 2**64)
        return doc.view(np.int64), _from_big(rows[:, self.doc:])


def _big(x: np.ndarray, width: int) -> np.ndarray:
    return np.ascontiguousarray(x).astype(">u8").view(np.uint8).reshape(-1, 8)[:, 8 - width:]


def _from_big(rows: np.ndarray) -> np.ndarray:
    whole = np.zeros((len(rows), 8), np.uint8)
    whole[:, 8 - rows.shape[1]:] = rows
    return whole.view(">u8").ravel().astype(np.int64)


def _span(begin: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The places begin .. begin + size - 1 of every entry, one after the other."""
    ends = np.cumsum(size)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(begin - (ends - size), size)


def _slide_min(x: np.ndarray, w: int) -> np.ndarray:
    """Minimum of every run of ``w`` values."""
    done, out = 1, x
    while done < w:
        step = min(done, w - done)
        out = np.minimum(out[:-step], out[step:])
        done += step
    return out


def _anchor_bins(texts: DataFrame, k: int, seed: int, bins: int) -> DataFrame:
    """(bin, n): windows per bin of anchors, those that a slice holds more than once counted once."""
    def run(batches):
        total = np.zeros(bins, np.int64)
        for batch in batches:
            for part in sliced(batch, "text", SLICE):
                words = Words(*text_bytes(part.column("text")))
                if len(words) < k:
                    continue
                ok = whole_spans(words, k)[:len(words) - k + 1]
                _, one = np.unique(spans(words.hash, k)[ok], return_index=True)
                low = _slide_min(spans(words.hash, seed), k - seed + 1)[ok][one]
                total += np.bincount((low % np.uint64(bins)).astype(np.int64), minlength=bins)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], ["bin", "n"])
    return texts.select("text").mapInArrow(run, "bin long, n long")


def hot_anchors(docs: DataFrame, k: int, seed: int) -> tuple[int, np.ndarray, np.ndarray]:
    """(bins, hot bins in order, parts of each): bins of anchors with too many windows.

    The bins grow with the rows up to ``MOST_BINS``, so that only frequent anchors lift one over the
    limit: ``HOT_WINDOWS``, or eight times the mean of all bins. So at most an eighth of the bins is hot,
    and what the driver reads and sends is bounded whatever the input.
    """
    known = docs.where("doc is not null")
    bins = min(MOST_BINS, 1 << max(16, (known.count() // 64).bit_length()))
    counts = materialised(_anchor_bins(known, k, seed, bins).groupBy("bin").agg(F.sum("n").alias("n")), "anchors")
    total = counts.agg(F.sum("n")).first()[0] or 0
    limit = max(HOT_WINDOWS, 8 * total // bins)
    hot = counts.where(F.col("n") > limit).orderBy("bin").collect()
    return bins, np.array([r.bin for r in hot], np.int64), np.array([-(-r.n // limit) for r in hot], np.uint64)


def _split(low: np.ndarray, hashes: np.ndarray, hot) -> np.ndarray:
    """Anchors, those of hot bins spread over the bin's parts by the hash of the window."""
    if hot is None or not len(hot[1]):
        return low
    bins, known, parts = hot
    here = (low % np.uint64(bins)).astype(np.int64)
    near = np.minimum(np.searchsorted(known, here), len(known) - 1)
    at = np.flatnonzero(known[near] == here)
    low = low.copy()
    low[at] = mix(low[at] ^ mix(hashes[at] % parts[near[at]] + np.uint64(1)))
    return low


def _edges_of(batch: pa.RecordBatch, k: int, seed: int, layout: Layout, hot=None) -> pa.RecordBatch | None:
    """Runs of windows with one anchor; equal runs of a slice become one row."""
    batch = batch.filter(batch.column("doc").is_valid())
    if not batch.num_rows:
        return None
    words = Words(*text_bytes(batch.column("text")))
    if len(words) < k:
        return None
    ok = whole_spans(words, k)[:len(words) - k + 1]
    hashes = spans(words.hash, k)
    low = _split(_slide_min(spans(words.hash, seed), k - seed + 1), hashes, hot)
    head = ok.copy()
    head[1:] &= ~ok[:-1] | (low[1:] != low[:-1])
    start = np.flatnonzero(head)
    if not len(start):
        return None
    run = np.cumsum(head)[ok] - 1
    size = np.bincount(run, minlength=len(start))
    packed = hashes[ok].astype("<u8").view(np.uint8).reshape(-1, 8)
    owner = words.doc_of()[start]
    doc = batch.column("doc").to_numpy()[owner]
    twin = batch.column("twin").to_numpy()[owner].astype(np.int64)
    place = (start - words.first[owner]) | (twin << 32)
    anchor = low[start]
    del words, low, head
    # equal runs in this slice: the one of the smallest document stays, the rest ride along
    ends = np.concatenate([[0], np.cumsum(size)])
    step = (np.arange(len(run)) - ends[run]).astype(np.uint64)
    inside = np.add.reduceat(mix(hashes[ok] + mix(step)), ends[:-1])  # all windows: ends alone do not fix a long run
    same = spans(np.stack([anchor, inside, hashes[start], size.astype(np.uint64)], 1).ravel(), 4)[::4]
    order = np.lexsort((place, doc, same))
    lead = np.concatenate([[True], same[order][1:] != same[order][:-1]])
    heads = order[lead]
    riders, host = order[~lead], (np.cumsum(lead) - 1)[~lead]
    held = np.bincount(host, minlength=len(heads))
    rode = held > 0
    body = size[heads] * layout.WINDOW
    row_ends = np.concatenate([[0], np.cumsum(
        layout.head + body + np.where(rode, held * layout.rider + layout.COUNT, 0))])
    begin = row_ends[:-1]
    flat = np.zeros(row_ends[-1], np.uint8)
    width = np.arange(layout.head)
    flat[begin[:, None] + width] = np.concatenate([
        _big(anchor[heads] >> np.uint64(32), layout.ANCHOR), layout.where(doc[heads], place[heads]),
        rode.astype(np.uint8)[:, None]], 1)
    windows = _span(ends[heads], size[heads])
    at = begin + layout.head
    flat[_span(at, body)] = packed[windows].ravel()
    at = at + body
    flat[_span(at, held * layout.rider)] = layout.where(doc[riders], place[riders]).ravel()
    at = (at + held * layout.rider)[rode]
    flat[at[:, None] + np.arange(layout.COUNT)] = _big(held[rode], layout.COUNT)
    edge = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(heads), [
        None, pa.py_buffer(row_ends.astype(np.int64)), pa.py_buffer(flat)]).cast(pa.binary())
    return pa.RecordBatch.from_arrays([edge], ["edge"])


def layout_of(docs: DataFrame) -> Layout:
    least, most, twin = docs.agg(F.min("doc"), F.max("doc"), F.max("twin")).first()
    return Layout(least or 0, most or 0, bool(twin))


def edges(docs: DataFrame, k: int, seed: int, layout: Layout) -> DataFrame:
    """Edge rows of columns doc, twin, text."""
    shared = docs.sparkSession.sparkContext.broadcast(hot_anchors(docs, k, seed))

    def run(batches):
        hot = shared.value
        for batch in batches:
            for part in sliced(batch, "text", SLICE):
                out = _edges_of(part, k, seed, layout, hot)
                if out is not None:
                    yield out
    return docs.select("doc", "twin", "text").mapInArrow(run, _EDGES)


def _binary(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, size of every entry)."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    _, ends, data = column.cast(pa.large_binary()).buffers()
    bounds = np.frombuffer(ends, np.int64)[column.offset:column.offset + len(column) + 1]
    flat = np.frombuffer(data, np.uint8)[bounds[0]:bounds[-1]] if data is not None else np.zeros(0, np.uint8)
    return flat, np.diff(bounds)


def _first_of(anchor: np.ndarray, window: np.ndarray) -> np.ndarray:
    """Index of the first equal (anchor, window) for every entry."""
    key = anchor * np.uint64(0x9E3779B97F4A7C15) ^ window * np.uint64(0xC2B2AE3D27D4EB4F)
    order = np.argsort(key, kind="stable")
    sorted_key = key[order]
    new = np.concatenate([[True], sorted_key[1:] != sorted_key[:-1]])
    first = np.empty(len(key), np.int64)
    first[order] = order[new][np.cumsum(new) - 1]
    if np.any(anchor[first] != anchor) or np.any(window[first] != window):  # mixed keys clashed
        order = np.lexsort((np.arange(len(key)), window, anchor))
        a, w = anchor[order], window[order]
        new = np.concatenate([[True], (a[1:] != a[:-1]) | (w[1:] != w[:-1])])
        first[order] = order[new][np.cumsum(new) - 1]
    return first


def _paths_of(doc, place, row, step, src_doc, src_place) -> pa.RecordBatch:
    """Runs of windows (entries of one ``row``, consecutive ``step``) that follow one source."""
    hit = np.flatnonzero(src_doc < doc)
    doc, row, step, src_doc, src_place, place = (x[hit] for x in (doc, row, step, src_doc, src_place, place))
    new = np.ones(len(hit), bool)
    new[1:] = ((row[1:] != row[:-1]) | (step[1:] != step[:-1] + 1) | (src_doc[1:] != src_doc[:-1])
               | (src_place[1:] != src_place[:-1] + 1))
    at = np.flatnonzero(new)
    size = np.diff(np.append(at, len(hit)))
    where = place[at]
    return pa.RecordBatch.from_arrays(
        [pa.array(doc[at]), pa.array((where >> 32).astype(np.int32)),
         pa.array((where & 0xFFFFFFFF).astype(np.int32)), pa.array(size.astype(np.int32)),
         pa.array(src_doc[at]), pa.array((src_place[at] & 0xFFFFFFFF).astype(np.int32))],
        ["doc", "twin", "at", "n", "src_doc", "src_at"])


def _local_paths(layout: Layout):
    """Rows come sorted by anchor and document, so the first equal window is the source.

    Between batches only the distinct windows of the anchor still open are held.
    """
    def run(batches):
        none = np.zeros(0, np.uint64)
        held = (none, none, np.zeros(0, np.int64), np.zeros(0, np.int64))
        for batch in batches:
            if not batch.num_rows:
                continue
            flat, size = _binary(batch.column("edge"))
            begin = np.cumsum(size) - size
            head = flat[begin[:, None] + np.arange(layout.head)]
            anchors = _from_big(head[:, :layout.ANCHOR]).view(np.uint64)
            docs, places = layout.doc_place(head[:, layout.ANCHOR:-1])
            rode = np.flatnonzero(head[:, -1])
            last = (begin + size)[rode]
            riders = np.zeros(len(size), np.int64)
            riders[rode] = _from_big(flat[(last - layout.COUNT)[:, None] + np.arange(layout.COUNT)])
            body = size - layout.head - riders * layout.rider
            body[rode] -= layout.COUNT
            size = body // layout.WINDOW
            row = np.repeat(np.arange(len(size)), size)
            step = _span(np.zeros(len(size), np.int64), size)
            n_held = len(held[0]) if len(held[0]) and held[0][0] == anchors[0] else 0
            held = tuple(x[:n_held] for x in held)
            anchor = np.concatenate([held[0], anchors[row]])
            window = np.concatenate([held[1], flat[_span(begin + layout.head, body)].view("<u8")])
            doc = np.concatenate([held[2], docs[row]])
            place = np.concatenate([held[3], places[row] + step])
            first = _first_of(anchor, window)
            src = first[n_held:]
            yield _paths_of(docs[row], place[n_held:], row, step, doc[src], place[src])
            if len(rode):
                more = flat[_span(begin + layout.head + body, riders * layout.rider)].reshape(-1, layout.rider)
                more_doc, more_place = layout.doc_place(more)
                host = np.repeat(np.arange(len(riders)), riders)
                entry = np.repeat(np.arange(len(host)), size[host])
                at = _span(np.zeros(len(host), np.int64), size[host])
                source = src[_span((np.cumsum(size) - size)[host], size[host])]
                yield _paths_of(more_doc[entry], more_place[entry] + at, entry, at, doc[source], place[source])
            open_now = np.flatnonzero((anchor == anchors[-1]) & (first == np.arange(len(first))))
            held = tuple(x[open_now] for x in (anchor, window, doc, place))
    return run


def repeated_spans(docs: DataFrame, k: int = 13, seed: int = 4) -> DataFrame:
    """Maximal spans of windows that follow an earlier document.

    Columns doc, twin, at (first window's word), n (windows), src_doc, src_at: words
    at .. at+n+k-2 equal those from src_at in src_doc.
    """
    layout = layout_of(docs)
    anchor = F.substring("edge", 1, Layout.ANCHOR)
    local = (
        edges(docs, k, seed, layout).repartition(anchor).sortWithinPartitions("edge")
        .mapInArrow(_local_paths(layout), _PATHS)
    )
    by_doc = W.partitionBy("doc", "twin").orderBy("at")
    before = F.lag(F.struct("at", "n", "src_doc", "src_at")).over(by_doc)
    glued = (
        (F.col("at") == F.col("_b.at") + F.col("_b.n")) & (F.col("src_doc") == F.col("_b.src_doc"))
        & (F.col("src_at") == F.col("_b.src_at") + F.col("_b.n"))
    )
    return (
        local.withColumn("_b", before)
        .withColumn("_path", F.sum(F.when(glued, 0).otherwise(1)).over(by_doc))
        .groupBy("doc", "twin", "_path")
        .agg(F.min("at").alias("at"), F.sum("n").cast("int").alias("n"),
             F.min("src_doc").alias("src_doc"), F.min("src_at").alias("src_at"))
        .drop("_path")
    )


def _small(batches):
    """Texts compressed one by one: half the bytes in the shuffle that meets them with their spans."""
    pack = zstandard.ZstdCompressor(level=1).compress
    for batch in batches:
        for part in sliced(batch, "text"):
            texts = part.column("text").cast(pa.large_binary()).to_pylist()
            at = part.schema.get_field_index("text")
            yield part.set_column(at, "text", pa.array([None if t is None else pack(t) for t in texts], pa.binary()))


def _plain(batch: pa.RecordBatch):
    """Slices with their texts back, bounded by the size of the texts."""
    sizes = [0 if t is None else zstandard.frame_content_size(t) for t in batch.column("text").to_pylist()]
    unpack = zstandard.ZstdDecompressor().decompress
    for part in by_size(batch, np.concatenate([[0], np.cumsum(sizes)])):
        texts = [None if t is None else unpack(t) for t in part.column("text").to_pylist()]
        at = part.schema.get_field_index("text")
        yield part.set_column(at, "text", pa.array(texts, pa.large_binary()).view(pa.large_string()))


def _cut(k: int, rejoin: bool):
    def run(batches):
        for batch in batches:
            for part in _plain(batch):
                flat, bounds = text_bytes(part.column("text"))
                words = Words(flat, bounds)
                edge = np.zeros(len(words) + 1, np.int64)
                cuts = part.column("cuts")
                pairs = cuts.flatten()
                if len(pairs):
                    owner = np.repeat(np.arange(part.num_rows), cuts.value_lengths().fill_null(0).to_numpy())
                    at = pairs.field("at").to_numpy() + words.first[owner]
                    np.add.at(edge, at, 1)
                    np.add.at(edge, at + pairs.field("n").to_numpy() + k - 1, -1)
                keep = np.cumsum(edge[:-1]) == 0
                total = np.concatenate([[0], np.cumsum(~keep)])[words.first]
                columns = {name: part.column(name) for name in part.schema.names if name not in ("cuts", "text")}
                columns["n_words"] = pa.array(words.counts.astype(np.int64))
                columns["n_removed"] = pa.array(np.diff(total).astype(np.int64))
                kept = joined(words, flat, keep)
                columns["kept"] = kept if rejoin else pc.if_else(
                    pc.greater(columns["n_removed"], 0), kept.cast(pa.large_string()), part.column("text"))
                columns["kept"] = columns["kept"].cast(pa.string())
                yield pa.RecordBatch.from_arrays(list(columns.values()), list(columns))
    return run


def dedup_substrings(docs: DataFrame, key: str = "doc_id", text: str = "text", k: int = 13,
                     seed: int = 4, carry: tuple[str, ...] = (), rejoin: bool = True) -> DataFrame:
    """(key, carry, n_words, n_removed, kept): every text without its earlier-seen words.

    A word goes if a window of ``k`` words over it also starts in a document with a smaller
    id. ``kept`` joins the remaining words by one space; without ``rejoin`` a text that loses
    nothing stays as it is. One row per input row; ``carry`` names columns to pass through.
    """
    named = docs.select(F.col(key).cast("long").alias("doc"), F.col(text).alias("text"),
                        *(F.col(c).alias(f"carry_{c}") for c in carry))
    named = with_twin(named, "doc", "text")
    cuts = repeated_spans(named, k, seed).groupBy("doc", "twin").agg(
        F.collect_list(F.struct("at", "n")).alias("cuts"))
    held = T.StructType([f if f.name != "text" else T.StructField("text", T.BinaryType()) for f in named.schema])
    joined_ = named.mapInArrow(_small, held).join(cuts, ["doc", "twin"], "left").drop("twin")
    schema = T.StructType([f for f in joined_.schema if f.name not in ("text", "cuts")])
    schema = schema.add("n_words", "long").add("n_removed", "long").add("kept", "string")
    return joined_.mapInArrow(_cut(k, rejoin), schema).withColumnsRenamed(
        {"doc": key} | {f"carry_{c}": c for c in carry})

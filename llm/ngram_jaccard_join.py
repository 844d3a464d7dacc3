"""N-gram Jaccard self-join: MinHash banding at a fixed depth, then exact verification.

Every distinct text gets a similarity sketch of ``trees`` bands of ``depth`` values. One prefix
length serves all bands: the longest with which a pair at the threshold shares a band's prefix
with at least the target recall. This replaces the descent of an LSH forest, whose prefix would
adapt to each node. Rows of a node are tied to its smallest id
(never pair by pair), ties are closed to candidate groups, and every pair of texts inside a group
is compared exactly on shingle sets, in blocks bounded in shingles and in texts whose pairs never become rows:
blocks return link counts and a spanning forest of the verified links.

Defined cases: words are runs of non-blank characters, unchanged; a text of one to ``n - 1``
words is one shingle; a text without words (null, empty) is linked to nothing; exact copies are
joined once and counted; a null id is treated as one more id. Repeated rows of an id count once.
Other columns are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from llm.components import components
from llm.frames import materialised
from llm.words import mix, of_column, sliced, spans

SKETCH_SEED = 0x5DEECE66D
BLOCK_SHINGLES = 200_000  # shingles that one side of a block holds, about
BLOCK_TEXTS = 1_500  # texts of one side, about; matrices over the texts of two sides are dense


def shingles(words, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(hash, text number) of every distinct shingle, sorted by text and hash."""
    counts = words.counts
    of = words.doc_of()
    full = np.minimum(counts, n)[of]
    position = np.arange(len(words)) - words.first[:-1][of]
    out, owner = [], []
    for size in range(1, n + 1):  # sizes below n serve texts that are shorter than n words
        here = (full == size) & (position + size <= counts[of])
        if here.any():
            h = spans(words.hash, size, salt=size)
            at = np.flatnonzero(here)
            out.append(h[at])
            owner.append(of[at])
    if not out:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    h, owner = np.concatenate(out), np.concatenate(owner)
    order = np.lexsort((h, owner))
    h, owner = h[order], owner[order]
    new = np.concatenate([[True], (h[1:] != h[:-1]) | (owner[1:] != owner[:-1])])
    return h[new], owner[new]


def sketches(h: np.ndarray, owner: np.ndarray, texts: int, size: int) -> np.ndarray:
    """Fast similarity sketch (Dahlgaard, Knudsen, Thorup 2017): ``size`` values per text.

    Two texts agree in a value with probability equal to the Jaccard similarity of their sets,
    also for sets much smaller than ``size``. Rounds of one-permutation hashing go on for the
    texts that still have empty slots; round ``size + i`` fills slot ``i`` for certain.
    """
    empty = np.uint64(2**64 - 1)
    out = np.full((texts, size), empty, np.uint64)
    filled_by_owner = np.zeros(texts, bool)
    filled_by_owner[owner] = True
    for turn in range(2 * size):
        if not len(h):
            break
        r = mix(h ^ np.uint64((SKETCH_SEED * (turn + 1)) % 2**64))
        slot = (r % np.uint64(size)).astype(np.int64) if turn < size else np.full(len(h), turn - size)
        value = (np.uint64(turn) << np.uint64(53)) | (r >> np.uint64(11))
        np.minimum.at(out.reshape(-1), owner * size + slot, value)
        open_texts = (out == empty).any(1)
        more = open_texts[owner]
        h, owner = h[more], owner[more]
    return out, filled_by_owner


def match_depth(threshold: float, trees: int, depth: int, recall: float) -> int:
    """Longest prefix with which pairs at the threshold reach the target recall."""
    while depth > 1 and 1 - (1 - threshold ** depth) ** trees < recall:
        depth -= 1
    return depth


def _sketched(n: int, trees: int, depth: int):
    def run(batches):
        for batch in batches:
            for part in sliced(batch, "text"):
                words = of_column(part.column("text"))
                h, owner = shingles(words, n)
                values, some = sketches(h, owner, part.num_rows, trees * depth)
                size = np.bincount(owner, minlength=part.num_rows)
                # equal sets: two sums over the set and its size tell copies
                key = np.zeros((2, part.num_rows), np.uint64)
                np.add.at(key[0], owner, h)
                np.add.at(key[1], owner, mix(h + np.uint64(1)))
                # two bytes of a value stand for it in a prefix
                flat = mix(values).astype("<u2")[some].tobytes()
                width = 2 * trees * depth
                bounds = (np.arange(some.sum() + 1) * width).astype(np.int32)
                yield pa.RecordBatch.from_arrays([
                    part.column("id").filter(pa.array(some)), pa.array(key[0][some].view(np.int64)),
                    pa.array(key[1][some].view(np.int64)), pa.array(size[some].astype(np.int64)),
                    pa.BinaryArray.from_buffers(pa.binary(), int(some.sum()), [
                        None, pa.py_buffer(bounds), pa.py_buffer(flat)])],
                    ["id", "set_a", "set_b", "size", "sketch"])
    return run


def _intersections(sets: list[np.ndarray]) -> np.ndarray:
    """Matrix of intersection sizes, by incidence matrices over bounded slices of shingles."""
    n = len(sets)
    if n == 2:
        both = len(np.intersect1d(sets[0], sets[1], assume_unique=True))
        return np.array([[len(sets[0]), both], [both, len(sets[1])]])
    h = np.concatenate(sets)
    row = np.repeat(np.arange(n), [len(s) for s in sets])
    order = np.argsort(h, kind="stable")
    h, row = h[order], row[order]
    new = np.concatenate([[True], h[1:] != h[:-1]])
    column = np.cumsum(new) - 1
    shared = np.bincount(column)[column] > 1
    row, column = row[shared], column[shared]
    total = np.zeros((n, n), np.float32)
    step = max(1, (8 << 20) // n)
    if len(column):
        column = np.cumsum(np.concatenate([[0], column[1:] != column[:-1]]))
        for low in range(0, int(column[-1]) + 1, step):
            a, b = np.searchsorted(column, (low, low + step))
            incidence = np.zeros((n, min(step, int(column[-1]) + 1 - low)), np.float32)
            incidence[row[a:b], column[a:b] - low] = 1
            total += incidence @ incidence.T
    return total.astype(np.int64)


def _block_links(rows, threshold: float):
    """Link counts and a spanning forest for one block or one pair of blocks."""
    ids, blocks, copies, sets = rows
    n = len(ids)
    both = _intersections(sets)
    size = np.array([len(s) for s in sets])
    union = size[:, None] + size[None, :] - both
    linked = both >= threshold * union - 1e-9
    np.fill_diagonal(linked, False)
    if len(set(blocks)) > 1:  # inside one block another task does it
        side = np.array(blocks) == blocks[0]
        linked &= side[:, None] != side[None, :]
    counts = linked @ np.array(copies)
    # spanning forest: breadth first over the linked matrix, one row of the matrix a step
    tie = np.full(n, -1)
    seen = np.zeros(n, bool)
    for root in range(n):
        if seen[root]:
            continue
        seen[root] = True
        front = [root]
        while front:
            at = front.pop()
            fresh = np.flatnonzero(linked[at] & ~seen)
            seen[fresh] = True
            tie[fresh] = at
            front.extend(fresh)
    return [(ids[i], ids[tie[i]] if tie[i] >= 0 else None, int(counts[i]))
            for i in range(n) if counts[i] or tie[i] >= 0]


def _verified(threshold: float):
    def run(batches):
        held, open_key = ([], [], [], []), None
        for batch in batches:
            keys = list(zip(*(batch.column(c).to_pylist() for c in ("group", "low", "high")), strict=True))
            ids, blocks, copies, packed = (batch.column(c).to_pylist() for c in ("id", "block", "copies", "shingles"))
            out = []
            for i, key in enumerate(keys):
                if key != open_key:
                    if len(held[0]) > 1:
                        out += _block_links(held, threshold)
                    held, open_key = ([], [], [], []), key
                for store, x in zip(held, (ids[i], blocks[i], copies[i], np.frombuffer(packed[i], "<u8")), strict=True):
                    store.append(x)
            if out:
                yield _links(out)
        if len(held[0]) > 1 and (out := _block_links(held, threshold)):
            yield _links(out)
    return run


def _links(rows) -> pa.RecordBatch:
    a, b, n = zip(*rows, strict=True)
    return pa.RecordBatch.from_arrays(
        [pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(n, pa.int64())], ["id", "other", "links"])


def _packed_shingles(n: int):
    def run(batches):
        for batch in batches:
            for part in sliced(batch, "text"):
                h, owner = shingles(of_column(part.column("text")), n)
                bounds = np.searchsorted(owner, np.arange(part.num_rows + 1)) * 8
                packed = pa.LargeBinaryArray.from_buffers(pa.large_binary(), part.num_rows, [
                    None, pa.py_buffer(bounds.astype(np.int64)), pa.py_buffer(h)]).cast(pa.binary())
                yield pa.RecordBatch.from_arrays(
                    [part.column(c) for c in ("id", "group", "copies", "blocks")] + [packed],
                    ["id", "group", "copies", "blocks", "shingles"])
    return run


def candidate_groups(reps: DataFrame, trees: int, depth: int, matched: int) -> DataFrame:
    """(id, group) for texts that share a trie node of depth ``matched`` with another one.

    ``sketch`` holds the values tree after tree, so a prefix is a slice of its bytes.
    """
    nodes = reps.select("id", F.explode(F.sequence(F.lit(0), F.lit(trees - 1))).alias("tree"), "sketch").select(
        "id", F.xxhash64("tree", F.expr(f"substring(sketch, tree * {2 * depth} + 1, {2 * matched})")).alias("node"))
    heads = nodes.groupBy("node").agg(F.min("id").alias("head"), F.max("id").alias("tail")).where("head < tail")
    ties = nodes.join(heads, "node").where("id > head").select("id", F.col("head").alias("other")).distinct()
    return components(ties).withColumnRenamed("root", "group")


def block_counts(members: DataFrame) -> DataFrame:
    """(group, blocks) of columns group, size: as many blocks as shingles or texts ask for."""
    return members.groupBy("group").agg(F.greatest(
        F.ceil(F.sum("size") / BLOCK_SHINGLES), F.ceil(F.count("*") / BLOCK_TEXTS)).cast("int").alias("blocks"))


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", n: int = 5,
                    threshold: float = 0.8, trees: int = 32, depth: int = 8,
                    recall: float = 0.9999) -> DataFrame:
    """(key, class_id, n_links): one row per distinct id.

    ``class_id`` is the smallest id of the connected class of links; ``n_links`` counts the
    other documents with a similarity of ``threshold`` or more, copies included.
    """
    named = docs.select(F.col(key).cast("long").alias("id"), F.col(text).alias("text"))
    every = named.select("id").distinct()
    marks = materialised(named.where("id is not null").mapInArrow(
        _sketched(n, trees, depth), "id long, set_a long, set_b long, size long, sketch binary"), "sketches")
    sets = ["set_a", "set_b", "size"]
    same = marks.groupBy(*sets).agg(F.min("id").alias("head"), F.count_distinct("id").alias("copies"))
    copies = materialised(
        marks.select("id", *sets).join(same, sets).select("id", "head", "copies"), "copies")
    first = copies.where("id = head").select("id", "copies").distinct()
    reps = marks.select("id", "sketch").dropDuplicates(["id"]).join(first.select("id"), "id", "left_semi")
    groups = candidate_groups(reps, trees, depth, match_depth(threshold, trees, depth, recall))
    groups = materialised(groups.join(first, "id"), "groups")
    sizes = marks.groupBy("id").agg(F.max("size").alias("size"))
    spread = block_counts(groups.join(sizes, "id"))
    members = groups.join(spread, "group").select("id", "group", "copies", "blocks")
    texts = named.join(members, "id").mapInArrow(
        _packed_shingles(n), "id long, group long, copies long, blocks int, shingles binary")
    block = F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int")
    dealt = (
        texts.withColumn("block", block)
        .withColumn("with", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        .withColumn("low", F.least("block", "with")).withColumn("high", F.greatest("block", "with"))
        .drop("with", "blocks")
    )
    links = materialised(
        dealt.repartition("group", "low", "high").sortWithinPartitions("group", "low", "high", "id")
        .mapInArrow(_verified(threshold), "id long, other long, links long"), "links")
    counts = links.groupBy("id").agg(F.sum("links").alias("links"))
    roots = components(links.where("other is not null").select("id", "other"))
    heads = first.join(counts, "id", "left").join(roots, "id", "left").select(
        F.col("id").alias("head"), F.coalesce("root", "id").alias("class"), F.coalesce("links", F.lit(0)).alias("far"))
    per_id = copies.join(heads, "head").groupBy("id").agg(
        F.min("class").alias("class_id"), F.max(F.col("far") + F.col("copies") - 1).alias("n_links"))
    return every.join(per_id, "id", "left").select(
        F.col("id").alias(key), F.coalesce("class_id", "id").alias("class_id"),
        F.coalesce("n_links", F.lit(0)).alias("n_links"))

"""Byte-level BPE encoding and decoding.

A piece (one match of the split pattern) is merged by a segment tree over its byte positions:
every leaf holds the rank of the pair that starts there, every node the leftmost minimum of its
children. A merge takes the root's pair, unlinks the right neighbour and updates the two changed
leaves and their paths to the root. Trees of many pieces of like length are rows of one array
and take their merges in step; those of few pieces are plain lists. Pieces seen before come from a
cache bounded in bytes.

Defined cases: a null text is empty and has no tokens; special tokens' strings are ordinary
text; texts of any length pass (one long piece is one tree: logarithmic work per merge); every row
of a repeated id is encoded on its own; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import base64
import functools

import numpy as np
import pyarrow as pa
import regex
from pyspark import SparkFiles
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from llm.chunk_cache import ENTRY_BYTES, LONGEST_KEPT
from llm.words import sliced

NO_PAIR = np.int64(2**62)
CACHE_BYTES = 256 << 20  # both generations of the cache of pieces, about
FEW = 32  # pieces; fewer are merged one by one


class PairTable:
    """rank of (left token, right token), vectorised: open addressing over packed pairs."""

    def __init__(self, ranks: dict[bytes, int]):
        left, right, out = [], [], []
        for token, rank in ranks.items():
            for cut in range(1, len(token)):
                a, b = ranks.get(token[:cut]), ranks.get(token[cut:])
                if a is not None and b is not None:
                    left.append(a)
                    right.append(b)
                    out.append(rank)
        keys = np.array(left, np.int64) << 32 | np.array(right, np.int64)
        self.bits = max(4, int(len(keys) * 2).bit_length())
        self.keys = np.full(1 << self.bits, -1, np.int64)
        self.ranks = np.full(1 << self.bits, NO_PAIR, np.int64)
        todo, at = np.arange(len(keys)), self._home(keys)
        while len(todo):
            free = self.keys[at[todo]] == -1
            self.keys[at[todo[free]]] = keys[todo[free]]
            placed = self.keys[at[todo]] == keys[todo]
            self.ranks[at[todo[placed]]] = np.array(out, np.int64)[todo[placed]]
            todo = todo[~placed]
            at[todo] = (at[todo] + 1) & ((1 << self.bits) - 1)

    def _home(self, keys):
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        keys = left << 32 | right
        at = self._home(keys)
        found = self.keys[at]
        out = np.where(found == keys, self.ranks[at], NO_PAIR)
        open_ = np.flatnonzero((found != keys) & (found != -1))
        while len(open_):
            at[open_] = (at[open_] + 1) & ((1 << self.bits) - 1)
            found = self.keys[at[open_]]
            hit = found == keys[open_]
            out[open_[hit]] = self.ranks[at[open_[hit]]]
            open_ = open_[~hit & (found != -1)]
        return out


class Vocabulary:
    """Ranks file of base64 tokens with their ids, and the split pattern."""

    def __init__(self, data: bytes, pattern: str):
        self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, data.splitlines()) if a}
        self.pairs = PairTable(self.ranks)
        self.byte_ids = np.array([self.ranks[bytes([b])] for b in range(256)], np.int64)
        self.words = {rank: token for token, rank in self.ranks.items()}
        self.find = regex.compile(pattern).findall
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}
        self.size = 0  # bytes that the young pieces take, about

    def merge(self, pieces: list[bytes]) -> list[bytes]:
        """Ids (little-endian unsigned 32-bit) of every piece."""
        out: list[bytes] = [b""] * len(pieces)
        groups: dict[int, list[int]] = {}
        for i, piece in enumerate(pieces):
            rank = self.ranks.get(piece)
            if rank is not None:
                out[i] = rank.to_bytes(4, "little")
            elif piece:
                groups.setdefault((len(piece) - 1).bit_length(), []).append(i)
        for level, members in groups.items():
            step = max(1, (1 << 18) >> level)
            for low in range(0, len(members), step):
                some = members[low:low + step]
                if len(some) < FEW:
                    for i in some:
                        out[i] = self._merge_one(pieces[i], 1 << level)
                    continue
                for i, ids in zip(some, self._merge_equal([pieces[i] for i in some], 1 << level), strict=True):
                    out[i] = ids
        return out

    @functools.cached_property
    def rank_of(self) -> dict[int, int]:
        used = self.pairs.keys >= 0
        return dict(zip(self.pairs.keys[used].tolist(), self.pairs.ranks[used].tolist(), strict=True))

    def _merge_one(self, piece: bytes, leaves: int) -> bytes:
        """The tree of one piece in plain lists: no array calls for each merge."""
        n, none = len(piece), int(NO_PAIR)
        start = self.byte_ids[np.frombuffer(piece, np.uint8)]
        shift = leaves.bit_length()
        rank = self.pairs.rank(start[:-1], start[1:])
        level = np.full(leaves, NO_PAIR, np.int64)
        level[:n - 1] = np.where(rank < NO_PAIR, rank << shift | np.arange(n - 1), NO_PAIR)
        levels = [level]
        while len(level) > 1:
            level = np.minimum(level[0::2], level[1::2])
            levels.append(level)
        tree = [none, *np.concatenate(levels[::-1]).tolist()]
        ids, rank_of, mask = start.tolist(), self.rank_of, (1 << shift) - 1
        right, left = list(range(1, n + 1)), list(range(-1, n - 1))

        def update(at: int, value: int) -> None:
            node = leaves + at
            tree[node] = value
            node >>= 1
            while node:
                value = min(tree[2 * node], tree[2 * node + 1])
                if tree[node] == value:
                    return
                tree[node] = value
                node >>= 1

        def pair(at: int, after: int) -> int:
            found = rank_of.get(ids[at] << 32 | ids[after])
            return none if found is None else found << shift | at

        while tree[1] < none:
            at = tree[1] & mask
            gone = right[at]
            ids[at] = tree[1] >> shift
            ids[gone] = -1
            after = right[at] = right[gone]
            if after < n:
                left[after] = at
            update(gone, none)
            update(at, pair(at, after) if after < n else none)
            if left[at] >= 0:
                update(left[at], pair(left[at], at))
        return np.array([i for i in ids if i >= 0], "<u4").tobytes()

    def _merge_equal(self, pieces: list[bytes], leaves: int) -> list[bytes]:
        n = len(pieces)
        size = np.array([len(p) for p in pieces])
        inside = np.arange(leaves) < size[:, None]
        raw = np.zeros((n, leaves), np.uint8)
        raw[inside] = np.frombuffer(b"".join(pieces), np.uint8)
        ids = self.byte_ids[raw]
        right = np.where(np.arange(1, leaves + 1) < size[:, None], np.arange(1, leaves + 1), leaves)
        left = np.tile(np.arange(-1, leaves - 1), (n, 1))
        # a leaf holds rank and position in one number, so the minimum is the leftmost one
        shift = max(1, int(leaves).bit_length())
        rank = np.full((n, leaves), NO_PAIR, np.int64)
        pair = np.flatnonzero((inside & (right < leaves)).ravel())
        rank.reshape(-1)[pair] = self.pairs.rank(ids.reshape(-1)[pair], ids.reshape(-1)[pair + 1])
        known = rank < NO_PAIR
        tree = np.full((n, 2 * leaves), NO_PAIR, np.int64)
        tree[:, leaves:][known] = (rank << shift | np.arange(leaves))[known]
        width = leaves
        while width > 1:
            level = tree[:, width:2 * width]
            width //= 2
            tree[:, width:2 * width] = np.minimum(level[:, 0::2], level[:, 1::2])
        alive = inside
        live = np.flatnonzero(tree[:, 1] < NO_PAIR)
        while len(live):
            best = tree[live, 1]
            at = best & ((1 << shift) - 1)
            gone = right[live, at]
            after = right[live, gone]
            ids[live, at] = best >> shift
            alive[live, gone] = False
            right[live, at] = after
            chained = after < leaves
            left[live[chained], after[chained]] = at[chained]
            tree[live, leaves + gone] = NO_PAIR
            before = left[live, at]
            for a, b in ((at, after), (before, at)):
                real = a >= 0
                pos = a[real]
                rows, nxt = live[real], b[real]
                new = np.full(len(rows), NO_PAIR, np.int64)
                ok = nxt < leaves
                r = self.pairs.rank(ids[rows[ok], pos[ok]], ids[rows[ok], nxt[ok]])
                new[ok] = np.where(r < NO_PAIR, r << shift | pos[ok], NO_PAIR)
                tree[rows, leaves + pos] = new
            for start in (gone, at, np.maximum(before, 0)):
                node = (leaves + start) >> 1
                while node[0]:
                    tree[live, node] = np.minimum(tree[live, 2 * node], tree[live, 2 * node + 1])
                    node = node >> 1
            live = live[tree[live, 1] < NO_PAIR]
        flat = ids[alive].astype("<u4").tobytes()
        ends = np.cumsum(alive.sum(1)) * 4
        return [flat[a:b] for a, b in zip(np.append(0, ends[:-1]), ends, strict=True)]

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of every text, by a cache of pieces in two generations: pieces in use survive."""
        split = [self.find(text) for text in texts]
        fresh = set().union(*split).difference(self.young)
        cost = sum(map(len, fresh)) * 2 + len(fresh) * ENTRY_BYTES
        if self.size + cost > CACHE_BYTES // 2:
            self.old, self.young, self.size = self.young, {}, 0
            fresh = set().union(*split)
        kept = fresh.intersection(self.old)
        self.young.update(zip(kept, map(self.old.__getitem__, kept), strict=True))
        new = list(fresh.difference(kept))
        self.young.update(zip(new, self.merge([p.encode() for p in new]), strict=True))
        look = self.young.__getitem__
        out = [b"".join(map(look, pieces)) for pieces in split]
        for piece in fresh:
            if len(piece) > LONGEST_KEPT:
                del self.young[piece]
        self.size += sum(2 * len(p) + ENTRY_BYTES for p in fresh if len(p) <= LONGEST_KEPT)
        return out

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.words.__getitem__, np.frombuffer(ids, "<u4").tolist()))


@functools.lru_cache(maxsize=2)
def _vocabulary(name: str, pattern: str) -> Vocabulary:
    with open(SparkFiles.get(name), "rb") as file:
        return Vocabulary(file.read(), pattern)


def tokenize(docs: DataFrame, ranks_file: str, pattern: str, key: str = "doc_id",
             text: str = "text") -> DataFrame:
    """(key, ids, decoded): token ids as little-endian unsigned 32-bit integers and the bytes they decode to.

    One row per input row and no shuffle. The ranks file (a path on the driver) is shipped to
    the executors; its size does not depend on the data.
    """
    context = docs.sparkSession.sparkContext
    context.addFile(ranks_file)
    name = ranks_file.rstrip("/").rsplit("/", 1)[-1]

    def run(batches):
        vocabulary = _vocabulary(name, pattern)
        for batch in batches:
            for part in sliced(batch, "text", 1 << 20):
                ids = vocabulary.encode([t or "" for t in part.column("text").to_pylist()])
                yield pa.RecordBatch.from_arrays(
                    [part.column("key"), pa.array(ids, pa.binary()),
                     pa.array([vocabulary.decode(i) for i in ids], pa.binary())], ["key", "ids", "decoded"])

    named = docs.select(F.col(key).alias("key"), F.col(text).alias("text"))
    kind = named.schema["key"].dataType.simpleString()
    return named.mapInArrow(run, f"key {kind}, ids binary, decoded binary").withColumnRenamed("key", key)

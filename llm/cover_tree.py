"""Cover tree over vectors that are lifted to one length, searched for the largest inner products.

A vector x becomes (x, sqrt(M^2 - |x|^2)), M being the greatest length, so all candidates lie on one
sphere and the distance d to a query (q, 0) tells the inner product: (|q|^2 + M^2 - d^2) / 2. A
node holds rows within a covering radius of its centre; its children are a net of its rows at a
radius smaller by ``BASE``, the node's own centre first. Children of few rows are put together,
in the order of their distance from the node's centre, as leaves between two radii around it.

Vectors are whole numbers; products are exact, bounds are loosened by more than their rounding.
"""

from __future__ import annotations

import io

import numpy as np

BASE = 1.3
LEAF = 64
NO_SCORE = np.iinfo(np.int64).min
NO_ID = np.iinfo(np.int64).max


def products(left: np.ndarray, right: np.ndarray, top: float) -> np.ndarray:
    """All inner products as 64-bit integers; ``top`` bounds the squared lengths."""
    if top < 2**53:
        return np.rint(left.astype(np.float64) @ right.T.astype(np.float64)).astype(np.int64)
    return left.astype(np.int64) @ right.T.astype(np.int64)


def _net(points: np.ndarray, rows: np.ndarray, radius: float, block: int = 64) -> list[np.ndarray]:
    """Rows dealt to centres more than ``radius`` apart, each within ``radius`` of its own, which comes first."""
    out, rest = [], rows
    while len(rest):
        some = rest[:block]
        near = _distances(points[some], points[some]) <= radius
        free, picks = np.ones(len(some), bool), []
        for i in range(len(some)):
            if free[i]:
                picks.append(i)
                free &= ~near[i]
        to_pick = _distances(points[rest], points[some[picks]])
        owner = to_pick.argmin(1)
        owner[picks] = np.arange(len(picks))
        taken = to_pick[np.arange(len(rest)), owner] <= radius
        taken[picks] = True
        for k, pick in enumerate(picks):
            members = rest[taken & (owner == k)]
            out.append(np.concatenate([[some[pick]], members[members != some[pick]]]))
        rest = rest[~taken]
    return out


def _distances(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    square = (left * left).sum(1)[:, None] + (right * right).sum(1) - 2 * (left @ right.T)
    return np.sqrt(np.maximum(square, 0))


class CoverTree:
    """Arrays over rows in leaf order (``vectors``, ``ids``, ``labels``) and over nodes, parents first."""

    PARTS = ("vectors", "ids", "labels", "centre", "least", "most", "parent", "first", "last", "leaf", "top")

    def __init__(self, **parts):
        for name in self.PARTS:
            setattr(self, name, parts[name])

    @classmethod
    def build(cls, vectors: np.ndarray, ids: np.ndarray, labels: np.ndarray, top: int) -> CoverTree:
        """``top`` is M^2 of the whole table, so trees of all shards bound alike."""
        order = np.argsort(ids, kind="stable")
        vectors, ids, labels = vectors[order], ids[order], labels[order]
        flat = vectors.astype(np.float64)
        lift = np.sqrt(np.maximum(float(top) - (flat * flat).sum(1), 0))
        points = np.concatenate([flat, lift[:, None]], 1)
        nodes, leaf_rows, at = [], [], 0  # (centre, least, most, parent, first, last, leaf)
        todo = [(np.arange(len(ids)), 0, -1)] if len(ids) else []  # rows, the first being the centre

        def add(centre, rows, parent, leaf):
            nonlocal at
            gap = _distances(points[[centre]], points[rows])[0]
            first, last = at, at
            if leaf:
                leaf_rows.append(np.sort(rows))
                at = last = at + len(rows)
            nodes.append((centre, gap.min(), gap.max(), parent, first, last, leaf))
            return len(nodes) - 1
        while todo:
            rows, depth, parent = todo.pop(0)
            gap = _distances(points[[rows[0]]], points[rows])[0]
            if len(rows) <= LEAF or gap.max() == 0:
                add(rows[0], rows, parent, True)
                continue
            here = add(rows[0], rows, parent, False)
            small = []
            for child in _net(points, rows, gap.max() / BASE):
                if len(child) > LEAF // 2:
                    todo.append((child, depth + 1, here))
                else:
                    small.append(child)
            if small:
                small = np.concatenate(small)
                far = _distances(points[[rows[0]]], points[small])[0]
                small = small[np.argsort(far, kind="stable")]
                for low in range(0, len(small), LEAF):
                    add(rows[0], small[low:low + LEAF], here, True)
        order = np.concatenate([np.zeros(0, np.int64), *leaf_rows]).astype(np.int64)
        table = np.array(nodes, np.float64).reshape(-1, 7)
        return cls(vectors=vectors[order], ids=ids[order], labels=labels[order], centre=vectors[table[:, 0].astype(np.int64)],
                   least=table[:, 1], most=table[:, 2], parent=table[:, 3].astype(np.int64), first=table[:, 4].astype(np.int64),
                   last=table[:, 5].astype(np.int64), leaf=table[:, 6] > 0, top=np.int64(top))

    def to_bytes(self) -> bytes:
        out = io.BytesIO()
        np.savez(out, **{name: getattr(self, name) for name in self.PARTS})
        return out.getvalue()

    @classmethod
    def from_bytes(cls, data: bytes) -> CoverTree:
        with np.load(io.BytesIO(data)) as parts:
            return cls(**{name: parts[name] for name in cls.PARTS})

    def search(self, found: Found) -> int:
        """Take this tree's rows into ``found``; returns the number of rows whose products were formed."""
        step = max(1, (1 << 21) // max(1, len(self.centre)))
        return sum(self._search(found, np.arange(low, min(low + step, len(found.queries))))
                   for low in range(0, len(found.queries) if len(self.ids) else 0, step))

    def _search(self, found: Found, asked: np.ndarray) -> int:
        queries = found.queries[asked].astype(np.float64)
        top = max(float(self.top), float(found.top))
        total = (queries * queries).sum(1)[:, None] + float(self.top)
        gap = np.sqrt(np.maximum(total - 2 * (queries @ self.centre.T.astype(np.float64)), 0))
        slack = 1e-6 * total + 1
        near = np.maximum(np.maximum(gap - self.most, self.least - gap), 0)
        upper = (total - near * near) / 2 + slack
        lower = (total - (gap + self.most) ** 2) / 2 - slack
        low, high = found.floor(asked), found.high[asked]
        open_ = (upper >= low[:, None]) & (lower <= high[:, None])
        for node in np.flatnonzero(~self.leaf):  # parents come first: what is closed closes all below
            open_[:, self.parent == node] &= open_[:, [node]]
        leaves = np.flatnonzero(self.leaf)
        key = np.where(open_[:, leaves], np.minimum(upper[:, leaves], high[:, None]), -np.inf)
        order = np.argsort(-key, axis=1, kind="stable")
        key = np.take_along_axis(key, order, 1)
        at, step, seen = 0, 1, 0
        while at < len(leaves):
            # the next best leaves of every query that may still find better there
            some = key[:, at:at + step]
            who, which = np.nonzero((some > -np.inf) & (some >= found.floor(asked)[:, None]))
            if not len(who):
                break
            leaf = leaves[order[who, at + which]]
            group = np.argsort(leaf, kind="stable")
            who, leaf = who[group], leaf[group]
            cuts = np.flatnonzero(np.diff(leaf, prepend=-1))
            for x, y in zip(cuts, np.append(cuts[1:], len(leaf)), strict=True):
                rows = slice(self.first[leaf[x]], self.last[leaf[x]])
                mine = asked[who[x:y]]
                found.take(mine, products(found.queries[mine], self.vectors[rows], top), self.ids[rows], self.labels[rows])
                seen += (y - x) * (rows.stop - rows.start)
            at, step = at + step, step * 2
        return seen


class Found:
    """The best ``k`` rows of every query so far: score in its window, and a label equal to its own or not.

    Rows with the query's own id are never found. Higher scores come first, then smaller ids.
    """

    def __init__(self, queries, ids, labels, k: int, same: bool, low=None, high=None, top: int = 0):
        n = len(queries)
        self.queries, self.ids, self.labels, self.k, self.same, self.top = queries, ids, labels, k, same, top
        self.low = np.full(n, NO_SCORE + 1) if low is None else low
        self.high = np.full(n, NO_ID) if high is None else high
        self.score = np.full((n, k), NO_SCORE)
        self.row = np.full((n, k), NO_ID)

    def of(self, some):
        """The queries ``some`` as a set of their own."""
        part = Found(self.queries[some], self.ids[some], self.labels[some], self.k, self.same, self.low[some],
                     self.high[some], self.top)
        part.score, part.row = self.score[some], self.row[some]
        return part

    def put(self, some, part) -> None:
        self.score[some], self.row[some] = part.score, part.row

    def floor(self, asked):
        """Scores below cannot count any more."""
        return np.maximum(self.low[asked], self.score[asked, -1])

    def take(self, asked, scores, ids, labels) -> None:
        fit = ((labels == self.labels[asked][:, None]) == self.same) & (ids != self.ids[asked][:, None])
        fit &= (scores >= self.floor(asked)[:, None]) & (scores <= self.high[asked][:, None])
        some = np.flatnonzero(fit.any(1))
        if not len(some):
            return
        asked = asked[some]
        score = np.concatenate([self.score[asked], np.where(fit[some], scores[some], NO_SCORE)], 1)
        row = np.concatenate([self.row[asked], np.where(fit[some], ids, NO_ID)], 1)
        # scores are never the least integer but where there is none, so they can be negated
        best = np.lexsort((row, np.where(score == NO_SCORE, NO_ID, -score)), axis=1)[:, :self.k]
        self.score[asked] = np.take_along_axis(score, best, 1)
        self.row[asked] = np.take_along_axis(row, best, 1)

    def rows(self):
        """(query, row id, score) of all that was found."""
        query, nth = np.nonzero(self.score != NO_SCORE)
        return query, self.row[query, nth], self.score[query, nth]

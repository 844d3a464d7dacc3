"""Hard-negative mining against all pairs, and the cover tree against plain products."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from llm.cover_tree import CoverTree, Found, _distances, _net
from llm.hard_negatives import _share, index, mine, whole_vectors


def plainly_mined(rows, every=50, positives=5, negatives=3):
    """(anchor, positive, rank, negative, scores) over Python integers."""
    some = []
    for i, vector, label in rows:
        if i is None or label is None or vector is None or any(x is None or not math.isfinite(x) for x in vector):
            continue
        whole = [math.floor(256 * float(np.float32(x))) for x in vector]
        if sum(x * x for x in whole) < 2**62:
            some.append((i, label, whole))
    out = []
    for i, label, q in some:
        if i % every:
            continue
        scored = sorted((-sum(a * b for a, b in zip(q, v, strict=False)), j, other) for j, other, v in some if j != i)
        best = [(j, -s) for s, j, other in scored if other == label][:positives]
        for j, p in best:
            fit = [(k, -s) for s, k, other in scored if other != label and 50 * p <= -100 * s <= 95 * p][:negatives]
            out += [(i, j, rank + 1, k, p, s) for rank, (k, s) in enumerate(fit)]
    return sorted(out)


def rows_of_all_kinds():
    rng = np.random.default_rng(8)
    centres = rng.normal(size=(12, 8))
    rows = []
    for i in range(900):
        vector = (centres[i % 12] + rng.normal(size=8) * 0.15).tolist()
        rows.append((i, vector, i % 5 if i % 3 else 0))
    rows += [(1000 + i, [0.5, 0.25, *[0.0] * 6], i % 3) for i in range(150)]  # copies, and ties all over
    rows += [(2000, None, 1), (2001, [1.0, None], 1), (2002, [float("nan")] * 8, 1), (2003, [float("inf")] * 8, 2),
             (2004, [0.1] * 8, None), (None, [0.1] * 8, 1), (2050, [], 1), (2051, [], 2), (2100, [1.0, 2.0], 3),
             (2150, [3e38] * 8, 1), (2200, [-0.5] * 8, 77), (2201, [0.5] * 8, 77), (2250, [0.3] * 8, 78),
             (2300, [0.2, 0.1] * 4, 1), (2300, [0.2, 0.1] * 4, 1), (2300, [0.1, 0.2] * 4, 2), (-50, [1.0] * 8, 4)]
    random.seed(1)
    random.shuffle(rows)
    return rows


@pytest.mark.parametrize(("shard_rows", "block"), [(8192, 16_384), (300, 7)])
def test_mined_rows_equal_all_pairs(spark, shard_rows, block):
    rows = rows_of_all_kinds()
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").repartition(4)
    frame = frame.withColumns({c: F.lit(1) for c in ("id", "vector", "cell", "shard", "query", "score", "rank", "parts", "_block")})
    taken = whole_vectors(frame)
    got = mine(taken, taken.where("id % 50 = 0"), shard_rows=shard_rows, block=block)
    want = plainly_mined(rows)
    assert len(want) > 100 and sorted(map(tuple, got.collect())) == want


def test_large_components_are_exact(spark):
    rng = np.random.default_rng(4)
    rows = [(i, (rng.integers(-2**21, 2**21, 4) * 1.0).tolist(), int(i) % 3) for i in range(120)]
    taken = whole_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int"))
    got = sorted(map(tuple, mine(taken, taken.where("id % 50 = 0"), shard_rows=40).collect()))
    assert got == plainly_mined(rows) and max(r[4] for r in got) > 2**53


def test_empty_tables(spark):
    none = whole_vectors(spark.createDataFrame([], "vec_id long, embedding array<float>, label int"))
    some = whole_vectors(spark.createDataFrame([(1, [1.0], 0), (3, [1.0], 1)], "vec_id long, embedding array<float>, label int"))
    assert mine(none, none).count() == 0
    assert mine(some, some.where("id = 0")).count() == 0
    assert mine(some, some).count() == 0  # no positives


def test_index_holds_every_row_once(spark):
    rows = rows_of_all_kinds()
    taken = whole_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")).repartition(3)
    trees = [(r.label, CoverTree.from_bytes(r.tree)) for r in index(taken, 200).collect()]
    assert len(trees) > 5 and any(label is None for label, _ in trees)
    assert sorted(i for _, t in trees for i in t.ids.tolist()) == sorted(r.id for r in taken.collect())


def test_nets_cover_and_separate():
    points = np.random.default_rng(2).normal(size=(700, 3))
    for radius in (0.3, 1.0, 5.0):
        net = _net(points, np.arange(700), radius)
        assert sorted(np.concatenate(net).tolist()) == list(range(700))
        assert all(_distances(points[[m[0]]], points[m]).max() <= radius for m in net)
        gap = _distances(points[[m[0] for m in net]], points[[m[0] for m in net]])
        assert (gap + np.eye(len(net)) * 99 > radius).all()


def test_clustered_rows_are_mostly_skipped():
    """Windows far from most nodes: few products are formed, and the answer is that of all of them."""
    rng = np.random.default_rng(6)
    centres = rng.normal(size=(40, 6)) * 200
    vectors = np.rint(np.repeat(centres, 200, 0) + rng.normal(size=(8000, 6))).astype(np.int64)
    ids, labels = np.arange(8000), np.zeros(8000, np.int64)
    tree = CoverTree.from_bytes(CoverTree.build(vectors, ids, labels, int((vectors**2).sum(1).max())).to_bytes())
    queries = vectors[::100]
    scores = queries @ vectors.T
    top = int((vectors**2).sum(1).max())
    low, high = np.full(len(queries), 20_000), scores.max(1) - 100
    for window in (None, (low, high)):
        found = Found(queries, ids[::100], np.ones(len(queries), np.int64), 4, False, *(window or (None, None)), top=top)
        seen = tree.search(found)
        assert seen < 0.2 * scores.size
        for q in range(len(queries)):
            fit = [(-s, i) for i, s in enumerate(scores[q].tolist())
                   if i != ids[::100][q] and (window is None or low[q] <= s <= high[q])]
            assert [(-s, i) for s, i in zip(found.score[q].tolist(), found.row[q].tolist(), strict=True) if i != 2**63 - 1] == sorted(fit)[:4]


def test_shares_of_scores_are_rounded_inwards():
    score = np.array([0, 1, 7, 100, 101, -1, -7, 2**61 + 3])
    assert _share(score, 50, True).tolist() == [-(-50 * int(s) // 100) for s in score]
    assert _share(score, 95, False).tolist() == [95 * int(s) // 100 for s in score]

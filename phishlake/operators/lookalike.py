"""Fuzzy host join: edit distance at most two, found through exact keys.

A target is cut into three pieces; two edits leave at least one piece intact,
moved by a small offset. So every close pair shares a (shape of the target, piece
number, piece text) key, the join is an equality join, and only its candidates
reach the edit-distance test. Results equal the all-pairs comparison.

The pieces share the name before the public ending (``.com``, ``.gov.uk``), which stays with
the last piece: an ending is common to many targets, so a piece that is little more than it finds
nearly all of them. A shape is the length of a target and of its ending.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from phishlake import fixed_values as fv
from phishlake.functions.hosts import fold_lookalikes
from phishlake.operators.lookups import ListTable, lookup_join

PIECES = fv.MAX_EDIT_DISTANCE + 1
#: A shape is one number: length * SHAPE + length of the ending.
SHAPE = 1_000
#: The last label, and a short one before it.
ENDING = r"((?:[.][^.]{1,3})?[.][^.]+)$"


def _shape(folded: str) -> Column:
    """Names of fewer than three characters are cut whole."""
    ending = F.length(F.regexp_extract(folded, ENDING, 1))
    return F.length(folded) * SHAPE + F.when((F.length(folded) - ending >= 3) & (ending < SHAPE), ending).otherwise(0)


def _piece_bounds(shape: Column) -> list[tuple[Column, Column]]:
    """(0-based start, length) of the three pieces of a target."""
    m = F.floor(shape / SHAPE).cast("int")
    name = m - shape % SHAPE
    one = F.floor(name / 3).cast("int")
    two = F.floor((name - one) / 2).cast("int")
    zero = F.lit(0)
    return [(zero, one), (one, two), (one + two, m - one - two)]


def _shifts(delta: int) -> list[int]:
    """Offsets a piece can have when the host is ``delta`` longer than the target."""
    k = fv.MAX_EDIT_DISTANCE
    return [s for s in range(-k, k + 1) if abs(s) + abs(delta - s) <= k]


def _key(shape: Column, no: int, piece: Column) -> Column:
    return F.struct(shape.alias("m"), F.lit(no).alias("no"), piece.alias("piece"))


def target_keys(targets: DataFrame) -> DataFrame:
    """(m, no, piece) -> target, three rows per target with a ``folded`` column; m is the shape."""
    pieces = F.array(*[
        _key(_shape("folded"), no, F.substr(F.col("folded"), start + 1, length))
        for no, (start, length) in enumerate(_piece_bounds(_shape("folded")))
    ])
    return targets.withColumn("_k", F.explode(pieces)).select("_k.*", *targets.columns)


def target_shapes(table: ListTable, min_len: int = 0) -> list[int]:
    """Shapes that occur among the targets: lengths of names and of their endings, a few hundred numbers."""
    shapes = lookalike_targets(table, min_len).select(_shape("folded").alias("m")).distinct()
    return sorted(r.m for r in shapes.collect())


def host_keys(folded: str, shapes: list[int]) -> Column:
    """Every (m, no, piece) key under which a close target could be filed.

    One small lambda over the list of (length difference, piece, offset) cases of every shape near the host's length.
    """
    k = fv.MAX_EDIT_DISTANCE
    cases = ", ".join(
        f"named_struct('delta', {delta}, 'no', {no}, 'shift', {shift})"
        for delta in range(-k, k + 1) for no in range(PIECES) for shift in _shifts(delta)
    )
    known = ", ".join(map(str, shapes or [-k * SHAPE * SHAPE]))
    return F.expr(f"""
        flatten(transform(transform(transform(
            filter(array({known}), m -> abs(length({folded}) - m div {SHAPE}) <= {k}),
            m -> named_struct('m', m, 'all', CAST(m div {SHAPE} AS int), 'name', CAST(m div {SHAPE} - m % {SHAPE} AS int))),
            t -> named_struct('m', t.m, 'all', t.all, 'one', CAST(t.name div 3 AS int),
                              'two', CAST((t.name - CAST(t.name div 3 AS int)) div 2 AS int))),
            t -> transform(filter(transform(
                filter(array({cases}), c -> c.delta = length({folded}) - t.all),
                c -> named_struct('no', c.no,
                    'at', c.shift + CASE c.no WHEN 0 THEN 0 WHEN 1 THEN t.one ELSE t.one + t.two END,
                    'len', CASE c.no WHEN 0 THEN t.one WHEN 1 THEN t.two ELSE t.all - t.one - t.two END)),
                c -> c.at >= 0 AND c.at + c.len <= length({folded})),
                c -> named_struct('m', t.m, 'no', c.no, 'piece', substr({folded}, c.at + 1, c.len)))))
    """)


def close_enough(folded_host: Column, folded_target: Column) -> Column:
    return F.levenshtein(folded_host, folded_target, fv.MAX_EDIT_DISTANCE) >= 0


def lookalike_targets(table: ListTable, min_len: int = 0) -> DataFrame:
    """High-value entries with their folded form."""
    return table.df.filter(F.col("high_value") & (F.length("domain") >= min_len)).withColumn(
        "folded", fold_lookalikes(F.col("domain")))


def candidates(hosts: DataFrame, host: str, table: ListTable, min_len: int = 0) -> DataFrame:
    """Hosts with every target that shares a key, to be tested."""
    targets = lookalike_targets(table, min_len).select(
        F.col("domain").alias("_target"), "folded", "ord")
    h = hosts.select(host, fold_lookalikes(F.col(host)).alias("_folded"))
    keys = F.array_distinct(host_keys("_folded", target_shapes(table, min_len)))
    keyed = h.select("*", F.explode(keys).alias("_k")).select(host, "_folded", "_k.*")
    return lookup_join(keyed, target_keys(targets), ["m", "no", "piece"], table.small)


def lookalike_pairs(hosts: DataFrame, host: str, table: ListTable,
                    min_len: int = 0) -> DataFrame:
    """(host, ord) of every close target; ``hosts`` has one distinct column.

    A target equal to the unfolded host is skipped.
    """
    hits = candidates(hosts, host, table, min_len)
    return (
        hits.filter(F.col("ord").isNotNull() & (F.col("_target") != F.col(host))
                    & close_enough(F.col("_folded"), F.col("folded")))
        .select(host, "ord").distinct()
    )

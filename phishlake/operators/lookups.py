"""Joining rows with reference lists.

A list is broadcast only when its row count has been checked; beyond the bound
the same join runs as a shuffle join with the hottest keys salted.
"""

from __future__ import annotations

from collections.abc import Iterable
from functools import cached_property

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import StructType

LOCAL_ROWS = 20_000
BROADCAST_ROWS = 200_000
ROWS_PER_SALT = 1_000_000
NULL_SALTS = 1_024


def local_frame(spark: SparkSession, rows: list[tuple], schema: StructType | str) -> DataFrame:
    """A small frame held as a local relation (no RDD, no Python workers)."""
    if isinstance(schema, str):
        schema = StructType.fromDDL(schema)
    columns = list(zip(*rows)) if rows else [() for _ in schema.fields]
    table = pa.Table.from_arrays(
        [pa.array(c, to_arrow_type(f.dataType)) for c, f in zip(columns, schema.fields)],
        names=schema.names,
    )
    return spark.createDataFrame(table, schema)


class ListTable:
    """A reference list keyed by ``domain`` (one row each), with its size checked once.

    Up to ``local_rows`` rows the list is held as a local relation, so joins with
    it never re-read or re-shuffle the list; up to ``broadcast_rows`` it is still
    broadcast; beyond that joins with it are shuffle joins.
    """

    def __init__(self, df: DataFrame, local_rows: int = LOCAL_ROWS,
                 broadcast_rows: int = BROADCAST_ROWS):
        self.local_rows, self.broadcast_rows = local_rows, broadcast_rows
        head = df.limit(local_rows + 1).collect() if local_rows > 0 else [None]
        self.rows = head if len(head) <= local_rows else None
        self.df = df if self.rows is None else local_frame(
            df.sparkSession, [tuple(r) for r in self.rows], df.schema)

    @cached_property
    def small(self) -> bool:
        if self.rows is not None:
            return True
        return self.df.limit(self.broadcast_rows + 1).count() <= self.broadcast_rows

    def _values(self, of_domain, column: Column) -> list[int]:
        if self.rows is not None:
            return sorted({of_domain(r.domain) for r in self.rows})
        return sorted(r.v for r in self.df.select(column.alias("v")).distinct().collect())

    @cached_property
    def depths(self) -> list[int]:
        """Label counts that occur in the list (a few values)."""
        return self._values(lambda d: d.count(".") + 1, F.size(F.split("domain", "[.]")))

    @cached_property
    def lengths(self) -> list[int]:
        """Domain lengths that occur in the list (at most a few hundred values)."""
        return self._values(len, F.length("domain"))


def last_per_domain(df: DataFrame, order: str = "ord") -> DataFrame:
    """One row per domain: among duplicates the last in list order stays."""
    rest = [c for c in df.columns if c != "domain"]
    best = F.max_by(F.struct(*rest), F.col(order)).alias("_r")
    return df.groupBy("domain").agg(best).select("domain", "_r.*")


def hot_keys(df: DataFrame, keys: list[str], count: str | None = None,
             rows_per_salt: int | None = None) -> DataFrame:
    """(keys, _salts) of every key with more rows than one salt bucket should hold.

    There is at most one such key per ``rows_per_salt`` rows of ``df``, which bounds
    the table for a broadcast: a trillion rows give a million narrow rows at most.
    Null keys match nothing and are left to :func:`salted_join`.
    """
    size = ROWS_PER_SALT if rows_per_salt is None else rows_per_salt
    counts = df if count else df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    n = F.col(count or "_n")
    known = F.lit(True)
    for k in keys:
        known = known & F.col(k).isNotNull()
    return counts.filter((n > size) & known).select(*keys, F.ceil(n / size).cast("int").alias("_salts"))


def salted_join(big: DataFrame, dim: DataFrame, keys: list[str],
                hot: DataFrame | None = None, spread: Iterable[str] | None = None,
                how: str = "left", where: Column | None = None) -> DataFrame:
    """Left or inner join on keys where single keys may hold a large share of ``big``.

    ``where`` adds a condition to the key equality (columns of both sides). Rows of a
    hot key are spread by a hash of their other columns (stable under task retries)
    over as many buckets as its row count asks for, and the matching ``dim`` rows are
    repeated per bucket; all other keys use bucket 0. Rows with a null key find
    nothing and are spread over buckets that no ``dim`` row has.
    """
    hot = hot_keys(big, keys) if hot is None else hot
    spread = list(spread) if spread else [c for c in big.columns if c not in keys]
    mark = F.xxhash64(*[F.col(c) for c in spread]) if spread else F.lit(0)
    unknown = F.lit(False)
    for k in keys:
        unknown = unknown | F.col(k).isNull()
    left = (
        big.join(F.broadcast(hot), keys, "left")
        .withColumn("_salt", F.when(unknown, -1 - F.pmod(mark, F.lit(NULL_SALTS)))
                    .otherwise(F.pmod(mark, F.coalesce("_salts", F.lit(1)))).cast("int"))
        .drop("_salts")
    )
    right = (
        dim.join(F.broadcast(hot), keys, "left")
        .withColumn("_salt", F.explode(F.sequence(F.lit(0), F.coalesce("_salts", F.lit(1)) - 1)))
        .drop("_salts")
    )
    if where is None:
        return left.join(right, [*keys, "_salt"], how).drop("_salt")
    for k in keys:
        right = right.withColumnRenamed(k, f"_right_{k}")
    right = right.withColumnRenamed("_salt", "_right_salt")
    on = where & (F.col("_salt") == F.col("_right_salt"))
    for k in keys:
        on = on & (F.col(k) == F.col(f"_right_{k}"))
    return left.join(right, on, how).drop(
        "_salt", "_right_salt", *[f"_right_{k}" for k in keys])


def lookup_join(df: DataFrame, dim: DataFrame, keys: list[str], small: bool,
                how: str = "left") -> DataFrame:
    """Join with a list part: broadcast when its size allows, else salted."""
    if small:
        return df.join(F.broadcast(dim), keys, how)
    return salted_join(df, dim, keys, how=how)


def longest_suffix_join(df: DataFrame, host: str, table: ListTable, out: str,
                        payload: Iterable[str] = (), by: Iterable[str] = ()) -> DataFrame:
    """Attach the longest list entry that is the host or a parent domain of it.

    One equality join per label count in the list, on the host's tail of that
    many labels: no row is multiplied and nothing is regrouped, and with a small
    list the whole step is map-side.
    """
    by, found, base = list(by), [], df
    for depth in reversed(table.depths):
        key, hit = f"_tail{depth}", f"_hit{depth}"
        part = (
            table.df.filter(F.size(F.split("domain", "[.]")) == depth)
            .select(*by, F.col("domain").alias(key), F.struct("domain", *payload).alias(hit))
        )
        tail = F.substring_index(F.col(host), ".", -depth)
        df = df.withColumn(key, tail)
        if table.small:
            df = df.join(F.broadcast(part), [*by, key], "left")
        else:
            # frequent tails are counted on the input, not on the joins so far
            hot = hot_keys(base.select(*by, tail.alias(key)), [*by, key])
            df = salted_join(df, part, [*by, key], hot=hot)
        found.append(hit)
    if not found:
        fields = ", ".join(f"{c}: string" for c in ("domain", *payload))
        return df.withColumn(out, F.lit(None).cast(f"struct<{fields}>"))
    return df.withColumn(out, F.coalesce(*found)).drop(*found, *[f"_tail{d}" for d in table.depths])


def contained_domain_hosts(hosts: DataFrame, key: str, table: ListTable) -> DataFrame:
    """Keys of hosts that contain a listed domain anywhere without lying under it.

    Looser than :func:`embedded_domain_hosts`: any substring counts. Substrings
    of the lengths in the list become equality-join keys.
    """
    h = F.col(key)
    pieces = F.filter(
        F.flatten(F.transform(
            F.array(*[F.lit(n) for n in table.lengths]),
            lambda n: F.transform(
                F.sequence(F.lit(1), F.greatest(F.length(h) - n + 1, F.lit(1))),
                lambda i: F.substr(h, i, n),
            ),
        )),
        lambda p: F.length(p) > 0,
    )
    grams = hosts.select(key, F.explode(F.array_distinct(pieces)).alias("domain"))
    hits = lookup_join(
        grams, table.df.select("domain", F.lit(True).alias("_listed")), ["domain"], table.small
    )
    under = (h == F.col("domain")) | h.endswith(F.concat(F.lit("."), F.col("domain")))
    return hits.filter(F.col("_listed") & ~under).select(key).distinct()

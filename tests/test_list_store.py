"""Refreshes are whole or not there, and lists that fail keep their old version."""

import pytest
from pyspark.errors import AnalysisException
from pyspark.sql import functions as F

from phishlake.sources import list_store
from phishlake.sources.lists import load_list, numbered, write_list


def rows(spark, *lists):
    """(name, version, entries) each."""
    return spark.createDataFrame([(n, v, e) for n, v, entries in lists for e in entries], "list_name string, version string, entry string")


def held(spark, base, number=None):
    out = {}
    for r in list_store.lists_as_of(spark, base, number).collect():
        out.setdefault((r.list_name, r.version), []).append(r.entry)
    return {k: sorted(v) for k, v in out.items()}


def test_refreshes(spark, tmp_path):
    base = str(tmp_path / "lists")
    assert list_store.manifest(spark, base).count() == 0
    first = rows(spark, ("a", "1", ["x", "y"]), ("b", "1", ["z"]), ("c", "9", ["same"]), ("d", "1", ["ok", None]), ("e", None, ["x"]))
    assert list_store.refresh(spark, base, first, F.col("entry").isNull()) == 1
    start = {("a", "1"): ["x", "y"], ("b", "1"): ["z"], ("c", "9"): ["same"]}
    assert held(spark, base) == start
    second = rows(spark, ("a", "0.9", ["older"]), ("b", "2", ["z", None]), ("c", "9", ["changed"]), ("d", "2", ["ok", "ok"]),
                  ("e", "", ["x"]), ("f", "1", ["n"]), ("f", "2", ["m"]))
    assert list_store.refresh(spark, base, second, F.col("entry").isNull()) == 2
    # a goes back, b fails, c has no other version, d is new, e has none, f has two
    assert held(spark, base) == {("a", "0.9"): ["older"], ("b", "1"): ["z"], ("c", "9"): ["same"], ("d", "2"): ["ok", "ok"]}
    assert held(spark, base, 1) == start
    assert list_store.refresh(spark, base, second, F.col("entry").isNull()) == 3
    assert held(spark, base) == held(spark, base, 2)
    assert list_store.manifest(spark, base).agg(F.max("refresh")).first()[0] == 2


def test_unfinished_refreshes_are_not_seen(spark, tmp_path):
    base = str(tmp_path / "lists")
    list_store.refresh(spark, base, rows(spark, ("a", "1", ["x"])), F.col("entry").isNull())
    # died after its rows, or before its manifest was finished
    rows(spark, ("a", "2", ["half"])).write.parquet(f"{base}/rows/refresh=2")
    broken = tmp_path / "lists" / "manifests" / "number=2"
    broken.mkdir()
    assert held(spark, base) == {("a", "1"): ["x"]} and list_store.committed(spark, base) == [1]
    with pytest.raises(ValueError, match="not finished"):
        list_store.manifest(spark, base, 2)
    # its number is taken: another writer may still be at it
    with pytest.raises(AnalysisException):
        list_store.refresh(spark, base, rows(spark, ("a", "3", ["y"])), F.col("entry").isNull())
    broken.rmdir()
    assert list_store.refresh(spark, base, rows(spark, ("a", "3", ["y"])), F.col("entry").isNull()) == 2
    assert held(spark, base) == {("a", "3"): ["y"]}


def test_rows_that_were_not_written_as_sent_do_not_count(spark, tmp_path, monkeypatch):
    base = str(tmp_path / "lists")
    list_store.refresh(spark, base, rows(spark, ("a", "1", ["x"]), ("b", "1", ["y"])), F.col("entry").isNull())
    whole = list_store._summary
    calls = []

    def lossy(frame):
        calls.append(1)  # the second summary is that of what was written
        return whole(frame.where("NOT (list_name = 'a' AND entry = 'lost')") if len(calls) == 2 else frame)
    monkeypatch.setattr(list_store, "_summary", lossy)
    list_store.refresh(spark, base, rows(spark, ("a", "2", ["kept", "lost"]), ("b", "2", ["new"])), F.col("entry").isNull())
    assert held(spark, base) == {("a", "1"): ["x"], ("b", "2"): ["new"]}


def test_nothing_to_take(spark, tmp_path):
    base = str(tmp_path / "lists")
    list_store.refresh(spark, base, rows(spark, ("a", "1", [None])), F.col("entry").isNull())
    assert held(spark, base) == {} and list_store.manifest(spark, base).count() == 0


def test_long_lists_are_numbered_and_read_in_shards(spark, tmp_path):
    hosts = spark.range(3000).select(F.concat(F.lit("Host"), F.format_string("%05d", (F.col("id") * 7919) % 3000)).alias("host"))
    placed = numbered(hosts.repartition(7), "host")
    want = [(i, f"Host{i:05}") for i in range(3000)]
    assert [(r.ord, r.host) for r in placed.orderBy("ord").collect()] == want
    write_list(placed.select("ord", F.col("host").alias("entry")), "known_bad", "3", str(tmp_path), shard=100)
    read = load_list(spark, "known_bad", str(tmp_path / "missing"), str(tmp_path))
    assert [(r.ord, r.domain) for r in read.orderBy("ord").collect()] == [(i, h.lower()) for i, h in want]
    assert spark.read.text(str(tmp_path / "known_bad.jsonl")).count() == 30
    assert numbered(hosts.where("false"), "host").count() == 0

"""Stateful parts against plain loops, over files that interleave and batches that follow each other."""

import random

import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from checks.stream_checks import w02
from phishlake import fixed_values as fv
from phishlake.operators.licences import licence_state
from phishlake.operators.overrides import mail_scans
from phishlake.streaming import jobs, stateful
from phishlake.streaming.processors import take_call

CALLS = "key string, call_id long, ts timestamp"
LIFE = fv.RATE_LIMIT_TTL_SECONDS * 1_000_000


def walk(times):
    out, count, expires = [], 0, 0
    for t in times:
        ok, count, expires = take_call(t, count, expires, fv.RATE_LIMIT_CALLS, LIFE)
        out.append(ok)
    return out


def brute(times):
    out, count, expires = [], 0, None
    for t in times:
        if expires is not None and t >= expires:
            count = 0
        if count >= 30:
            out.append(False)
        else:
            count, expires = count + 1, t + 60_000_000
            out.append(True)
    return out


def write(spark, rows, schema, path, micros="us"):
    """Rows as one more file, ``micros`` becoming the time column ``ts``."""
    frame = spark.createDataFrame(rows, schema)
    if micros:
        frame = frame.withColumn("ts", F.timestamp_micros(micros)).drop(micros)
    frame.coalesce(1).write.mode("append").parquet(str(path))
    return frame.schema


def read_stream(spark, schema, path, files=None):
    reader = spark.readStream.schema(schema)
    if files:
        reader = reader.option("maxFilesPerTrigger", files)
    return reader.parquet(str(path))


def finished(spark, query):
    query.awaitTermination()
    return query.recentProgress


def test_limiter_equals_loop_and_differs_from_tumbling_window():
    rng = random.Random(1)
    times, t = [], 0
    for _ in range(3000):
        t += rng.choice([10_000, 500_000, 1_000_000, 3_000_000, 61_000_000])
        times.append(t)
    assert walk(times) == brute(times)
    # one call per 1.9 s: the life of the counter is renewed, so call 31 is refused after 57 s
    slow = [int(i * 1_900_000) for i in range(1, 40)]
    assert brute(slow)[30] is False


def test_state_is_kept_between_batches(spark, tmp_path):
    src, out = tmp_path / "src", tmp_path / "out"
    calls = [("k", i, (86_400 + i) * 1_000_000) for i in range(45)]
    for part in (calls[:20], calls[20:]):
        write(spark, part, "key string, call_id long, us long", src)
        stateful.limit_calls(read_stream(spark, CALLS, src), str(out), str(tmp_path / "cp")).awaitTermination()
    got = [r.allowed for r in spark.read.parquet(str(out)).orderBy("call_id").collect()]
    assert got == brute([c[2] for c in calls])


def test_rate_limit_orders_calls_of_interleaved_files(spark, tmp_path):
    """Files that interleave in time: as if calls came one by one. The plan sorts once, in the shuffle by key."""
    calls = [("k" if i % 3 else "j", i, 1_700_000_000 + i * 0.7) for i in range(900)]
    for part in range(4):
        write(spark, [(k, i, int(t * 1_000_000)) for k, i, t in calls if i % 4 == part],
              "key string, call_id long, us long", tmp_path / "in")
    query = stateful.limit_calls(read_stream(spark, CALLS, tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "ck"))
    query.awaitTermination()
    plan = query._jsq.explainInternal(False)
    assert plan.count("Exchange ") == 1 and plan.count("Sort ") == 1
    got = {r.call_id: r.allowed for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    state, want = {}, {}
    for k, i, t in sorted(calls, key=lambda c: c[2]):
        count, expires = state.get(k, (0, 0))
        count = 0 if t >= expires else count
        want[i] = count < 30
        state[k] = (count + 1, t + 60) if want[i] else (count, expires)
    assert got == want


def test_idle_counters_go(spark, tmp_path):
    """A time to live of a millisecond: the batch after finds the other keys' counters gone."""
    base = 1_700_000_000_000_000
    sizes = []
    for batch in range(2):
        write(spark, [(f"b{batch}-{i}", i, base) for i in range(40)], "key string, call_id long, us long", tmp_path / "in")
        query = stateful.limit_calls(read_stream(spark, CALLS, tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "ck"), ttl_ms=1)
        progress = finished(spark, query)
        sizes.append(progress[-1]["stateOperators"][0]["numRowsTotal"])
    assert sizes[0] == 40 and sizes[1] <= 40
    assert spark.read.parquet(str(tmp_path / "out")).count() == 80


def test_settings_are_put_back(spark):
    name = "spark.sql.streaming.unsupportedOperationCheck"
    before = spark.conf.get(name, None)
    with pytest.raises(ZeroDivisionError), stateful.stream_settings(spark, unsupportedOperationCheck="false"):
        assert spark.conf.get(name) == "false"
        1 / 0  # noqa: B018
    assert spark.conf.get(name, None) == before


def test_overrides_and_navigations_meet_across_batches(spark, tmp_path):
    """One file per batch and side; late matches, sessions and hosts apart, and an override that has ended."""
    rng = random.Random(3)
    minute = 60_000_000
    start = 1_700_000_000_000_000
    nav = [(i, rng.randrange(4), f"h{rng.randrange(3)}", start + i * 7 * minute) for i in range(160)]
    marks = [(rng.randrange(4), f"h{rng.randrange(3)}", start + i * 95 * minute) for i in range(12)]
    last = max(nav[-1][3], marks[-1][2])
    nav.append((900, 99, "h0", last + 60 * minute))
    marks.append((98, "h0", last + 60 * minute))
    for part in range(3):  # in order of time, so that no row is late
        size = len(nav) // 3 + 1
        schema = write(spark, nav[part * size:(part + 1) * size], "event_id int, session_id int, host string, us long", tmp_path / "nav")
        write(spark, [m for m in marks if (m[2] - start) * 3 // (last + 61 * minute - start) == part] or [(97, "x", start)],
              "session_id int, host string, us long", tmp_path / "marks")
    views = jobs.with_event_time(read_stream(spark, schema, tmp_path / "nav", 1), delay="5 hours")
    accepted = jobs.with_event_time(read_stream(
        spark, "session_id int, host string, ts timestamp", tmp_path / "marks", 1), delay="5 hours")
    life = 8 * 60 * minute
    rows = stateful.not_overridden(views, accepted, "8 hours")
    query = stateful.start_stateful(rows, str(tmp_path / "out"), str(tmp_path / "ck"))
    progress = finished(spark, query)
    got = {r.event_id for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    closed = last + 60 * minute - 300 * minute
    want = {i for i, s, h, t in nav if t <= closed
            and not any(s == x and h == y and t - life <= o <= t for x, y, o in marks)}
    plain = {i for i, s, h, t in nav if t <= closed and not any(s == x and h == y and o <= t for x, y, o in marks)}
    assert got == want and 10 < len(want) < sum(t <= closed for *_, t in nav) and plain < want
    # what the watermark has passed is gone from the state
    assert progress[-1]["stateOperators"][0]["numRowsTotal"] < len(nav)


def test_scans_over_batches_equal_the_batch_job(spark, tmp_path):
    rng = random.Random(5)
    t, rows = 1_700_000_000_000_000, []
    for i in range(600):
        t += rng.choice([50_000, 200_000, 700_000, 5_000_000])
        rows.append((i % 7 % 3, i, rng.choice("abc") if i % 5 else "a", t))
    closing = [(box, 1000 + box, "z", t + 3_600_000_000) for box in range(3)]
    for part in range(4):  # files in order of time, and one that closes all bursts
        write(spark, rows[part * 150:(part + 1) * 150], "mailbox long, view_id long, signature string, us long", tmp_path / "in")
    schema = write(spark, closing, "mailbox long, view_id long, signature string, us long", tmp_path / "in")
    for files in (1, None):
        views = jobs.with_event_time(read_stream(spark, schema, tmp_path / "in", files), delay="1 minute")
        query = stateful.start_stateful(stateful.scans(views), str(tmp_path / f"out{files}"), str(tmp_path / f"ck{files}"))
        progress = finished(spark, query)
        got = {(r.mailbox, r.view_id) for r in spark.read.parquet(str(tmp_path / f"out{files}")).collect()}
        batch = mail_scans(spark.read.parquet(str(tmp_path / "in")).where("view_id < 1000"), "mailbox", "ts", "signature", ["view_id"])
        want = {(r.mailbox, r.view_id) for r in batch.collect()}
        assert got == want and 30 < len(want) < 400
        assert progress[-1]["stateOperators"][0]["numRowsTotal"] == 3  # one last scan per mailbox


def test_forgotten_scans_are_shown_again(spark, tmp_path):
    """The memory of a mailbox ends by its timer: the same view a day later is a new scan."""
    day = 86_400_000_000
    start = 1_700_000_000_000_000
    schema = None
    for k in range(3):
        schema = write(spark, [(1, k, "same", start + k * 3 * day), (2, 10 + k, "x", start + k * 3 * day + 3_600_000_000)],
                       "mailbox long, view_id long, signature string, us long", tmp_path / "in")
    views = jobs.with_event_time(read_stream(spark, schema, tmp_path / "in", 1), delay="1 minute")
    for days, want in ((1, {0, 1, 10, 11}), (30, {0, 10})):
        query = stateful.start_stateful(stateful.scans(views, memory_days=days), str(tmp_path / f"o{days}"), str(tmp_path / f"c{days}"))
        query.awaitTermination()
        got = {r.view_id for r in spark.read.parquet(str(tmp_path / f"o{days}")).collect()}
        assert got - {2, 12} == want


def test_licences_over_batches_equal_the_batch_job(spark, tmp_path):
    rng = random.Random(7)
    kinds = [("checkout.session.completed", None), ("customer.subscription.deleted", None),
             ("customer.subscription.updated", "unpaid"), ("customer.subscription.updated", "active"), ("invoice.paid", None)]
    rows = []
    for i in range(400):
        kind, status = rng.choice(kinds)
        rows.append((kind, status, None if i % 11 == 0 else f"s{rng.randrange(25)}", f"key{i:03}", 1_700_000_000_000_000 + i * 1_000_000))
    schema = "event_type string, status string, subscription_id string, licence_key string, us long"
    for part in range(4):
        stored = write(spark, rows[part * 100:(part + 1) * 100], schema, tmp_path / "ordered")
        write(spark, rows[part::4], schema, tmp_path / "mixed")
    whole = spark.read.parquet(str(tmp_path / "ordered"))
    want = {(r.licence_key, r.subscription_id): r.status for r in licence_state(whole).collect()}
    assert {"active", "inactive"} == set(want.values())
    for source, files in (("ordered", 1), ("mixed", None)):  # batch by batch in order; interleaved files in one batch
        changes = stateful.licence_changes(read_stream(spark, stored, tmp_path / source, files))
        query = stateful.start_stateful(changes, str(tmp_path / f"o-{source}"), str(tmp_path / f"c-{source}"))
        progress = finished(spark, query)
        told = spark.read.parquet(str(tmp_path / f"o-{source}"))
        got = stateful.licences_now(told).collect()
        assert {(r.licence_key, r.subscription_id): r.status for r in got} == want and len(got) == len(want)
        # only open subscriptions are remembered
        assert progress[-1]["stateOperators"][0]["numRowsTotal"] <= 25


def test_counts_are_merged_from_what_batches_changed(spark, tmp_path):
    hour = 3_600_000_000
    start = 1_700_000_000_000_000 // hour * hour
    rows = [(i, "a" if i % 3 else "b", start + i * hour // 10) for i in range(120)]
    for part in range(4):
        schema = write(spark, rows[part * 30:(part + 1) * 30], "id int, verdict string, us long", tmp_path / "in")
    stream = jobs.with_event_time(read_stream(spark, schema, tmp_path / "in", 1))
    counts = jobs.windowed_counts(stream, "ts", "1 hour", "verdict")
    query = jobs.write_counts(counts, str(tmp_path / "out"), str(tmp_path / "ck"))
    progress = finished(spark, query)
    got = {(r.window_start.timestamp(), r.verdict): r.n for r in jobs.merged_counts(spark, str(tmp_path / "out"), "verdict").collect()}
    want = {}
    for _, verdict, us in rows:
        key = (us // hour * hour / 1e6, verdict)
        want[key] = want.get(key, 0) + 1
    assert got == want
    # windows that are over are neither written again nor kept
    assert spark.read.parquet(str(tmp_path / "out")).count() < 2 * len(want)
    assert progress[-1]["stateOperators"][0]["numRowsTotal"] <= 6


def test_streams_read_a_table_that_is_a_file_or_a_folder(spark, tmp_path):
    """Other tables beside it are left alone; pages come out scored either way."""
    page = "<html><head><title>t</title></head><body><article><p>the token</p></article></body></html>"
    rows = pa.table({"page_id": list(range(8)), "url": ["http://a.example.com/x"] * 8, "html": [page] * 8})
    for form in ("file", "folder"):
        (tmp_path / form).mkdir()
    pq.write_table(rows, tmp_path / "file" / "pages.parquet")
    spark.createDataFrame(rows.to_pandas()).repartition(3).write.parquet(str(tmp_path / "folder" / "pages.parquet"))
    got = []
    for form in ("file", "folder"):
        pq.write_table(rows, tmp_path / form / "events.parquet")
        got.append(sorted((r.page_id, r.content_score, r.content_verdict) for r in w02(spark, str(tmp_path / form)).collect()))
    assert got[0] == got[1] and [r[0] for r in got[0]] == list(range(8)) and got[0][0][1] > 0

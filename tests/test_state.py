"""Typed state, the chunk source and the journal: expiry, late events, restarts, failures."""

import json
import random
import struct
import time

import pytest
from pyspark.sql import functions as F

from quillet.sources import chunk_source as cs
from quillet.sources import journal as jn
from quillet.streaming import health as hl
from quillet.streaming import memory as mm
from quillet.streaming import sessions as ss
from quillet.streaming import steps

SEEN = "session string, seq long, canonical_text string, now_ms double, confidence double, observation_id string, verified boolean, aliases array<string>"


@pytest.fixture
def rocks(spark):
    yield mm.with_rocksdb(spark)
    spark.conf.unset("spark.sql.streaming.stateStore.providerClass")


def run(query):
    q = query.trigger(availableNow=True).start()
    assert q.awaitTermination(180)


def observations(rng, n, capacity_names):
    rows, now = [], {s: 0.0 for s in "ab"}
    for i in range(n):
        s = rng.choice("ab")
        now[s] += rng.choice([1000, 5000, 400_000, 700_000])
        rows.append((s, i, rng.choice(capacity_names), now[s], rng.choice([None, 0.9, 0.95, 0.4]), rng.choice([None, "o1", "o2", f"o{i}"]), rng.random() < 0.05, rng.choice([None, ["x"], ["y", " "]])))
    return rows


def memory_query(spark, source, out, checkpoint, delay="365 days", **limits):
    events = spark.readStream.schema(SEEN).option("maxFilesPerTrigger", 1).json(source)
    timed = events.withColumn("ts", F.timestamp_millis(F.col("now_ms").cast("long"))).withWatermark("ts", delay)
    return mm.memory_stream(timed, **limits).writeStream.format("json").option("path", out).option("checkpointLocation", checkpoint).outputMode("append")


def test_memory_goes_on_after_a_restart(rocks, tmp_path):
    rows = observations(random.Random(3), 60, [f"e{i}" for i in range(6)])
    source, out, checkpoint = (str(tmp_path / x) for x in ("in", "out", "cp"))
    add = lambda part: rocks.createDataFrame(part, SEEN).coalesce(1).write.mode("append").json(source)
    add(rows[:20])
    add(rows[20:35])
    run(memory_query(rocks, source, out, checkpoint, capacity=4))
    add(rows[35:])
    run(memory_query(rocks, source, out, checkpoint, capacity=4))
    got = sorted(tuple(r) for r in rocks.read.schema(ss.MEMORY).json(out).collect())
    wanted = []
    for s in "ab":
        state = steps.MemoryState(capacity=4)
        for r in ss.memory_events(state, [dict(zip([c.split(" ")[0] for c in SEEN.split(", ")], row)) for row in rows if row[0] == s]):
            wanted.append((s, r["seq"], r["canonical_text"], r["trust_level"], r["occurrence_count"], r["confidence_count"], r["entries"]))
    assert got == sorted(wanted) and {x[3] for x in got} >= {"PROVISIONAL", "OBSERVED", "ACCEPTED", "VERIFIED"}


def test_memory_expires_and_late_events_are_dropped(rocks, tmp_path):
    source, out, checkpoint = (str(tmp_path / x) for x in ("in", "out", "cp"))
    one = lambda seq, name, now: ("s", seq, name, float(now), None, None, False, None)
    for part in ([one(0, "old", 1000)], [one(1, "new", 1_000_000)], [one(2, "other", 5_000_000)], [one(3, "late", 10), one(4, "old", 5_000_001)]):
        rocks.createDataFrame(part, SEEN).coalesce(1).write.mode("append").json(source)
        time.sleep(1.1)  # files are taken by their times
    run(memory_query(rocks, source, out, checkpoint, delay="1 second"))
    rows = {r.seq: r for r in rocks.read.schema(ss.MEMORY).json(out).collect()}
    assert sorted(rows) == [0, 1, 2, 4]
    assert (rows[1].entries, rows[2].entries) == (2, 1) and (rows[4].occurrence_count, rows[4].entries) == (1, 2)
    left = rocks.read.format("statestore").option("stateVarName", "entries").load(checkpoint).selectExpr("user_map_key.canonical_text as name").collect()
    assert {r.name for r in left} == {"old", "other"}  # what expired is gone from the store too


def test_deadlines(rocks, tmp_path):
    schema = "session string, seq long, event string, text string, segments int"
    source, out, checkpoint = (str(tmp_path / x) for x in ("in", "out", "cp"))
    add = lambda *rows: rocks.createDataFrame(rows, schema).coalesce(1).write.mode("append").json(source)
    add(("quick", 1, "request", "base", 1), ("quick", 2, "result", "refined", 1), ("slow", 1, "request", "baseline", 1))
    events = rocks.readStream.schema(schema).json(source)
    q = mm.final_stream(events, scale_ms=20).writeStream.format("json").option("path", out).option("checkpointLocation", checkpoint).outputMode("append").trigger(processingTime="300 milliseconds").start()
    try:
        for _ in range(100):
            time.sleep(0.3)
            if q.recentProgress and rocks.read.schema(mm.FINALS).json(out).count() == 2:
                break
        add(("slow", 2, "result", "too late", 1))
        for _ in range(50):
            time.sleep(0.3)
            if sum(p.numInputRows for p in q.recentProgress) >= 4:
                break
        else:
            raise AssertionError("the late result was not read")
    finally:
        q.stop()
    assert sorted(tuple(r) for r in rocks.read.schema(mm.FINALS).json(out).collect()) == [("quick", 1, "refined", True, None), ("slow", 1, "baseline", False, "refiner_timeout")]


def pcm(*samples):
    return struct.pack(f"<{len(samples)}f", *samples)


def test_chunks_are_read_once_over_restarts(rocks, tmp_path):
    folder, out, checkpoint = (str(tmp_path / x) for x in ("spool", "out", "cp"))
    query = lambda: mm.ordered_chunks(cs.read_chunks(rocks, folder, files_per_batch=2)).writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).outputMode("append")
    cs.spool_chunks(folder, 0, [("a", 0, pcm(0.5)), ("b", 0, pcm(1, 2))])
    cs.spool_chunks(folder, 1, [("a", 1, b"abc")])
    cs.spool_chunks(folder, 3, [("a", 5, pcm())])  # file 2 is not there yet
    run(query())
    assert rocks.read.parquet(out).count() == 3
    cs.spool_chunks(folder, 2, [("a", 1, pcm(9)), ("a", 2, pcm(3))])
    run(query())
    run(query())
    rows = sorted((r.session, r.seq, bytes(r.pcm), r.error, r.missing) for r in rocks.read.parquet(out).collect())
    assert rows == [("a", 0, pcm(0.5), None, 0), ("a", 1, b"abc", "3 bytes are no whole samples", 0), ("a", 2, pcm(3), None, 0), ("a", 5, pcm(), None, 2), ("b", 0, pcm(1, 2), None, 0)]


def refuse(row):
    if row["n"] == 2:
        time.sleep(3)
    return row["n"] != 1


def test_journal_commits_whole_batches_once(spark, tmp_path):
    source, path, checkpoint = (str(tmp_path / x) for x in ("in", "journal", "cp"))
    spark.range(20).selectExpr("id as n").repartition(3).write.json(source)
    rows = spark.readStream.schema("n long").json(source)
    q = jn.write_journal(rows.withColumn("x", F.when(F.col("n") == 13, F.raise_error(F.lit("broken"))).otherwise(F.lit("é"))), path, str(tmp_path / "broken")).trigger(availableNow=True).start()
    with pytest.raises(Exception, match="broken"):
        q.awaitTermination(120)
    assert not list((tmp_path / "journal" / "commits").rglob("*.json")) and jn.JournalWriter(path, "main", None, 1).commit([], 99) is None
    run(jn.write_journal(rows, path, checkpoint, query="good"))
    assert sorted(r.n for r in jn.read_journal(spark, path, "n long").collect()) == list(range(20))
    # the batch is run again, as after a crash between its commit and the query's own
    files = len(list((tmp_path / "journal" / "data").iterdir()))
    run(jn.write_journal(rows, path, str(tmp_path / "again"), query="good"))
    assert jn.read_journal(spark, path, "n long").count() == 20 and len(list((tmp_path / "journal" / "data").iterdir())) == files
    (tmp_path / "journal" / "data" / "half.jsonl").write_text(json.dumps({"n": 77}) + "\n")
    assert jn.read_journal(spark, path, "n long").where("n = 77").count() == 0


def test_rows_that_can_not_be_sent_mark_the_batch(spark, tmp_path):
    source, path = str(tmp_path / "in"), str(tmp_path / "journal")
    spark.range(4).selectExpr("id as n").coalesce(1).write.json(source)
    rows = spark.readStream.schema("n long").json(source)
    run(jn.write_journal(rows, path, str(tmp_path / "cp"), send="tests.test_state:refuse", timeout_s=0.5))
    (b,) = jn.journal_batches(spark, path).collect()
    assert (b.rows, b.unsent) == (4, 3)
    assert sorted((r.n, r.sent) for r in jn.read_journal(spark, path, "n long, sent boolean").collect()) == [(0, True), (1, False), (2, False), (3, False)]


def test_health_after_a_failure_and_a_restart(spark, tmp_path):
    source, path = str(tmp_path / "in"), str(tmp_path / "health")
    schema = "n long, ts timestamp"
    add = lambda *numbers: spark.createDataFrame([(n,) for n in numbers], "n long").selectExpr("n", "timestamp_seconds(1000 + n) as ts").coalesce(1).write.mode("append").json(source)
    add(1, 2, 3)
    rows = spark.readStream.schema(schema).json(source).withWatermark("ts", "10 seconds")
    listener = hl.watch(spark, path)
    try:
        start = lambda broken: rows.where(F.col("n") > F.when(F.lit(broken), F.raise_error(F.lit("no room"))).otherwise(0)).writeStream.format("json").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "cp")).queryName("watched").trigger(availableNow=True).start()
        with pytest.raises(Exception, match="no room"):
            start(True).awaitTermination(120)
        add(50)
        start(False).awaitTermination(120)
        runs = []
        for _ in range(60):
            time.sleep(0.5)
            runs = hl.health(spark, path).orderBy("started_at").collect() if (tmp_path / "health").exists() else []
            if len(runs) == 2 and runs[1].state == "stopped":
                break
    finally:
        spark.streams.removeListener(listener)
    failed, good = runs
    assert (failed.state, failed.rows) == ("failed", 0) and "no room" in failed.error
    assert (good.state, good.rows, good.error, good.name) == ("stopped", 4, None, "watched") and good.query_id == failed.query_id
    assert good.behind_s > 0 and good.batches >= 1

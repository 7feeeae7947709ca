"""State classes, batch twins and replayed streams."""

import random

import pytest

from quillet.operators import windows as wn
from quillet.operators.segments import identity
from quillet.streaming import sessions as ss
from quillet.streaming import steps


def test_chunker_state():
    s = steps.ChunkerState()
    assert s.update("第一句。第二") == [(0, "第一句。")] and s.update("第一句。第二句！还") == [(1, "第二句！")]
    with pytest.raises(steps.RevisionError):
        s.update("第二版。第二句！还")
    assert s.update("第一句。第二句！还有", True) == [(2, "还有")] and s.update("新的。") == [(3, "新的。")]
    again = steps.ChunkerState.load(s.dump())
    assert again == s


def test_sliding_state():
    s, seen = steps.SlidingState(), []
    for c in "abcde":
        out = s.add(c + "。", lambda t: seen.append(t) or t)
    assert out == {"active": "c。d。e。", "committed": 2, "transcript": "a。b。c。d。e。"} and seen.count("a。") == 2


def test_window_cache():
    w, calls = steps.WindowCache(), []

    def refine(t):
        calls.append(t)
        return t.replace("苹果", "蘋果")

    text = ""
    for part in ("苹果。", "天气好。", "出门。", "结束。"):
        text += part
        assert w.update(text, refine) == text.replace("苹果", "蘋果")
    n = len(calls)
    assert w.update(text, refine) and len(calls) == n
    w.update("香蕉。天气好。出门。结束。", refine)
    assert calls[-1] == "香蕉。" and max(map(len, calls)) <= 240
    long = "字" * 1200
    assert w.update(long, refine) == long and max(map(len, calls)) <= 240


def test_cached_windows_equal_the_cache(spark):
    rng, rows, wanted = random.Random(2), [], []
    for session in "ab":
        w, text = steps.WindowCache(), ""
        for seq in range(25):
            text = rng.choice([text, text + rng.choice(["苹果。", "a b, ", "no end ", "x" * 100, ""]), text[: rng.randrange(len(text) + 1)], "新" + text[1:]])
            w.update(text, str)
            rows.append((session, seq, text or None))
            wanted.append((session, seq, len(w.sources), w.active_source, w.calls))
    got = wn.cached_windows(spark.createDataFrame(rows, "session string, seq long, text string")).select("session", "seq", "committed", "active", "calls")
    assert sorted(map(tuple, got.collect())) == wanted


def test_utterances_equal_the_voice_state(spark):
    rng, rows, wanted = random.Random(5), [], []
    for session in "abcd":
        v = steps.VoiceState(preroll=0.7)
        for i in range(80):
            loud, seconds = rng.random() < 0.5, rng.choice([0.25, 0.125, 0.5])
            rows.append((session, 3 * i, 1.0 if loud else 0.0, seconds))
            wanted += [(session, *x) for x in [v.add(3 * i, rows[-1][2], seconds)] if x]
        wanted += [(session, *x) for x in [v.finish(3 * 79)] if x]
    got = wn.utterances(spark.createDataFrame(rows, "session string, pos long, rms double, seconds double"))
    assert sorted(map(tuple, got.collect())) == sorted(wanted) and len(wanted) > 20


def test_rotation():
    s = steps.RotationState()
    assert s.add(30, "没有结束") == "没有结束" and s.count == 0
    assert s.add(1, "结束了。") == "结束了。" and s.count == 1
    s.add(45, "no end")
    assert s.count == 2 and s.add(1, "hello") == "结束了。no end hello"


def test_voice_state():
    v, out = steps.VoiceState(preroll=0.5), []
    for i, loud in enumerate([0, 0, 0, 1, 1, 1, 0, 0, 1, 0]):
        out.append(v.add(i, 1.0 if loud else 0.0, 0.25))
    assert [x for x in out if x] == [(2, 7)]
    assert v.finish(9) == (8, 9) or v.finish(9) is None


def test_memory_trust():
    m = steps.MemoryState()
    assert m.observe("a", 0, confidence=0.91, observation_id="1")["trust_level"] == "PROVISIONAL"
    assert m.observe("a", 1, confidence=0.89, observation_id="2")["trust_level"] == "ACCEPTED"
    assert m.observe("b", 1, confidence=0.9, observation_id="x") and m.observe("b", 2, confidence=0.9, observation_id="x")["confidence_count"] == 1
    assert m.observe("c", 2) and m.observe("c", 3)["trust_level"] == "OBSERVED"
    assert [e["canonical_text"] for e in m.trusted(3)] == ["a"]
    m.observe("v", 3, verified=True)
    assert [e["canonical_text"] for e in m.snapshot(1_300_000)] == ["v"]
    with pytest.raises(ValueError):
        m.observe(" ", 0)
    with pytest.raises(ValueError):
        m.observe("x", 0, confidence=2)
    small = steps.MemoryState(capacity=2)
    small.observe("v", 0, verified=True)
    small.observe("old", 1)
    small.observe("new", 2)
    assert sorted(small.entries) == ["new", "v"]
    assert steps.final_deadline(1) == 30 and steps.final_deadline(100) == 300


EVENTS = "session string, seq long, event string, text string"


def run_stream(spark, tmp_path, rows, schema, build, batches=2):
    source = tmp_path / "in"
    for i in range(batches):
        spark.createDataFrame(rows[len(rows) * i // batches : len(rows) * (i + 1) // batches], schema).coalesce(1).write.mode("append").json(str(source))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).json(str(source))
    q = build(stream).writeStream.format("memory").queryName("out").outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    return spark.table("out").collect()


def test_chunk_stream_equals_replay(spark, tmp_path):
    texts = ["第一句。", "第一句。第二", "第一句。第二句。第三", "第一句。第二句。第三句"]
    rows = [(s, i, "boundary" if i == 3 else "chunk", t) for s in ("a", "b") for i, t in enumerate(texts)]
    rows.sort(key=lambda r: r[1])
    batch = ss.replay(spark.createDataFrame(rows, EVENTS), ss.CHUNKS, steps.ChunkerState.load, ss.chunk_events).collect()
    live = run_stream(spark, tmp_path, rows, EVENTS, lambda s: ss.stateful(s, ss.CHUNKS, steps.ChunkerState.load, ss.chunk_events))
    assert sorted(map(tuple, live)) == sorted(map(tuple, batch)) and len(batch) == 6
    closed = spark.createDataFrame([(s, i, "boundary", t) for s in "ab" for i, t in enumerate([*texts, None, " ", "x" * 200])], EVENTS)
    whole = ss.replay(closed, ss.CHUNKS, steps.ChunkerState.load, ss.chunk_events).collect()
    assert sorted(map(tuple, wn.chunked_segments(closed).collect())) == sorted(map(tuple, whole))


def test_refinement_stream(spark, tmp_path):
    rows = [("a", 0, "chunk", "你好。"), ("a", 1, "chunk", "你好。世界"), ("a", 2, "chunk", "你好。世界。"), ("a", 3, "finish", None), ("a", 4, "chunk", "迟到")]
    out = run_stream(spark, tmp_path, rows, EVENTS, lambda s: ss.refinement_stream(s, [], lambda: identity, mode="off"), batches=1)
    assert [(r.event, r.clean_text) for r in out] == [("final", "你好。世界。")]
    handle = ss.refinement_events([], lambda: identity, mode="off")
    state = ss.RefinementState()
    step = lambda *r: list(handle(state, [dict(zip(("session", "seq", "event", "text"), x)) for x in r]))
    assert [u["event"] for u in step(*rows[:2])] == ["update"] and state.updates == 1
    first = step(rows[2])[0]["calls"]
    final = step(rows[3])[0]
    assert final["event"] == "final" and final["calls"] == first  # cached: no new call
    assert step(rows[4]) == []


def test_memory_and_other_replays(spark):
    rows = spark.createDataFrame([("s", 1, "a", 0.9, "x", 0.0), ("s", 2, "a", 0.9, "y", 1.0)], "session string, seq long, canonical_text string, confidence double, observation_id string, now_ms double")
    got = ss.replay(rows, ss.MEMORY, steps.MemoryState.load, ss.memory_events).collect()
    assert [r.trust_level for r in got] == ["PROVISIONAL", "ACCEPTED"]
    audio = spark.createDataFrame([("s", i, 1.0 if i in (2, 3) else 0.0, 0.25) for i in range(8)], "session string, seq long, rms double, seconds double")
    assert [tuple(r)[1:] for r in ss.replay(audio, ss.UTTERANCES, steps.VoiceState.load, ss.voice_events).collect()] == [(0, 5)]
    assert ss.replay(audio, ss.TRIGGERS, steps.TriggerState.load, ss.trigger_events).count() == 1
    texts = spark.createDataFrame([("s", 1, "done.", 46.0), ("s", 2, "more", 1.0)], "session string, seq long, text string, seconds double")
    assert [r.transcript for r in ss.replay(texts, ss.ROTATIONS, steps.RotationState.load, ss.rotation_events).collect()] == ["done.", "done. more"]
    assert [r.committed for r in ss.replay(texts, ss.SLIDING, steps.SlidingState.load, ss.sliding_events).collect()] == [0, 0]

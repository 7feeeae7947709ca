"""Readers, writers, rubric parsing, generators and the registered queries' contract."""

import asyncio
import io
import json
import sqlite3
import struct
import wave

import pytest
from pyspark.sql import functions as F

import __spark_entry__
from quillet.operators import evaluation as ev
from quillet.plans import transcripts as tr
from quillet.sources import readers as rd
from quillet.sources import writers as wr


def test_jsonl(spark, tmp_path):
    path = tmp_path / "a.jsonl"
    assert rd.read_jsonl(spark, str(tmp_path / "none"), "a int").count() == 0
    path.write_text('{"a": 1}\n\n{"a": 2, "b": 3}\n')
    assert sorted(r.a for r in rd.read_jsonl(spark, str(path), "a int").collect()) == [1, 2]
    assert rd.read_jsonl_strict(spark, str(path), "a int").count() == 2
    path.write_text('{"a": 1}\n[2]\n')
    with pytest.raises(rd.MalformedInput, match="a.jsonl"):
        rd.read_jsonl_strict(spark, str(path), "a int")
    path.write_text('{"a": 1}\nbroken\n')
    with pytest.raises(Exception):
        rd.read_jsonl(spark, str(path), "a int").collect()


QA = [{"id": "q1", "category": "content", "question": "?", "evidence": "e", "options": [{"text": "good", "score": 2}, {"text": "bad", "score": 0}]},
      {"id": "q2", "category": "filter", "question": "?", "evidence": "e", "options": "yes（1），no（0）"},
      {"id": "q3", "category": "format", "question": "?", "evidence": "e", "options": ["yes（1）", "no (0)"]}]


def rubric(spark, tmp_path, qa, status="success"):
    item = {"source_record_id": "s1", "status": status, "audio": "a", "scene": "meeting", "oral": "o", "clean": "c", "qa": qa}
    path = tmp_path / "rubric.json"
    path.write_text(json.dumps({"items": [item]}, indent=1))
    return rd.read_rubric(spark, str(path))


def test_rubric(spark, tmp_path):
    questions = ev.rubric_questions(rubric(spark, tmp_path, QA)).orderBy("n").collect()
    assert [[(o.text, o.score) for o in q.options] for q in questions] == [[("good", 2), ("bad", 0)], [("yes", 1), ("no", 0)], [("yes", 1), ("no", 0)]]
    assert ev.rubric_questions(rubric(spark, tmp_path, QA, "failed")).count() == 0


@pytest.mark.parametrize("change", [{"category": "odd"}, {"id": " "}, {"options": []}, {"options": "yes"}, {"evidence": 5}, {"id": "q2"}])
def test_bad_rubrics(spark, tmp_path, change):
    with pytest.raises(ev.DataError):
        ev.rubric_questions(rubric(spark, tmp_path, [QA[0] | change, QA[1]]))


def test_matching(spark, tmp_path):
    r = rubric(spark, tmp_path, QA)
    asr = spark.createDataFrame([("s1", '{"output": {"ok": false, "error": "lost"}}'), ("s2", "{}")], "sample_id string, record string")
    got = ev.match_records(r, asr).collect()
    assert [(m.sample_id, m.output, m.asr_error) for m in got] == [("s1", "", "lost")]
    with pytest.raises(ev.DataError):
        ev.match_records(r, asr.unionByName(asr))
    questions = ev.rubric_questions(r)
    answers = spark.createDataFrame([("s1", "q1", 0), ("s1", "q2", 1), ("s1", "q3", 0)], "sample_id string, question_id string, option_index int")
    assert {x.question_id: (x.score, x.max_score) for x in ev.score_answers(questions, answers).collect()} == {"q1": (2, 2), "q2": (0, 1), "q3": (1, 1)}
    for bad in (answers.where("question_id <> 'q1'"), answers.withColumn("option_index", F.lit(7)), answers.withColumn("question_id", F.concat("question_id", F.lit("x")))):
        with pytest.raises(ev.DataError):
            ev.score_answers(questions, bad)


def wav(samples, rate=8000, channels=2):
    out = io.BytesIO()
    with wave.open(out, "wb") as w:
        w.setnchannels(channels)
        w.setsampwidth(2)
        w.setframerate(rate)
        w.writeframes(b"".join(struct.pack("<h", s) for s in samples for _ in range(channels)))
    return out.getvalue()


def test_audio(spark, tmp_path):
    (tmp_path / "a.wav").write_bytes(wav([16384] * 4000))
    w = rd.wav_windows(spark, str(tmp_path / "a.wav")).orderBy("seq").collect()
    assert len(w) == -(-(8000 + 16000) // 512) and all(len(x.samples) == 512 for x in w)
    assert abs(w[0].rms - 0.5) < 1e-3 and w[-1].rms == 0
    raw = spark.createDataFrame([(bytearray(struct.pack("<2f", 0.5, -1)),), (None,)], "b binary")
    assert [r[0] for r in raw.select(rd.pcm_samples(F.col("b"))).collect()] == [[0.5, -1.0], None]
    with pytest.raises(Exception, match="multiple of 4"):
        spark.createDataFrame([(bytearray(b"abc"),)], "b binary").select(rd.pcm_samples(F.col("b"))).collect()
    assert rd.visible_config({"_x": 1, "a": {"_y": 2, "b": 3}}) == {"a": {"b": 3}}


def test_writers(spark, tmp_path):
    report = str(tmp_path / "report.json")
    for n in (1, 2):
        wr.write_report(spark, report, {"n": n, "名": "x"})
    assert json.loads((tmp_path / "report.json").read_text()) == {"n": 2, "名": "x"} and not list(tmp_path.glob("*.tmp"))
    log = str(tmp_path / "log")
    rows = spark.createDataFrame([(1,)], "a int")
    wr.append_log(rows, log)
    wr.append_log(rows, log)
    assert rd.read_jsonl(spark, log, "a int").count() == 2
    assert wr.report_rows(rows) == [{"a": 1}]
    with pytest.raises(ValueError):
        wr.report_rows(spark.range(5), 3)
    for name in ("oral", "clean", "train"):
        wr.write_jsonl(rows, str(tmp_path / "data" / name))
    root = str(tmp_path / "data")
    assert wr.reset_derived(spark, root, dry_run=True) == [f"{root}/oral", f"{root}/train"] and (tmp_path / "data/oral").exists()
    wr.reset_derived(spark, root)
    assert sorted(p.name for p in (tmp_path / "data").iterdir()) == ["clean"]


def test_generators(spark):
    calls = []

    async def flaky(prompt):
        calls.append(prompt)
        if prompt == "bad" or calls.count(prompt) < 2:
            raise RuntimeError
        return prompt.upper()

    assert tr.concurrent(flaky, pause=0)(["a", "bad"]) == ["A", None] and calls.count("bad") == 3
    assert asyncio.run(asyncio.sleep(0)) is None
    rows = spark.createDataFrame([(1, "x\nhello"), (2, None), (3, "x\nhello")], "id int, p string")
    assert [r.a for r in tr.generate(rows, "p", "a", lambda: tr.echo).orderBy("id").collect()] == ["hello", None, "hello"]
    cache = spark.createDataFrame([], "key string, answer string")
    out, fresh = tr.cached_generate(rows, cache, "p", "a", lambda: tr.echo)
    assert sorted(r.id for r in out.where("a = 'hello'").collect()) == [1, 3] and fresh.count() == 1
    assert tr.cached_generate(rows, fresh, "p", "a", lambda: tr.echo)[1].count() == 0


def test_registered_queries_have_oracles_that_exist():
    queries, oracles = __spark_entry__.queries(), __spark_entry__.oracle_sql()
    assert set(oracles) <= set(queries) and len(queries) > 100


def test_entry(spark):
    rows = __spark_entry__.entry(spark).collect()
    assert len(rows) == 16 and sum(r.records for r in rows) > 0


def test_replies_and_judging():
    from quillet.functions import replies as rp
    from quillet.operators import judging as jd

    assert rp.parse_reply('x [1] {"a": 2}') == [1] and rp.parse_reply("```\n{}\n```") == {}
    with pytest.raises(ValueError):
        rp.parse_reply("nothing {")
    assert rp.judge_identity("m", {}, {}) == "m" and len(rp.judge_identity("m", {"t": 1}, {})) == 18
    assert rp.endpoint("http://a/", "/health") == rp.endpoint("http://a/health", "/health") == "http://a/health"
    asked = [{"id": "q1", "n": 2}]
    assert jd.read_answers('{"answers": [{"id": "q1", "option_index": 1}]}', asked) == [("q1", 1)]
    for bad in ("no", '{"answers": []}', '{"answers": [{"id": "q1", "option_index": 2}]}', '{"answers": [{"id": "q1", "option_index": true}]}'):
        with pytest.raises(ev.DataError):
            jd.read_answers(bad, asked)


def test_dictionary_file(spark, tmp_path):
    from quillet.operators.entities import EntityStore

    path = tmp_path / "words.sqlite3"
    db = sqlite3.connect(path)
    db.execute("PRAGMA journal_mode = WAL")
    db.execute("CREATE TABLE protected_entities (id INTEGER, canonical_text, entity_type, domain, normalization_policy, priority INTEGER, enabled INTEGER, source, created_at)")
    db.execute("CREATE TABLE entity_aliases (id INTEGER, entity_id INTEGER, alias)")
    store = EntityStore(*rd.read_dictionary(spark, str(path)))
    db.commit()
    db.close()
    assert store.view().count() == 0
    db = sqlite3.connect(path)
    db.executemany("INSERT INTO protected_entities VALUES (?, ?, 'TERM', ?, 'normalize', ?, ?, 'user', '')", [
        (1, "鬼灵门", "general", 5, 1), (2, "Alpha", "games", 9, 1), (3, "Beta", "games", 0, 0), (4, "Gamma", "films", 0, 1)])
    db.executemany("INSERT INTO entity_aliases VALUES (?, ?, ?)", [(2, 1, "贵灵门"), (1, 1, "鬼林门"), (3, 3, "b")])
    db.commit()
    db.close()
    store = EntityStore(*rd.read_dictionary(spark, str(path)))
    assert [(r.entity_id, r.aliases) for r in store.view("games").collect()] == [(2, []), (1, ["鬼林门", "贵灵门"])]
    assert store.add("Delta", domain="films").get("Delta", "films").entity_id == 5
    assert store.get("Beta", "games").enabled is False


def test_prompts(spark, tmp_path):
    path = tmp_path / "clean.json"
    path.write_text(json.dumps({"_about": "x", "system_prompts": {"_n": "-", "zh": "Z", "en": "E"}, "user_template": {"zh": "u", "ja": "j"}}))
    prompts = rd.read_prompts(spark, str(path))
    assert {tuple(r) for r in prompts.collect()} == {("zh", "Z", "u"), ("en", "E", None), ("ja", None, "j")}
    wanted = spark.createDataFrame([(1, "en"), (2, "fr"), (3, "ja"), (4, None)], "id int, key string")
    assert {tuple(r) for r in rd.prompt_for(prompts, wanted).collect()} == {(1, "en", "E", "u"), (2, "fr", "Z", "u"), (3, "ja", "Z", "j"), (4, None, "Z", "u")}
    assert {r.system for r in rd.prompt_for(prompts, wanted, "none").where("id = 2").collect()} == {""}
    path = tmp_path / "seed.json"
    path.write_text(json.dumps({"seeds": {"_note": "text", "a": {"system": "s", "user_template": "t"}}}))
    assert [tuple(r) for r in rd.read_prompts(spark, str(path), "seeds").collect()] == [("a", "s", "t")]

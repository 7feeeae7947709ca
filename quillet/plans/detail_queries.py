"""Queries of the smaller parts: replies, rubrics, masks, matches, caches and fallbacks."""

from __future__ import annotations

import json
import uuid

import pandas as pd
from pyspark.sql import Window
from pyspark.sql import functions as F

from quillet.functions import replies as rp
from quillet.functions import text as tx
from quillet.operators import calls as cl, evaluation as ev, judging as jd, refinement as rf, segments as sg
from quillet.operators.matching import runs, units
from quillet.operators.windows import cached_windows, utterances
from quillet.plans.base import SQL_SPACE, sql_strip, table
from quillet.plans.evaluation_queries import SQL_MATCHED, literal, matched, rubric, sql_expected
from quillet.plans.session_queries import turns
from quillet.plans.text_queries import sql_glue, store
from quillet.operators import entities as en
from quillet.registry import query
from quillet.sources import readers
from quillet.sources.store import application_folder
from quillet.streaming import sessions as ss
from quillet.streaming import steps

REPLIES = [
    ('```json\n{"a": 1}\n```', '{"a":1}'), ('sure: [1, 2] ok', "[1,2]"), ('x {bad} then {"b": [3]} y', '{"b":[3]}'), ("none", None), ('"s"', '"s"'), ("{", None), (None, None),
]


@query("x08_parse_reply", sql_expected([r for _, r in REPLIES]))
def x08(spark, sf_dir):
    return literal(spark, sf_dir, [x for x, _ in REPLIES]).select("doc_id", rp.reply_json(F.col("x")).alias("result"))


CHECKS = [('{"consistent": true}', True), ('{"consistent": false}', False), ("broken", True), (None, True), ("{}", True), ('ok {"consistent": false} ', False)]


@query("u03_semantic_check", sql_expected([r for _, r in CHECKS], "BOOLEAN"))
def u03(spark, sf_dir):
    return literal(spark, sf_dir, [x for x, _ in CHECKS]).select("doc_id", rp.consistent(F.col("x")).alias("result"))


@query("p13_rubric_questions", f"WITH {SQL_MATCHED} SELECT 's' || id AS sample_id, qid AS question_id, CASE WHEN qid = 'q2' THEN 'format' WHEN toxic = 1 THEN 'filter' ELSE 'content' END AS category, 2 AS options FROM records, (VALUES ('q1'), ('q2')) v(qid) WHERE quality IS NOT NULL")
def p13(spark, sf_dir):
    return ev.rubric_questions(rubric(spark, sf_dir)).select("sample_id", "question_id", "category", F.size("options").alias("options"))


@query("u04_judge_scores", f"WITH {SQL_MATCHED} SELECT sample_id, 0::BIGINT AS score, 3::BIGINT AS max_score FROM matched")
def u04(spark, sf_dir):
    """The whole judge flow with a stand-in that always takes the first option."""
    m = matched(spark, sf_dir)
    q = ev.rubric_questions(m.select("sample_id", "status", "qa"))
    answers = jd.judge(jd.judge_prompts(q, m), lambda: jd.first_option)
    return ev.score_answers(q, answers).groupBy("sample_id").agg(F.sum("score").alias("score"), F.sum("max_score").alias("max_score"))


@query("s04_rubric_file", "SELECT 'b' || item_id AS sample_id, 'success' AS status, md5(text) AS clean_md5, 1 AS questions FROM benchmark")
def s04(spark, sf_dir):
    """benchmark written as one rubric file and read back."""
    qa = F.array(F.struct(F.lit("q1").alias("id"), F.lit("content").alias("category"), F.lit("?").alias("question"), F.lit("e").alias("evidence"), F.lit("yes（1），no（0）").alias("options")))
    item = F.struct(F.concat(F.lit("b"), "item_id").alias("source_record_id"), F.lit("success").alias("status"), F.col("text").alias("clean"), qa.alias("qa"))
    path = f"{application_folder(spark)}/rubric-{uuid.uuid4().hex}"
    # the benchmark is one bounded file in this format
    table(spark, sf_dir, "benchmark").agg(F.collect_list(item).alias("items")).coalesce(1).write.json(path)
    back = readers.read_rubric(spark, path)
    return back.select("sample_id", "status", F.md5("clean").alias("clean_md5"), F.size(F.from_json("qa", "array<string>")).alias("questions"))


@query("s14_hypothesis_changes", "SELECT session, count(*) AS changes FROM (SELECT user_id AS session, event_type AS t, lag(event_type) OVER (PARTITION BY user_id ORDER BY event_id) AS b FROM events) WHERE t IS DISTINCT FROM b GROUP BY session")
def s14(spark, sf_dir):
    from quillet.operators.windows import changed_text

    e = table(spark, sf_dir, "events").select(F.col("user_id").alias("session"), F.col("event_id").alias("pos"), F.col("event_type").alias("text"))
    return changed_text(e).groupBy("session").agg(F.count("*").alias("changes"))


@query("e12_e15_units", r"""SELECT item_id, length(regexp_replace(lower(replace(text, 'ß', 'ss')), '[\p{P}\p{Z}\s]', '', 'g')) AS units, len(list_filter(string_split_regex(text, '[。！？!?\n\r]'), lambda x: x <> '')) AS runs FROM benchmark""")
def e12(spark, sf_dir):
    """Comparable characters and runs of each text; line ends are no units here."""

    @F.pandas_udf("struct<units:bigint,runs:bigint>")
    def count(texts: pd.Series) -> pd.DataFrame:
        return pd.DataFrame({"units": [len(units("".join(t.split()))[0]) for t in texts], "runs": [sum(1 for _ in runs(t)) for t in texts]})

    return table(spark, sf_dir, "benchmark").select("item_id", count("text").alias("c")).select("item_id", "c.*")


@query("e02_update_entity", "SELECT n_nationkey::BIGINT AS entity_id, CASE WHEN n_nationkey = 4 THEN 99 ELSE n_nationkey % 3 END::INT AS priority FROM nation")
def e02(spark, sf_dir):
    return store(spark, sf_dir).update(4, priority=99).entities.select("entity_id", "priority")


@query("g16_fallback", f"SELECT doc_id AS id, md5({sql_strip('text')}) AS clean_md5, false AS accepted, 'refiner_error' AS reason FROM documents")
def g16(spark, sf_dir):
    """A refiner that fails leaves each text's deterministic baseline."""
    rows = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.btrim("text", F.lit(" \n\t\r")).alias("text"))
    out = rf.refine_batch(rows, None, lambda: sg.failing, mode="off")
    return out.select("id", F.md5("clean_text").alias("clean_md5"), "accepted", F.array_join("reasons", ",").alias("reason"))


def sql_shared(a: str, b: str) -> str:
    return f"coalesce(list_max(list_transform(range(1, least(len({a}), len({b})) + 1), lambda n: CASE WHEN {a}[1:n] = {b}[1:n] THEN n ELSE 0 END)), 0)"


@query("g06_window_cache", rf"""
WITH RECURSIVE h AS (SELECT session, seq, {sql_strip('t')} AS t FROM (SELECT conv_id::VARCHAR AS session, turn AS seq, string_agg(text, ' ') OVER (PARTITION BY conv_id ORDER BY turn) AS t FROM conversations)),
c(session, seq, k, b, chunk) AS (
  SELECT session, seq, 0, 0, NULL::VARCHAR FROM h
  UNION ALL
  SELECT session, seq, k + 1, b + n, substr(w, 1, n) FROM (
    SELECT session, seq, k, b, w, CASE WHEN sentence <> '' AND length(sentence) <= 80 THEN length(sentence)
      WHEN length(w) <= 80 THEN length(w) WHEN soft <> '' THEN length(soft) ELSE 80 END AS n
    FROM (
      SELECT session, seq, k, b, w, regexp_extract(w, '^[^{tx.SENTENCE_END}]*[{tx.SENTENCE_END}]{SQL_SPACE}*') AS sentence,
        regexp_extract(substr(w, 1, 80), '^(?s:.*)[{tx.SOFT_BREAK}]{SQL_SPACE}*') AS soft
      FROM (SELECT c.session, c.seq, k, b, substr(t, b + 1, 81) AS w FROM c JOIN h USING (session, seq) WHERE b < length(t))
    )
  )
), l AS (SELECT session, seq, list(p ORDER BY k) FILTER (p <> '') AS ch FROM (SELECT *, {sql_strip('chunk')} AS p FROM c WHERE k > 0) GROUP BY ALL),
s AS (SELECT h.session, h.seq, coalesce(ch, []) AS ch FROM h LEFT JOIN l USING (session, seq)),
o AS (SELECT session, seq, ch[1:greatest(len(ch) - 3, 0)] AS older, ch[greatest(len(ch) - 2, 1)] AS x, CASE WHEN len(ch) > 1 THEN ch[greatest(len(ch) - 1, 2)] END AS y, CASE WHEN len(ch) > 2 THEN ch[len(ch)] END AS z FROM s),
g AS (SELECT *, {sql_glue('x', 'y')} AS xy FROM o), a AS (SELECT *, {sql_glue('xy', 'z')} AS act FROM g),
p AS (SELECT *, coalesce(lag(older) OVER w, []) AS po, lag(act) OVER w AS pa FROM a WINDOW w AS (PARTITION BY session ORDER BY seq)),
r AS (SELECT *, {sql_shared('older', 'po')} AS reused FROM p)
SELECT session, seq, len(older)::INT AS committed, reused::INT AS reused, (len(po) - reused)::INT AS revised, md5(act) AS active_md5,
  (sum(len(older) - reused + (act IS DISTINCT FROM pa)::INT) OVER (PARTITION BY session ORDER BY seq))::INT AS calls FROM r
""")
def g06(spark, sf_dir):
    """Cumulative texts of each conversation through the cached window: what is refined anew."""
    said = F.collect_list("text").over(Window.partitionBy("session").orderBy("seq").rowsBetween(Window.unboundedPreceding, 0))
    updates = turns(spark, sf_dir).select("session", "seq", F.array_join(said, " ").alias("text"))
    out = cached_windows(updates)
    return out.select("session", "seq", "committed", "reused", "revised", F.md5("active").alias("active_md5"), "calls")


@query("g03_utterances", """WITH RECURSIVE o AS (SELECT user_id AS session, event_id AS pos, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS k, value > 50 AS loud FROM events),
f AS (SELECT session, 0::BIGINT AS k, 0 AS silence, false AS active, 0::BIGINT AS fk, false AS off FROM (SELECT DISTINCT session FROM o)
  UNION ALL SELECT f.session, o.k, CASE WHEN loud THEN 0 ELSE f.silence + 1 END, loud OR f.active AND f.silence + 1 < 2, CASE WHEN loud AND NOT f.active THEN greatest(o.k - 2, 1) ELSE f.fk END, f.active AND NOT loud AND f.silence + 1 >= 2
  FROM f JOIN o ON o.session = f.session AND o.k = f.k + 1),
e AS (SELECT session, fk, k FROM f WHERE off UNION ALL SELECT session, fk, k FROM f WHERE active QUALIFY row_number() OVER (PARTITION BY session ORDER BY k DESC) = 1 AND k = (SELECT max(k) FROM o WHERE o.session = f.session))
SELECT e.session, a.pos AS first, b.pos AS last FROM e JOIN o a ON a.session = e.session AND a.k = fk JOIN o b ON b.session = e.session AND b.k = e.k""")
def g03(spark, sf_dir):
    """Utterances with what was heard just before them; an event is a quarter of a second."""
    heard = table(spark, sf_dir, "events").select(F.col("user_id").alias("session"), F.col("event_id").alias("pos"), F.col("value").alias("rms"), F.lit(0.25).alias("seconds"))
    return utterances(heard, threshold=50.0)


@query("g08_g09_memory_limits", "SELECT session, least(3, count(*))::INT AS entries FROM (SELECT DISTINCT user_id::VARCHAR AS session, event_type FROM events) GROUP BY session")
def g08(spark, sf_dir):
    """With room for three entities a session never holds more."""
    seen = table(spark, sf_dir, "events").select(F.col("user_id").cast("string").alias("session"), F.col("event_id").alias("seq"), F.col("event_type").alias("canonical_text"), F.lit(0.0).alias("now_ms"))
    load = lambda raw: steps.MemoryState.load(raw) if raw else steps.MemoryState(capacity=3)
    return ss.replay(seen, ss.MEMORY, load, ss.memory_events).groupBy("session").agg(F.max("entries").alias("entries"))


def underlined(text: str) -> str:
    """Stand-in for an external service."""
    return text.replace(" ", "_")


@query("u08_answered_once", "SELECT doc_id, md5(replace(text, ' ', '_')) AS answer_md5, false AS failed, false AS again FROM documents")
def u08(spark, sf_dir):
    """Every distinct text through a service once; a second run finds all answers kept."""
    path = f"{application_folder(spark)}/answers-{uuid.uuid4().hex}"
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    first = cl.answered(docs, "text", path, lambda: underlined)
    known = cl.read_answers(spark, path).select(F.col("key").alias("_known"))
    key = F.sha2(F.concat(F.lit("\n"), F.col("text")), 256)
    kept = first.join(known, key == F.col("_known"), "left")
    return kept.select("doc_id", F.md5("answer").alias("answer_md5"), F.col("error").isNotNull().alias("failed"), (F.col("text").isNotNull() & F.col("_known").isNull()).alias("again"))

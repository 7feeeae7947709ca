"""Queries of benchmark evaluation and text metrics."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillet.functions import metrics as mx
from quillet.functions import text as tx
from quillet.operators import evaluation as ev
from quillet.plans.base import SQL_RECORDS, records, sql_strip, table
from quillet.registry import query


def literal(spark, sf_dir, values, columns: dict[str, str] | None = None):
    """documents with the literal ``x`` at doc_id modulo the number of values, as ``x``."""
    k = (F.col("doc_id") % len(values)).cast("int")
    return table(spark, sf_dir, "documents").select("doc_id", k.alias("k"), F.get(F.array(*[F.lit(v) for v in values]), k).alias("x"))


def sql_expected(results: list, kind: str = "VARCHAR") -> str:
    """documents with the expected result of their literal."""
    def show(r):
        if r is None:
            return f"NULL::{kind}"
        return f"'{r}'" if isinstance(r, str) else f"{str(r).lower()}::{kind}"

    rows = ", ".join(f"({i}, {show(r)})" for i, r in enumerate(results))
    return f"SELECT doc_id, result FROM documents JOIN (VALUES {rows}) t(k, result) ON doc_id % {len(results)} = k"


ASR = [
    ('{"output": {"ok": true, "clean_text": " hi "}}', "hi"),
    ('{"output": {"ok": false, "clean_text": "no"}, "formalasr_status": "ok", "formalasr_text": " formal "}', "formal"),
    ('{"output": {"ok": "true", "clean_text": "no"}}', None),
    ('{"output": {"ok": true, "clean_text": "  "}}', None),
    ('{"formalasr_status": "bad", "formalasr_text": "no"}', None),
    ('{"output": [1]}', None), ("not json", None), (None, None),
    ('{"output": {"ok": true, "clean_text": 5}}', None),
]


@query("p09_asr_text", sql_expected([r for _, r in ASR]))
def p09(spark, sf_dir):
    return literal(spark, sf_dir, [x for x, _ in ASR]).select("doc_id", ev.asr_text(F.col("x")).alias("result"))


LATENCY = [
    ('{"output": {"total_latency_ms": 5, "stt_latency_ms": 1}}', 5.0), ('{"total_latency_ms": 7.5, "latency_ms": 1}', 7.5),
    ('{"output": {"total_latency_ms": -1}, "formalasr_latency_ms": 3}', 3.0), ('{"output": {"stt_latency_ms": 2, "llm_latency_ms": 3}}', 5.0),
    ('{"output": {"stt_latency_ms": 2}, "latency_ms": 9}', 9.0), ('{"latency_ms": true}', None), ('{"latency_ms": "4"}', None), ("{}", None), (None, None),
]


@query("p10_asr_latency", sql_expected([r for _, r in LATENCY], "DOUBLE"))
def p10(spark, sf_dir):
    return literal(spark, sf_dir, [x for x, _ in LATENCY]).select("doc_id", ev.asr_latency(F.col("x")).alias("result"))


ERRORS = [
    ('{"output": {"error": "boom"}}', "boom"), ('{"formalasr_error_message": "late"}', "late"), ('{"output": {"error": null}}', ev.NO_OUTPUT), ("{}", ev.NO_OUTPUT),
]


@query("p11_asr_error", sql_expected([r for _, r in ERRORS]))
def p11(spark, sf_dir):
    return literal(spark, sf_dir, [x for x, _ in ERRORS]).select("doc_id", ev.asr_error(F.col("x")).alias("result"))


OPTIONS = [
    ('[{"text": "good", "score": 2}, {"text": "bad", "score": 0}]', "good=2;bad=0"), ('["good（2）", " bad ( -1 ) "]', "good=2;bad=-1"),
    ('"good（2），so so (1), bad（0）"', "good=2;so so=1;bad=0"), ('"good（2） rest"', None), ('["good"]', None), ('[{"text": "x"}]', None), ("[]", None), ("7", None), (None, None),
]


@query("p12_options", sql_expected([r for _, r in OPTIONS]))
def p12(spark, sf_dir):
    shown = F.array_join(F.transform(ev.parse_options(F.col("x")), lambda o: F.concat(o["text"], F.lit("="), o["score"].cast("string"))), ";")
    return literal(spark, sf_dir, [x for x, _ in OPTIONS]).select("doc_id", shown.alias("result"))


@query("p15_result_record", """SELECT doc_id, md5(text) AS clean_md5, err IS NULL AS ok, err AS error, stt AS stt_latency_ms, stt + 10.0 AS total_latency_ms
FROM (SELECT doc_id, text, CASE WHEN doc_id % 4 = 0 THEN 'failed' END AS err, CASE WHEN doc_id % 3 > 0 THEN (doc_id % 100)::DOUBLE END AS stt FROM documents)""")
def p15(spark, sf_dir):
    stt = F.when(F.col("doc_id") % 3 == 0, F.lit(-1.0)).otherwise((F.col("doc_id") % 100).cast("double"))
    source = table(spark, sf_dir, "documents").select(
        "doc_id", F.struct(F.col("text").alias("raw_text"), stt.alias("stt_latency_ms")).alias("output"),
        F.col("text").alias("clean_text"), F.when(F.col("doc_id") % 4 == 0, "failed").alias("error"), F.lit(10.0).alias("llm_latency_ms"),
    )
    made = ev.result_record(source)
    return made.select("doc_id", F.md5("output.clean_text").alias("clean_md5"), "output.ok", "output.error", "output.stt_latency_ms", "output.total_latency_ms")


INPUTS = [
    ('{"source_record_id": "a", "output": {"raw_text": "t"}}', None), ('{"source_record_id": " ", "output": {"raw_text": "t"}}', "input_error: missing source_record_id"),
    ('{"source_record_id": "a", "output": {"raw_text": ""}}', "input_error: missing output.raw_text"), ('{"source_record_id": "a"}', "input_error: missing output.raw_text"),
]


@query("p16_input_error", sql_expected([r for _, r in INPUTS]))
def p16(spark, sf_dir):
    return literal(spark, sf_dir, [x for x, _ in INPUTS]).select("doc_id", ev.input_error(F.col("x")).alias("result"))


CONFIDENCES = [('{"c": 0.5}', 0.5), ('{"c": 1}', 1.0), ('{"c": 1.5}', None), ('{"c": true}', None), ('{"c": "0.5"}', None), ('{"c": -0.1}', None), ("{}", None)]


@query("p19_confidence", sql_expected([r for _, r in CONFIDENCES], "DOUBLE"))
def p19(spark, sf_dir):
    c = ev.number_at(F.col("x"), "c")
    return literal(spark, sf_dir, [x for x, _ in CONFIDENCES]).select("doc_id", F.when(c <= 1, c).alias("result"))


@query("p21_limit", "SELECT doc_id, lang FROM documents WHERE lang = 'en' ORDER BY doc_id LIMIT 50")
def p21(spark, sf_dir):
    """A report of the first 50 English documents in input order."""
    docs = table(spark, sf_dir, "documents").where("lang = 'en'").select("doc_id", "lang")
    return ev.first_in_order(docs, 50, "doc_id")


@query("p22_sample_subset", "SELECT doc_id, source FROM documents WHERE doc_id IN (SELECT doc_id FROM labels WHERE toxic = 1)")
def p22(spark, sf_dir):
    wanted = table(spark, sf_dir, "labels").where("toxic = 1").select("doc_id")
    return table(spark, sf_dir, "documents").join(wanted, "doc_id", "left_semi").select("doc_id", "source")


# --- rubric and judge -----------------------------------------------------------------


def rubric(spark, sf_dir):
    """documents as rubric samples: two questions for each labelled one, some unusable."""
    r = records(spark, sf_dir)
    option = lambda t, s: F.struct(F.lit(t).alias("text"), F.lit(s).alias("score"))
    question = lambda i, c, best: F.struct(
        F.lit(i).alias("id"), c.alias("category"), F.lit("ask " + i).alias("question"), F.lit("evidence").alias("evidence"),
        F.array(option("bad", 0), option("good", best)).alias("options"),
    )
    first = F.when(F.col("toxic") == 1, "filter").otherwise("content")
    qa = F.to_json(F.array(question("q1", first, 2), question("q2", F.lit("format"), 1)))
    return r.select(
        F.concat(F.lit("s"), F.col("id")).alias("sample_id"), "id", "scene", F.col("refined_text").alias("clean"),
        F.when(F.col("quality").isNotNull(), "success").otherwise("failed").alias("status"), qa.alias("qa"),
    )


def asr(spark, sf_dir):
    """Recogniser output of two documents in three, as JSON; some fail."""
    r = records(spark, sf_dir).where(F.col("source") != "src0")
    ok = F.col("id") % 5 != 0
    record = F.to_json(F.struct(F.struct(
        ok.alias("ok"), F.col("input").alias("clean_text"), F.when(~ok, "lost").alias("error"), (F.col("id") % 700).cast("double").alias("total_latency_ms"),
    ).alias("output")))
    return r.select(F.concat(F.lit("s"), F.col("id")).alias("sample_id"), record.alias("record"))


SQL_MATCHED = f"""{SQL_RECORDS}, matched AS (
  SELECT id, 's' || id AS sample_id, scene, toxic, refined_text AS clean, CASE WHEN id % 5 <> 0 THEN {sql_strip('input')} ELSE '' END AS output,
    (id % 700)::DOUBLE AS latency_ms, CASE WHEN id % 5 = 0 THEN 'lost' END AS asr_error
  FROM records WHERE quality IS NOT NULL AND source <> 'src0'
)"""


def matched(spark, sf_dir):
    return ev.match_records(rubric(spark, sf_dir), asr(spark, sf_dir))


@query("j01_match_records", f"WITH {SQL_MATCHED} SELECT sample_id, scene, md5(output) AS output_md5, latency_ms, asr_error FROM matched")
def j01(spark, sf_dir):
    return matched(spark, sf_dir).select("sample_id", "scene", F.md5("output").alias("output_md5"), "latency_ms", "asr_error")


@query("a17_benchmark_counts", f"WITH {SQL_MATCHED} SELECT (SELECT count(*) FROM records WHERE source <> 'src0') AS input_count, (SELECT count(*) FROM matched) AS matched_count, (SELECT count(*) FROM records WHERE source <> 'src0') - (SELECT count(*) FROM matched) AS out_of_benchmark, 0::BIGINT AS failed_asr")
def a17(spark, sf_dir):
    m = matched(spark, sf_dir).select("sample_id", F.lit(1).alias("in_rubric"), F.col("output").isNull().alias("failed"))
    both = asr(spark, sf_dir).select("sample_id").join(m, "sample_id", "left")
    counts = both.agg(F.count("*").alias("input_count"), F.count("in_rubric").alias("matched_count"), F.count_if("failed").alias("failed_asr"))
    return counts.withColumn("out_of_benchmark", F.col("input_count") - F.col("matched_count"))


def _answers(questions):
    """A stub judge: repeatable answers from the sample and question ids."""
    return questions.select("sample_id", "question_id", (tx.hash_unit("judge", F.col("sample_id"), F.col("question_id")) * 2).cast("int").alias("option_index"))


def scored(spark, sf_dir):
    q = ev.rubric_questions(rubric(spark, sf_dir))
    rows = ev.score_answers(q, _answers(q))
    return rows.join(matched(spark, sf_dir).select("sample_id", "scene", "asr_error"), "sample_id").withColumn("asr_retry_exhausted", F.col("asr_error").isNotNull())


UNIT = "('0x' || substr(md5(concat_ws('|', 'judge', sample_id, question_id)), 1, 8))::BIGINT / 4294967296.0::DOUBLE"
SQL_SCORED = f"""{SQL_MATCHED}, q AS (
  SELECT m.*, qid AS question_id, CASE WHEN qid = 'q2' THEN 'format' WHEN toxic = 1 THEN 'filter' ELSE 'content' END AS category, CASE WHEN qid = 'q1' THEN 2 ELSE 1 END AS max_score
  FROM matched m, (VALUES ('q1'), ('q2')) v(qid)
), scored AS (SELECT *, floor({UNIT} * 2)::INT AS option_index, CASE WHEN floor({UNIT} * 2) = 1 THEN max_score ELSE 0 END AS score FROM q)"""


@query("j02_score_answers", f"WITH {SQL_SCORED} SELECT sample_id, question_id, category, CASE WHEN option_index = 1 THEN 'good' ELSE 'bad' END AS selected_option, score, max_score FROM scored")
def j02(spark, sf_dir):
    return scored(spark, sf_dir).select("sample_id", "question_id", "category", "selected_option", "score", "max_score")


@query("a01_summary", f"""WITH {SQL_SCORED} SELECT CASE WHEN GROUPING(category, scene) = 3 THEN 'overall' WHEN GROUPING(category) = 0 THEN 'category' ELSE 'scene' END AS dimension,
  coalesce(category, scene, '') AS value, count(*) AS question_count, sum(score)::BIGINT AS total_score, sum(max_score)::BIGINT AS max_possible_score,
  round(sum(score) / sum(max_score)::DOUBLE, 9) AS normalized_score FROM scored GROUP BY GROUPING SETS ((), (category), (scene))""")
def a01(spark, sf_dir):
    return ev.summarize(scored(spark, sf_dir)).withColumn("normalized_score", F.round("normalized_score", 9))


@query("a02_run_counters", f"""WITH {SQL_SCORED} SELECT 0::BIGINT AS failed_question_count, count(*) FILTER (WHERE asr_error IS NOT NULL) AS asr_retry_exhausted_question_count,
  count(DISTINCT sample_id) FILTER (WHERE asr_error IS NOT NULL) AS asr_retry_exhausted_sample_count FROM scored""")
def a02(spark, sf_dir):
    return ev.run_counters(scored(spark, sf_dir))


def judge_log(spark, sf_dir):
    """events as an append-only judge log: one row a rewrite of (user, event type)."""
    return table(spark, sf_dir, "events").select(
        F.concat(F.lit("s"), F.col("user_id")).alias("sample_id"), F.col("event_type").alias("question_id"), "ts", "event_id",
        F.when(F.col("event_id") % 7 == 0, "error").otherwise("success").alias("status"),
        F.concat(F.lit("sig"), F.when(F.col("event_id") % 10 == 0, 9).otherwise(F.col("user_id") % 3).cast("string")).alias("evaluation_signature"), "value",
    )


SQL_LOG = """log AS (SELECT 's' || user_id AS sample_id, event_type AS question_id, ts, event_id, CASE WHEN event_id % 7 = 0 THEN 'error' ELSE 'success' END AS status,
  'sig' || CASE WHEN event_id % 10 = 0 THEN 9 ELSE user_id % 3 END AS evaluation_signature, value FROM events), latest AS (SELECT * FROM log QUALIFY row_number() OVER (PARTITION BY sample_id, question_id ORDER BY ts DESC, event_id DESC) = 1)"""


def _latest(spark, sf_dir):
    return ev.latest_rows(judge_log(spark, sf_dir), ["sample_id", "question_id"], ["ts", "event_id"])


@query("a08_latest_rows", f"WITH {SQL_LOG} SELECT sample_id, question_id, event_id, status FROM latest")
def a08(spark, sf_dir):
    return _latest(spark, sf_dir).select("sample_id", "question_id", "event_id", "status")


def _current(spark, sf_dir):
    log = judge_log(spark, sf_dir)
    n = F.substring("sample_id", 2, 12).cast("long")
    expected = log.select("sample_id", "question_id").distinct().withColumn(
        "evaluation_signature", F.concat(F.lit("sig"), F.pmod(n, F.lit(3)).cast("string"))
    )
    return ev.current_rows(expected, _latest(spark, sf_dir))


SQL_CURRENT = f"""{SQL_LOG}, cur AS (SELECT e.sample_id, e.question_id, l.event_id, l.status FROM (SELECT DISTINCT sample_id, question_id, 'sig' || substr(sample_id, 2)::BIGINT % 3 AS sig FROM log) e
  LEFT JOIN latest l ON l.sample_id = e.sample_id AND l.question_id = e.question_id AND l.evaluation_signature = e.sig)"""


@query("j03_current_rows", f"WITH {SQL_CURRENT} SELECT sample_id, question_id, coalesce(event_id, -1) AS event_id FROM cur")
def j03(spark, sf_dir):
    return _current(spark, sf_dir).select("sample_id", "question_id", F.coalesce("row.event_id", F.lit(-1)).alias("event_id"))


@query("a09_completed_samples", f"WITH {SQL_CURRENT} SELECT sample_id FROM cur GROUP BY sample_id HAVING bool_and(coalesce(status = 'success', false))")
def a09(spark, sf_dir):
    return ev.completed_samples(_current(spark, sf_dir))


@query("j05_pending_samples", f"WITH {SQL_CURRENT} SELECT DISTINCT sample_id FROM cur WHERE sample_id NOT IN (SELECT sample_id FROM cur GROUP BY sample_id HAVING bool_and(coalesce(status = 'success', false)))")
def j05(spark, sf_dir):
    current = _current(spark, sf_dir)
    return ev.pending(current.select("sample_id").distinct(), ev.completed_samples(current), "sample_id")


def _outcomes(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    kind = F.pmod("event_id", F.lit(5))
    return e.select(F.col("user_id").alias("id"), F.struct("ts", "event_id").alias("pos"), (kind < 2).alias("ok"), F.when(kind == 2, "input_error: missing").when(kind == 3, "timeout").alias("error"))


SQL_DONE = """done AS (SELECT user_id AS id FROM (SELECT user_id, event_id FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1) WHERE event_id % 5 <= 2)"""


@query("a10_completed_records", f"WITH {SQL_DONE} SELECT id FROM done")
def a10(spark, sf_dir):
    return ev.completed_records(_outcomes(spark, sf_dir))


@query("j04_pending_records", f"WITH {SQL_DONE} SELECT DISTINCT user_id AS id FROM events WHERE user_id NOT IN (SELECT id FROM done)")
def j04(spark, sf_dir):
    out = _outcomes(spark, sf_dir)
    return ev.pending(out.select("id").distinct(), ev.completed_records(out), "id")


@query("a11_duplicate_keys", "SELECT user_id, event_type, count(*) AS rows FROM events GROUP BY ALL HAVING count(*) > 1")
def a11(spark, sf_dir):
    return ev.duplicate_keys(table(spark, sf_dir, "events"), "user_id", "event_type")


@query("x17_content_signature", """SELECT doc_id, sha256('{"oral":"' || lang || '","clean":"' || source || '","n":' || n_chars || '}') AS signature FROM documents WHERE lang IS NOT NULL""")
def x17(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").where("lang is not null")
    return docs.select("doc_id", ev.content_signature(F.col("lang").alias("oral"), F.col("source").alias("clean"), F.col("n_chars").alias("n")).alias("signature"))


@query("x19_cache_key", "SELECT doc_id, sha256(concat_ws(chr(10), 'tts', 'voice', lang, '16000', text, source, 'v1')) AS cache_key FROM documents")
def x19(spark, sf_dir):
    key = F.concat_ws("\n", F.lit("tts"), F.lit("voice"), "lang", F.lit("16000"), "text", "source", F.lit("v1"))
    return table(spark, sf_dir, "documents").select("doc_id", F.sha2(key, 256).alias("cache_key"))


@query("x20_prompt", f"SELECT doc_id, md5('Refine: ' || {sql_strip('text')} || CASE WHEN lang = 'en' THEN '' ELSE ' <KEY>[' || lang || '、' || source || ']' END) AS prompt_md5 FROM documents")
def x20(spark, sf_dir):
    hints = F.when(F.col("lang") == "en", F.array().cast("array<string>")).otherwise(F.array("lang", "source"))
    suffix = F.when(F.size(hints) > 0, F.concat(F.lit(" <KEY>["), F.array_join(F.slice(hints, 1, 16), "、"), F.lit("]"))).otherwise(F.lit(""))
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(F.concat(F.lit("Refine: "), tx.strip(F.col("text")), suffix)).alias("prompt_md5"))


FRAGMENTS = [("say {\"a\": 1} ok", '{"a": 1}'), ("{x} and {y}", "{x} and {y}"), ("none", None), ("} {", None), ("a\n{\n}\n", "{\n}"), (None, None)]


@query("x09_json_fragment", sql_expected([r for _, r in FRAGMENTS]))
def x09(spark, sf_dir):
    return literal(spark, sf_dir, [x for x, _ in FRAGMENTS]).select("doc_id", tx.fragment_json(F.col("x")).alias("result"))


VERDICTS = [
    ('{"answers": [{"id": "q1", "option_index": 0}, {"id": "q2", "option_index": 1}]}', None), ('x {"answers": [{"id": "q1", "option_index": 0}]}', "missing_id"),
    ('{"answers": [{"id": "q1", "option_index": 2}, {"id": "q2", "option_index": 1}]}', "index_out_of_range"), ('{"answers": [{"id": "q1", "option_index": true}, {"id": "q2", "option_index": 1}]}', "index_out_of_range"),
    ('{"answers": [{"id": "q1", "option_index": 0}, {"id": "q3", "option_index": 1}]}', "unknown_id"), ('{"answers": [{"id": "q1", "option_index": 0}, {"id": "q1", "option_index": 1}]}', "repeated_id"), ("sorry", "no_answers"),
]


@query("x10_validate_answers", sql_expected([r for _, r in VERDICTS]))
def x10(spark, sf_dir):
    ids, sizes = F.array(F.lit("q1"), F.lit("q2")), F.array(F.lit(2), F.lit(3))
    return literal(spark, sf_dir, [x for x, _ in VERDICTS]).select("doc_id", ev.validate_answers(F.col("x"), ids, sizes).alias("result"))


CHAT = [("<|im_start|>assistant\nhi<|im_end|>", "hi"), ("Assistant： hello </s>", "hello"), (" plain ", "plain"), ("assistants", "s"), ("", ""), (None, None)]


@query("x07_clean_response", sql_expected([r for _, r in CHAT]))
def x07(spark, sf_dir):
    return literal(spark, sf_dir, [x for x, _ in CHAT]).select("doc_id", tx.clean_response(F.col("x")).alias("result"))


NAMES = [("zh", "chinese"), (" EN ", "english"), ("auto", None), (None, None), ("klingon", "klingon"), ("Zh-CN", "chinese")]


@query("x16_languages", sql_expected([r for _, r in NAMES]))
def x16(spark, sf_dir):
    return literal(spark, sf_dir, [x for x, _ in NAMES]).select("doc_id", tx.recogniser_language(F.col("x")).alias("result"))


# --- text metrics ----------------------------------------------------------------------

#: Reference and damaged hypothesis of each benchmark text, in plain ASCII.
SQL_PAIRS = """pairs AS (SELECT item_id, regexp_replace(lower(text), '[^a-z0-9 ]', ' ', 'g') AS ref,
  regexp_replace(regexp_replace(lower(text), '[^a-z0-9 ]', ' ', 'g'), '(e|th\\w*)', '', 'g') AS hyp FROM benchmark)""".replace("\\\\", "\\")


def pairs(spark, sf_dir):
    ref = F.regexp_replace(F.lower("text"), "[^a-z0-9 ]", " ")
    return table(spark, sf_dir, "benchmark").select("item_id", ref.alias("ref"), F.regexp_replace(ref, r"(e|th\w*)", "").alias("hyp"))


@query("m02_m03_tokens", r"SELECT item_id, len(regexp_extract_all(lower(text), '[\x{3400}-\x{4dbf}\x{4e00}-\x{9fff}]+|[a-z0-9]+')) AS words, len(regexp_extract_all(lower(text), '[\x{3400}-\x{4dbf}\x{4e00}-\x{9fff}]|[a-z0-9]+')) AS mixed FROM (SELECT item_id, text || ' 鬼灵们 is鬼灵' AS text FROM benchmark)")
def m02(spark, sf_dir):
    t = F.lower(F.concat("text", F.lit(" 鬼灵们 is鬼灵")))
    return table(spark, sf_dir, "benchmark").select("item_id", F.size(mx.word_tokens(t)).cast("long").alias("words"), F.size(mx.mixed_tokens(t)).cast("long").alias("mixed"))


@query("m04_char_distance", f"WITH {SQL_PAIRS} SELECT item_id, levenshtein(replace(ref, ' ', ''), replace(hyp, ' ', ''))::INT AS errors, length(replace(ref, ' ', ''))::INT AS units FROM pairs")
def m04(spark, sf_dir):
    bare = lambda c: F.regexp_replace(c, " ", "")
    return pairs(spark, sf_dir).select("item_id", F.levenshtein(bare("ref"), bare("hyp")).alias("errors"), F.length(bare("ref")).alias("units"))


SQL_CODED = f"""{SQL_PAIRS}, tok AS (SELECT item_id, regexp_extract_all(ref, '[a-z0-9]+') AS r, regexp_extract_all(hyp, '[a-z0-9]+') AS h FROM pairs),
d AS (SELECT *, list_distinct(list_concat(r, h)) AS dict FROM tok),
coded AS (SELECT item_id, len(r) AS units, list_aggregate(list_transform(r, lambda x: chr(list_position(dict, x)::INT)), 'string_agg', '') AS a,
  list_aggregate(list_transform(h, lambda x: chr(list_position(dict, x)::INT)), 'string_agg', '') AS b FROM d)"""


@query("m05_token_distance", f"WITH {SQL_CODED} SELECT item_id, levenshtein(a, b)::INT AS errors, units::INT AS units FROM coded")
def m05(spark, sf_dir):
    r, h = mx.word_tokens(F.col("ref")), mx.word_tokens(F.col("hyp"))
    return pairs(spark, sf_dir).select("item_id", mx.token_distance(r, h).alias("errors"), F.size(r).alias("units"))


@query("m06_text_metrics", f"""WITH {SQL_CODED} SELECT coded.item_id, levenshtein(a, b)::INT AS wer_errors, units::INT AS wer_units, levenshtein(replace(ref, ' ', ''), replace(hyp, ' ', ''))::INT AS cer_errors,
  length(replace(ref, ' ', ''))::INT AS cer_units, levenshtein(a, b)::INT AS mer_errors, units::INT AS mer_units FROM coded JOIN pairs USING (item_id)""")
def m06(spark, sf_dir):
    return pairs(spark, sf_dir).select("item_id", mx.text_metrics(F.col("ref"), F.col("hyp")).alias("m")).select("item_id", "m.*")


@query("m07_similarity", f"WITH {SQL_PAIRS} SELECT item_id, round(1 - levenshtein(ref, hyp) / greatest(length(ref), length(hyp))::DOUBLE, 9) AS similarity FROM pairs")
def m07(spark, sf_dir):
    return pairs(spark, sf_dir).select("item_id", F.round(mx.similarity(F.col("ref"), F.col("hyp")), 9).alias("similarity"))


@query("m01_normalize_text", r"""SELECT doc_id, md5(trim(regexp_replace(replace(lower(nfc_normalize(text)), 'ß', 'ss'), '[\p{P}\p{S}\p{Z}\s]+', ' ', 'g'))) AS normal_md5 FROM documents""")
def m01(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(mx.normalize_text(F.col("text"))).alias("normal_md5"))


@query("a04_sample_rates", f"WITH {SQL_PAIRS}, m AS (SELECT item_id, levenshtein(ref, hyp) AS e, length(ref) * (item_id % 4)::INT AS u FROM pairs) SELECT item_id, round(CASE WHEN u <> 0 THEN e / u::DOUBLE WHEN e = 0 THEN 0.0 ELSE 1.0 END, 9) AS rate FROM m")
def a04(spark, sf_dir):
    units = F.length("ref") * (F.col("item_id") % 4)
    return pairs(spark, sf_dir).select("item_id", F.round(mx.sample_rate(F.levenshtein("ref", "hyp"), units), 9).alias("rate"))


@query("a03_asr_summary", f"""WITH {SQL_CODED} SELECT count(*) AS sample_count, round(sum(levenshtein(a, b)) / sum(units)::DOUBLE, 9) AS wer,
  round(sum(levenshtein(replace(ref, ' ', ''), replace(hyp, ' ', ''))) / sum(length(replace(ref, ' ', '')))::DOUBLE, 9) AS cer,
  count(*) FILTER (WHERE item_id % 3 = 0) AS missing_latency_sample_count, round(avg(CASE WHEN item_id % 3 > 0 THEN item_id END), 9) AS average_latency_ms
FROM coded JOIN pairs USING (item_id)""")
def a03(spark, sf_dir):
    latency = F.when(F.col("item_id") % 3 > 0, F.col("item_id").cast("double"))
    once = pairs(spark, sf_dir).select(F.col("item_id").alias("sample_id"), F.col("ref").alias("clean"), F.col("hyp").alias("output"), latency.alias("latency_ms"), F.lit(1).alias("pos"))
    twice = once.unionByName(once.withColumn("output", F.lit("stale")).withColumn("pos", F.lit(0)))
    out = ev.summarize_asr(twice)
    return out.select("sample_count", F.round("wer", 9).alias("wer"), F.round("cer", 9).alias("cer"), "missing_latency_sample_count", F.round("average_latency_ms", 9).alias("average_latency_ms"))


@query("a14_sentences", r"""SELECT doc_id, md5(s) AS sentence_md5, count(*) AS n FROM (
  SELECT doc_id, trim(s) AS s FROM (SELECT doc_id, unnest(string_split_regex(regexp_replace(text, '([。！？!?；;\n])', chr(1) || '\1' || chr(2), 'g'), chr(2))) AS s0 FROM documents), LATERAL (SELECT """ + sql_strip("replace(s0, chr(1), '')") + """ AS s)) WHERE s <> '' GROUP BY 1, 2""")
def a14(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", F.explode(tx.sentences(F.col("text"))).alias("s"))
    return docs.groupBy("doc_id", F.md5("s").alias("sentence_md5")).agg(F.count("*").alias("n"))


@query("a15_window_merge", "SELECT conv_id, sum(length(text))::BIGINT AS latency, bool_and(length(text) > 60) AS accepted, string_agg(role, ',' ORDER BY turn) AS reasons FROM conversations GROUP BY conv_id")
def a15(spark, sf_dir):
    turns = table(spark, sf_dir, "conversations")
    return turns.groupBy("conv_id").agg(
        F.sum(F.length("text").cast("long")).alias("latency"), F.every(F.length("text") > 60).alias("accepted"),
        F.array_join(F.flatten(F.transform(F.sort_array(F.collect_list(F.struct("turn", F.array("role").alias("r")))), lambda x: x["r"])), ",").alias("reasons"),
    )


@query("a16_mean_confidence", """SELECT user_id, event_type, round(avg(c), 9) AS mean_confidence, count(c) AS observations FROM (
  SELECT user_id, event_type, obs, min_by(c, event_id) AS c FROM (SELECT user_id, event_type, event_id, event_id % 11 AS obs, CASE WHEN value BETWEEN 0 AND 1 THEN value WHEN value > 1 THEN 1 / value END AS c FROM events) WHERE c IS NOT NULL GROUP BY 1, 2, 3) GROUP BY 1, 2""")
def a16(spark, sf_dir):
    c = F.when(F.col("value").between(0, 1), F.col("value")).when(F.col("value") > 1, 1 / F.col("value"))
    seen = table(spark, sf_dir, "events").select("user_id", "event_type", "event_id", (F.col("event_id") % 11).alias("obs"), c.alias("c")).where("c is not null")
    once = seen.groupBy("user_id", "event_type", "obs").agg(F.min_by("c", "event_id").alias("c"))
    return once.groupBy("user_id", "event_type").agg(F.round(F.avg("c"), 9).alias("mean_confidence"), F.count("c").alias("observations"))

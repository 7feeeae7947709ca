"""Queries of record assembly, rule QC, sampling and distribution."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillet.functions import keywords as kw
from quillet.functions import text as tx
from quillet.operators import records as ops
from quillet.plans.base import SQL_RECORDS, records, sql_collapse, sql_scene, sql_simulate, sql_strip, table
from quillet.registry import query
from quillet.settings import SCENES

RATIO_ROWS = ", ".join(f"('{k}', {r}::DOUBLE)" for k, (r, _) in SCENES.items())
SQL_MIN_LENGTH = (
    "CASE WHEN starts_with(scene, 'english_') THEN 6 "
    "WHEN scene IN ('vibe_coding','academic','dictation_memo','voice_search','passthrough') THEN 8 ELSE 10 END"
)
TOTAL = 600


def asr_rows(spark, sf_dir):
    """Recogniser rows of the documents: refined where the label is good, oral = text."""
    r = records(spark, sf_dir)
    return r.select(
        "id", "scene", "language", F.col("refined_text").alias("input"), F.col("input").alias("oral_text"),
        F.when(F.col("quality") == 1, F.col("input")).when(F.col("quality") == 0, "").alias("refined_text"),
        F.when(F.coalesce("toxic", F.lit(0)) == 0, F.col("refined_text")).alias("clean_text"),
        F.when(F.col("quality").isNotNull(), F.create_map(F.lit("scene"), F.col("source"), F.lit("asr_mode"), F.lit("text_sim"))).alias("meta"),
    )


SQL_ASR = f"""{SQL_RECORDS}, asr AS (
  SELECT id, scene, language, refined_text AS input, input AS oral_text,
    CASE WHEN quality = 1 THEN input WHEN quality = 0 THEN '' END AS refined_text,
    CASE WHEN coalesce(toxic, 0) = 0 THEN refined_text END AS clean_text, source, quality IS NOT NULL AS has_meta FROM records
)"""
FATE = f"""CASE WHEN coalesce(a, '') = '' OR coalesce(b, '') = '' THEN 'skipped_empty'
  WHEN length({sql_strip("a")}) < 2 OR length({sql_strip("b")}) < {SQL_MIN_LENGTH} THEN 'skipped_short' ELSE 'kept' END"""


def _digest(df):
    return df.select(
        "id", "scene", F.md5("input").alias("input_md5"), F.md5("refined_text").alias("refined_md5"),
        F.element_at("meta", "scene").alias("meta_scene"), F.element_at("meta", "language").alias("meta_language"),
        F.element_at("meta", "asr_mode").alias("asr_mode"),
    )


@query("p01_assemble_asr", f"""WITH {SQL_ASR}, x AS (
  SELECT *, input AS a, coalesce(nullif(refined_text, ''), clean_text) AS b FROM asr)
SELECT id, scene, md5(a) AS input_md5, md5(b) AS refined_md5, CASE WHEN has_meta THEN source ELSE scene END AS meta_scene,
  coalesce(nullif(language, ''), CASE WHEN starts_with(scene, 'english_') THEN 'en' ELSE 'zh' END) AS meta_language,
  CASE WHEN has_meta THEN 'text_sim' END AS asr_mode
FROM x WHERE {FATE} = 'kept'""")
def p01(spark, sf_dir):
    return _digest(ops.assemble(asr_rows(spark, sf_dir)).where("fate = 'kept'"))


@query("p02_assemble_clean", f"""WITH {SQL_ASR}, x AS (SELECT *, oral_text AS a, clean_text AS b FROM asr)
SELECT id, scene, md5(a) AS input_md5, md5(b) AS refined_md5, scene AS meta_scene,
  coalesce(nullif(language, ''), CASE WHEN starts_with(scene, 'english_') THEN 'en' ELSE 'zh' END) AS meta_language,
  CASE WHEN has_meta THEN 'text_sim' ELSE 'clean_fallback' END AS asr_mode
FROM x WHERE {FATE} = 'kept'""")
def p02(spark, sf_dir):
    return _digest(ops.assemble(asr_rows(spark, sf_dir), fallback=True).where("fate = 'kept'"))


@query("a12_skip_counters", f"""WITH {SQL_ASR}, x AS (SELECT *, input AS a, coalesce(nullif(refined_text, ''), clean_text) AS b FROM asr)
SELECT scene, count(*) AS rows, count(*) FILTER (WHERE fate = 'skipped_empty') AS skipped_empty,
  count(*) FILTER (WHERE fate = 'skipped_short') AS skipped_short FROM (SELECT scene, {FATE} AS fate FROM x) GROUP BY scene""")
def a12(spark, sf_dir):
    return ops.assemble(asr_rows(spark, sf_dir)).groupBy("scene").agg(
        F.count("*").alias("rows"), F.count_if(F.col("fate") == "skipped_empty").alias("skipped_empty"),
        F.count_if(F.col("fate") == "skipped_short").alias("skipped_short"),
    )


@query("p03_min_length", f"SELECT doc_id AS id, {SQL_MIN_LENGTH} AS min_length FROM (SELECT doc_id, {sql_scene('doc_id')} AS scene FROM documents)")
def p03(spark, sf_dir):
    return records(spark, sf_dir).select("id", ops.min_length(F.col("scene")).alias("min_length"))


@query("p04_language", f"""SELECT doc_id AS id, coalesce(nullif(CASE WHEN doc_id % 3 = 0 THEN '' ELSE lang END, ''),
  CASE WHEN doc_id % 5 = 0 THEN source END, CASE WHEN starts_with({sql_scene('doc_id')}, 'english_') THEN 'en' ELSE 'zh' END) AS language FROM documents""")
def p04(spark, sf_dir):
    given = F.when(F.col("id") % 3 == 0, "").otherwise(F.col("language"))
    return records(spark, sf_dir).select("id", ops.language_of(F.col("scene"), given, F.when(F.col("id") % 5 == 0, F.col("source"))).alias("language"))


@query("p05_rule_qc", f"""WITH {SQL_RECORDS}, x AS (SELECT id, scene, CASE WHEN toxic = 1 THEN refined_text || refined_text ELSE refined_text END AS r, input AS i FROM records)
SELECT id, CASE WHEN coalesce(i, '') = '' OR coalesce(r, '') = '' THEN 'empty'
  WHEN length(r) > 1.8 * length(i) AND length(r) - length(i) > 30 THEN 'expanded' WHEN length({sql_strip('i')}) <= 2 THEN 'too_short' END AS reason FROM x""")
def p05(spark, sf_dir):
    r = records(spark, sf_dir)
    doubled = F.when(F.col("toxic") == 1, F.concat("refined_text", "refined_text")).otherwise(F.col("refined_text"))
    return r.select("id", ops.rule_reason(F.col("input"), doubled).alias("reason"))


REPLIES = [
    '{"pass": true}', '{"pass": false, "why": "x"}', '{"why": "x"}', '{"pass": null}', '{"pass": "false"}', '{"pass": ""}', '{"pass": 0}',
    "true, fine", "TRUE", "false", "maybe", None, "{broken", '{"pass": 1}', ' {"pass": []} ', '{"pass": [0]}',
]
REPLY_PASSES = [True, False, True, False, True, False, False, True, True, False, False, False, False, True, False, True]


@query("p06_judge_verdict", "SELECT k::INT AS k, p::BOOLEAN AS passed, count(*) AS documents FROM (VALUES "
       + ", ".join(f"({i}, {str(p).lower()})" for i, p in enumerate(REPLY_PASSES)) + f") t(k, p) JOIN documents ON doc_id % {len(REPLIES)} = k GROUP BY k, p")
def p06(spark, sf_dir):
    replies = F.array(*[F.lit(r) for r in REPLIES])
    k = (F.col("doc_id") % len(REPLIES)).cast("int")
    docs = table(spark, sf_dir, "documents").select(k.alias("k"), F.get(replies, k).alias("reply"))
    return docs.groupBy("k", ops.judge_verdict(F.col("reply")).alias("passed")).agg(F.count("*").alias("documents"))


@query("p08_spoken_numbers", """SELECT doc_id, regexp_matches(t, '[一-三四五六七八九十百千万亿]+[年月日号]')::INT + regexp_matches(t, '百分之[零一二三四五六七八九十百千万]+')::INT AS issues
FROM (SELECT doc_id, ([text, '三十年', '百分之五十', '百分之一十日', '3年'])[(doc_id % 5 + 1)::INT] AS t FROM documents)""")
def p08(spark, sf_dir):
    t = F.get(F.array(F.col("text"), *map(F.lit, ("三十年", "百分之五十", "百分之一十日", "3年"))), (F.col("doc_id") % 5).cast("int"))
    return table(spark, sf_dir, "documents").select("doc_id", F.size(kw.spoken_numbers_left(t)).alias("issues"))


@query("p14_sft_rows", f"""WITH {SQL_RECORDS} SELECT id, 3 AS turns, md5(input) AS human_md5, md5(refined_text) AS gpt_md5 FROM records
WHERE coalesce(input, '') <> '' AND coalesce(refined_text, '') <> ''""")
def p14(spark, sf_dir):
    sft = ops.sft_rows(records(spark, sf_dir), system="Refine the transcript.")
    return sft.select("id", F.size("conversations").alias("turns"), F.md5(F.col("conversations")[1]["value"]).alias("human_md5"), F.md5(F.col("conversations")[2]["value"]).alias("gpt_md5"))


@query("p18_passthrough", """SELECT doc_id, coalesce(CASE WHEN source = 'src0' THEN md5(text) ELSE md5(upper(lang)) END, '') AS clean_md5,
  CASE WHEN source = 'src0' THEN 0 ELSE 1 END AS keywords FROM documents""")
def p18(spark, sf_dir):
    phenomena = F.array(F.when(F.col("source") == "src0", "clean").otherwise("filler"))
    through = F.exists(phenomena, lambda p: p.isin("clean", "passthrough"))
    return table(spark, sf_dir, "documents").select(
        "doc_id", F.coalesce(F.when(through, F.md5("text")).otherwise(F.md5(F.upper("lang"))), F.lit("")).alias("clean_md5"),
        F.when(through, 0).otherwise(1).alias("keywords"),
    )


@query("t01_take_per_scene", f"""WITH {SQL_RECORDS}, r(scene, ratio) AS (VALUES {RATIO_ROWS}), n AS (
  SELECT records.id, records.scene, row_number() OVER (PARTITION BY records.scene ORDER BY pos) AS n, greatest(1, trunc({TOTAL} * coalesce(ratio, 0.05))) AS target
  FROM records LEFT JOIN r ON r.scene = records.scene) SELECT id, scene, target::INT AS target FROM n WHERE n <= target""")
def t01(spark, sf_dir):
    return ops.take_per_scene(records(spark, sf_dir), TOTAL).select("id", "scene", "target")


SQL_QC = f"""{SQL_RECORDS}, r(scene, ratio) AS (VALUES {RATIO_ROWS}), t AS (
  SELECT records.*, greatest(1, trunc({TOTAL} * coalesce(ratio, 0.05))) AS target FROM records LEFT JOIN r ON r.scene = records.scene
), b AS (
  SELECT *, row_number() OVER w AS n, coalesce(sum(passed::INT) OVER (PARTITION BY scene ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS pb
  FROM t WINDOW w AS (PARTITION BY scene ORDER BY pos)
), l AS (SELECT *, max(n) FILTER (WHERE pb < target) OVER (PARTITION BY scene) AS last FROM b),
qc AS (SELECT id, scene, language, is_fragment, CASE WHEN pb < target THEN CASE WHEN passed THEN 'passed' ELSE 'rejected' END WHEN n <= ceil(last / 40.0) * 40 THEN 'checked' ELSE 'unseen' END AS outcome FROM l)"""


def _qc(spark, sf_dir):
    return ops.qc_until_target(ops.targets(records(spark, sf_dir), TOTAL))


@query("t02_qc_until_target", f"WITH {SQL_QC} SELECT id, scene, outcome FROM qc")
def t02(spark, sf_dir):
    return _qc(spark, sf_dir).select("id", "scene", "outcome")


@query("w04_qc_counts", f"""WITH {SQL_QC} SELECT scene, count(*) FILTER (WHERE outcome = 'passed') AS passed,
  count(*) FILTER (WHERE outcome = 'rejected') AS rejected, count(*) FILTER (WHERE outcome <> 'unseen') AS checked FROM qc GROUP BY scene""")
def w04(spark, sf_dir):
    is_ = lambda o: F.count_if(F.col("outcome") == o)
    return _qc(spark, sf_dir).groupBy("scene").agg(
        is_("passed").alias("passed"), is_("rejected").alias("rejected"), F.count_if(F.col("outcome") != "unseen").alias("checked")
    )


@query("finalize_documents", f"""WITH {SQL_QC}, f AS (SELECT * FROM qc WHERE outcome = 'passed'), n AS (SELECT count(*) AS total FROM f),
r2(scene, target) AS (VALUES {RATIO_ROWS})
SELECT r2.scene, r2.target, (SELECT count(*) FROM f WHERE f.scene = r2.scene) AS records,
  round(coalesce((SELECT count(*) FROM f WHERE f.scene = r2.scene) / nullif(n.total, 0)::DOUBLE, 0), 6) AS actual,
  n.total > 0 AND abs(coalesce((SELECT count(*) FROM f WHERE f.scene = r2.scene) / nullif(n.total, 0)::DOUBLE, 0) - r2.target) > 0.05 AS warned
FROM r2, n""")
def finalize_documents(spark, sf_dir):
    """Rule and label QC until each scene's target, then counts and drift by scene."""
    kept = _qc(spark, sf_dir).where("outcome = 'passed'")
    counts = kept.groupBy("scene").agg(F.count("*").alias("records"))
    return ops.drift(kept).join(counts, "scene", "left").select(
        "scene", "target", F.coalesce("records", F.lit(0)).alias("records"), F.round("actual", 6).alias("actual"), "warned"
    )


@query("t03_stratified_split", f"""WITH {SQL_RECORDS}, s AS (SELECT id, scene, CASE WHEN length(input) <= 20 THEN 'short' WHEN length(input) <= 50 THEN 'medium'
  WHEN length(input) <= 100 THEN 'long' ELSE 'very_long' END AS bucket FROM records), n AS (
  SELECT id, scene, bucket, count(*) OVER (PARTITION BY scene, bucket) AS size, row_number() OVER (PARTITION BY scene, bucket ORDER BY md5(concat_ws('|', '42', id)), id) AS k FROM s)
SELECT id, bucket, CASE WHEN k <= CASE WHEN size >= 5 AND trunc(size * 0.15::DOUBLE) = 0 THEN 1 ELSE trunc(size * 0.15::DOUBLE) END THEN 'val' ELSE 'train' END AS split FROM n""")
def t03(spark, sf_dir):
    return ops.stratified_split(records(spark, sf_dir)).select("id", "bucket", "split")


@query("t04_random_split", """SELECT id, CASE WHEN k <= trunc(n * 0.15::DOUBLE) THEN 'val' ELSE 'train' END AS split FROM (
  SELECT doc_id AS id, row_number() OVER (ORDER BY md5(concat_ws('|', '42', doc_id)), doc_id) AS k, count(*) OVER () AS n FROM documents)""")
def t04(spark, sf_dir):
    return ops.random_split(records(spark, sf_dir).select("id")).select("id", "split")


@query("t05_length_buckets", """SELECT CASE WHEN length(text) <= 20 THEN 'short' WHEN length(text) <= 50 THEN 'medium' WHEN length(text) <= 100 THEN 'long' ELSE 'very_long' END AS bucket,
  count(*) AS documents FROM documents GROUP BY 1""")
def t05(spark, sf_dir):
    return table(spark, sf_dir, "documents").groupBy(tx.length_bucket(F.col("text")).alias("bucket")).agg(F.count("*").alias("documents"))


SQL_UNIT = lambda *p: f"(('0x' || substr(md5(concat_ws('|', {', '.join(p)})), 1, 8))::BIGINT / 4294967296.0::DOUBLE)"


@query("t07_controls", f"""SELECT doc_id AS id, p AS passthrough,
  CASE WHEN NOT p THEN (['none','light','medium','heavy'])[(floor({SQL_UNIT("'7'", "'correction'", "doc_id")} * 4) + 1)::INT] END AS correction,
  CASE WHEN NOT p THEN (['light','medium','heavy'])[(floor({SQL_UNIT("'7'", "'oral'", "doc_id")} * 3) + 1)::INT] END AS oral
FROM (SELECT doc_id, {SQL_UNIT("'7'", "'passthrough'", "doc_id")} < 0.08 AS p FROM documents)""")
def t07(spark, sf_dir):
    return ops.controls(records(spark, sf_dir).select("id"), 7)


@query("t08_asr_selection", f"""SELECT mode AS asr_mode, count(*) AS documents FROM (SELECT CASE WHEN {SQL_UNIT("'7'", "'passthrough'", "doc_id")} < 0.08 THEN 'passthrough'
  WHEN {SQL_UNIT("'7'", "'asr'", "doc_id")} < 0.2 THEN 'text_sim' ELSE 'none' END AS mode FROM documents) GROUP BY 1""")
def t08(spark, sf_dir):
    drawn = ops.select_for_asr(ops.controls(records(spark, sf_dir).select("id"), 7), 7)
    return drawn.groupBy("asr_mode").agg(F.count("*").alias("documents"))


@query("t10_rounds", "SELECT source, greatest(1, ceil(count(*) / 100.0))::INT AS rounds FROM documents GROUP BY source")
def t10(spark, sf_dir):
    return table(spark, sf_dir, "documents").groupBy("source").agg(F.count("*").alias("n")).select("source", ops.rounds(F.col("n")).alias("rounds"))


@query("a05_distribution", f"""WITH {SQL_RECORDS} SELECT 'total' AS dimension, '' AS value, count(*) AS count FROM records
UNION ALL SELECT 'scene', scene, count(*) FROM records GROUP BY scene UNION ALL SELECT 'language', coalesce(language, 'unknown'), count(*) FROM records GROUP BY 2
UNION ALL SELECT 'is_fragment', CASE WHEN coalesce(is_fragment, false) THEN 'True' ELSE 'False' END, count(*) FROM records GROUP BY 2""")
def a05(spark, sf_dir):
    return ops.distribution(records(spark, sf_dir))


@query("a06_drift", f"""WITH {SQL_RECORDS}, r(scene, target) AS (VALUES {RATIO_ROWS}), c AS (SELECT scene, count(*) AS n FROM records GROUP BY scene), t AS (SELECT count(*) AS total FROM records)
SELECT r.scene, target, round(coalesce(n, 0) / total::DOUBLE, 9) AS actual, total > 0 AND abs(coalesce(n, 0) / total::DOUBLE - target) > 0.05 AS warned FROM r LEFT JOIN c USING (scene), t""")
def a06(spark, sf_dir):
    return ops.drift(records(spark, sf_dir)).withColumn("actual", F.round("actual", 9))


@query("a07_coverage", "SELECT count(*) AS total_samples, 100000::BIGINT AS target_samples, round(count(*) / 100000::DOUBLE, 9) AS coverage FROM documents")
def a07(spark, sf_dir):
    return ops.coverage(records(spark, sf_dir), 100_000).withColumn("coverage", F.round("coverage", 9))


@query("j07_scene_targets", f"""WITH r(scene, ratio) AS (VALUES {RATIO_ROWS}), s AS (SELECT DISTINCT CASE WHEN doc_id % 17 = 16 THEN 'unlisted' ELSE {sql_scene("doc_id")} END AS scene FROM documents)
SELECT s.scene, coalesce(ratio, 0.05::DOUBLE) AS ratio, trunc(100000 * coalesce(ratio, 0.05::DOUBLE))::INT AS round_target, greatest(1, trunc(600 * coalesce(ratio, 0.05::DOUBLE)))::INT AS target FROM s LEFT JOIN r USING (scene)""")
def j07(spark, sf_dir):
    scenes = records(spark, sf_dir).select(F.when(F.col("id") % 17 == 16, "unlisted").otherwise(F.col("scene")).alias("scene")).distinct()
    first = ops.targets(scenes, 100_000, least=0).withColumnRenamed("target", "round_target")
    return ops.targets(first, TOTAL).select("scene", "ratio", "round_target", "target")


@query("x06_simulate_asr", "SELECT doc_id, " + ", ".join(f"md5({sql_simulate('text', s)}) AS {s}" for s in ("light", "medium", "heavy")) + " FROM documents")
def x06(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", *[F.md5(tx.simulate_asr(F.col("text"), s)).alias(s) for s in ("light", "medium", "heavy")])


@query("x21_seed_key", f"SELECT doc_id, md5({sql_collapse('lower(text)')}) AS key_md5 FROM documents")
def x21(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(tx.seed_key(F.col("text"))).alias("key_md5"))

"""Queries of readers, writers, scene folders, seeds, generation controls and the pipeline."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quillet.operators import records as rc
from quillet.operators.entities import entity_view
from quillet.plans.base import SCENE_NAMES, SQL_RECORDS, records, scene_of, sql_scene, table
from quillet.plans.evaluation_queries import literal, sql_expected
from quillet.plans.record_queries import SQL_UNIT
from quillet.plans.transcripts import TranscriptPipeline
from quillet.registry import query
from quillet.sources import readers, writers
from quillet.sources.store import application_folder


def _folder(spark, name):
    return f"{application_folder(spark)}/{name}-{uuid.uuid4().hex}"


CONVERSATION = "conv_id long, turn long, role string, text string"


@query("s01_jsonl_round_trip", "SELECT conv_id, turn, role, md5(text) AS text_md5 FROM conversations")
def s01(spark, sf_dir):
    path = _folder(spark, "jsonl")
    writers.write_jsonl(table(spark, sf_dir, "conversations"), path)
    return readers.read_jsonl(spark, path, CONVERSATION).select("conv_id", "turn", "role", F.md5("text").alias("text_md5"))


@query("s02_jsonl_strict", "SELECT role, count(*) AS turns FROM conversations GROUP BY role")
def s02(spark, sf_dir):
    path = _folder(spark, "jsonl")
    writers.write_jsonl(table(spark, sf_dir, "conversations"), path)
    return readers.read_jsonl_strict(spark, path, CONVERSATION).groupBy("role").agg(F.count("*").alias("turns"))


def _by_scene(spark, sf_dir):
    """documents of half of the scenes as asr_sim files, all of them as clean files."""
    root = _folder(spark, "scenes")
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", scene_of(F.col("doc_id")).alias("scene"))
    even = F.col("scene").isin(*SCENE_NAMES[::2])
    rows = docs.withColumn("source_kind", F.lit("clean")).unionByName(docs.where(even).withColumn("source_kind", F.lit("asr_sim")))
    rows.write.partitionBy("scene").json(root)
    return readers.read_scenes(spark, root, "*.json", "doc_id long, lang string, source_kind string")


EVEN = ", ".join(f"'{s}'" for s in SCENE_NAMES[::2])


@query("s05_scene_listing", f"SELECT DISTINCT {sql_scene('doc_id')} AS scene FROM documents")
def s05(spark, sf_dir):
    return _by_scene(spark, sf_dir).select("scene").distinct()


@query("s06_preferred_source", f"SELECT doc_id, scene, CASE WHEN scene IN ({EVEN}) THEN 'asr_sim' ELSE 'clean' END AS source_kind FROM (SELECT doc_id, {sql_scene('doc_id')} AS scene FROM documents)")
def s06(spark, sf_dir):
    return readers.preferred_source(_by_scene(spark, sf_dir)).select("doc_id", "scene", "source_kind")


@query("s07_load_by_scene", f"SELECT doc_id, scene, row_number() OVER (ORDER BY scene, doc_id) AS place FROM (SELECT doc_id, {sql_scene('doc_id')} AS scene FROM documents)")
def s07(spark, sf_dir):
    """All scenes in order of their names; places from the scenes' counts, not one sort."""
    rows = _by_scene(spark, sf_dir).where("source_kind = 'clean'")
    counts = rows.groupBy("scene").count()  # one row a scene
    before = Window.orderBy("scene").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("scene", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("first"))
    inside = F.row_number().over(Window.partitionBy("scene").orderBy("doc_id"))
    return rows.join(F.broadcast(offsets), "scene").select("doc_id", "scene", (F.col("first") + inside).alias("place"))


SEEDS = [('["a", ["b", {"term": "c"}], "a"]', "a,b,c"), ('{"x": ["p", "q"], "y": {"name": "r"}}', "p,q,r"), ('"solo"', "solo"), ("[]", ""), ('[{"keyword": " k "}, {"entity": "e"}, 5]', "k,e"), (None, "")]


@query("s08_flat_seeds", sql_expected([r for _, r in SEEDS]))
def s08(spark, sf_dir):
    return literal(spark, sf_dir, [x for x, _ in SEEDS]).select("doc_id", F.array_join(readers.flat_seeds(F.col("x")), ",").alias("result"))


@query("t06_seed_windows", """WITH pool AS (SELECT 's' || p_size % 4 AS scene, p_brand AS seed FROM part GROUP BY ALL), n AS (SELECT scene, count(*) AS size FROM pool GROUP BY scene),
items AS (SELECT n.scene, i AS item, floor(i / floor(size / 5))::BIGINT AS epoch, (i % floor(size / 5))::BIGINT AS slot FROM n, range(8) r(i)),
sh AS (SELECT scene, epoch, seed, row_number() OVER (PARTITION BY scene, epoch ORDER BY md5(concat_ws('|', '3', epoch, seed)), seed) - 1 AS k FROM pool JOIN (SELECT DISTINCT scene, epoch FROM items) USING (scene))
SELECT items.scene, item::INT AS item, string_agg(seed, ',' ORDER BY k) AS seeds FROM items JOIN sh ON sh.scene = items.scene AND sh.epoch = items.epoch AND sh.k // 5 = slot GROUP BY ALL""")
def t06(spark, sf_dir):
    pool = table(spark, sf_dir, "part").select(F.concat(F.lit("s"), F.col("p_size") % 4).alias("scene"), F.col("p_brand").alias("seed")).distinct()
    items = pool.select("scene").distinct().withColumn("item", F.explode(F.sequence(F.lit(0), F.lit(7))))
    return rc.seed_windows(pool, items, seed=3).select("scene", "item", F.array_join("seeds", ",").alias("seeds"))


@query("t09_temperature", f"SELECT doc_id, round(0.6 + 0.3 * {SQL_UNIT(chr(39) + '5' + chr(39), chr(39) + 'temperature' + chr(39), 'doc_id')}, 9) AS temperature FROM documents")
def t09(spark, sf_dir):
    from quillet.functions.text import hash_unit

    return table(spark, sf_dir, "documents").select("doc_id", F.round(0.6 + 0.3 * hash_unit(5, "temperature", F.col("doc_id")), 9).alias("temperature"))


@query("t11_sorted_categories", "SELECT event_type, user_id, row_number() OVER (ORDER BY event_type, user_id) AS place FROM (SELECT DISTINCT event_type, user_id FROM events)")
def t11(spark, sf_dir):
    """A report in order of its keys."""
    keys = table(spark, sf_dir, "events").select("event_type", "user_id").distinct()
    counts = keys.groupBy("event_type").count()
    before = Window.orderBy("event_type").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("event_type", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("first"))
    inside = F.row_number().over(Window.partitionBy("event_type").orderBy("user_id"))
    return keys.join(F.broadcast(offsets), "event_type").select("event_type", "user_id", (F.col("first") + inside).alias("place"))


@query("t15_exclusions", "SELECT event_type, string_agg(left('user ' || user_id, 20), '、' ORDER BY user_id) AS names FROM (SELECT DISTINCT event_type, user_id FROM events QUALIFY dense_rank() OVER (PARTITION BY event_type ORDER BY user_id) <= 5) GROUP BY event_type")
def t15(spark, sf_dir):
    n = F.row_number().over(Window.partitionBy("event_type").orderBy("user_id"))
    first = table(spark, sf_dir, "events").select("event_type", "user_id").distinct().withColumn("n", n).where("n <= 5")
    named = first.groupBy("event_type").agg(F.sort_array(F.collect_list(F.struct("n", F.substring(F.concat(F.lit("user "), F.col("user_id")), 1, 20).alias("x")))).alias("l"))
    return named.select("event_type", F.array_join(F.transform("l", lambda x: x["x"]), "、").alias("names"))


@query("k05_sft_export", f"""WITH {SQL_RECORDS}, s AS (SELECT id, scene, CASE WHEN length(input) <= 20 THEN 'short' WHEN length(input) <= 50 THEN 'medium' WHEN length(input) <= 100 THEN 'long' ELSE 'very_long' END AS bucket FROM records),
n AS (SELECT id, count(*) OVER (PARTITION BY scene, bucket) AS size, row_number() OVER (PARTITION BY scene, bucket ORDER BY md5(concat_ws('|', '42', id)), id) AS k FROM s)
SELECT CASE WHEN k <= CASE WHEN size >= 5 AND trunc(size * 0.15::DOUBLE) = 0 THEN 1 ELSE trunc(size * 0.15::DOUBLE) END THEN 'val' ELSE 'train' END AS split, count(*) AS rows, 2 * count(*) AS turns FROM n GROUP BY 1""")
def k05(spark, sf_dir):
    r = records(spark, sf_dir)
    split = rc.stratified_split(r.select("id", "scene", "input")).select("id", "split")
    path = _folder(spark, "sft")
    writers.export_sft(rc.sft_rows(r).join(split, "id"), path)
    back = spark.read.schema("conversations array<struct<from:string,value:string>>, split string").option("basePath", path).json(path)
    return back.groupBy("split").agg(F.count("*").alias("rows"), F.sum(F.size("conversations")).alias("turns"))


@query("u06_transcript_pipeline", f"""WITH {SQL_RECORDS}, c AS (SELECT *, {SQL_UNIT("'7'", "'passthrough'", "id")} < 0.08 AS through FROM records)
SELECT scene, count(*) AS records, count(*) FILTER (WHERE through) AS passthrough FROM c GROUP BY scene""")
def u06(spark, sf_dir):
    """Oral, clean and simulated text of all documents, with stand-ins for the models."""
    seeds = records(spark, sf_dir).select("id", "pos", "scene", "language", F.col("input").alias("seed"))
    out = TranscriptPipeline(spark, seed=7).simulate(seeds)
    return out.groupBy("scene").agg(F.count("*").alias("records"), F.count_if(F.col("asr_mode") == "passthrough").alias("passthrough"))


PROMPTS = {"zh": ("base", "write"), "en": ("english", "write in English"), "de": ("german", None)}


@query("s09_prompts", """
SELECT doc_id, CASE lang WHEN 'en' THEN 'english' WHEN 'de' THEN 'german' ELSE 'base' END AS system,
  CASE lang WHEN 'en' THEN 'write in English' ELSE 'write' END AS user FROM documents
""")
def s09(spark, sf_dir):
    """The prompt of each document's language from a prompt file, else the Chinese one."""
    path = _folder(spark, "prompts")
    writers.write_report(spark, path, {
        "_about": "prompts by language",
        "system_prompts": {"_note": "", **{k: s for k, (s, _) in PROMPTS.items()}}, "user_template": {k: u for k, (_, u) in PROMPTS.items()},
    })
    docs = table(spark, sf_dir, "documents").select("doc_id", F.col("lang").alias("key"))
    return readers.prompt_for(readers.read_prompts(spark, path), docs).select("doc_id", "system", "user")


@query("s10_dictionary_file", """
SELECT n_nationkey + 1 AS entity_id, n_name AS canonical_text, n_regionkey::INT AS priority,
  lower(n_name) || CASE WHEN n_regionkey = 1 THEN '' ELSE ',' || r_name END AS aliases
FROM nation JOIN region ON n_regionkey = r_regionkey WHERE n_nationkey % 3 <> 0
""")
def s10(spark, sf_dir):
    """nation as a dictionary, written as one SQLite file and read back: the enabled entities with their aliases."""
    nation, region = table(spark, sf_dir, "nation"), table(spark, sf_dir, "region")
    key = (F.col("n_nationkey") + 1).cast("long")
    entities = nation.select(
        key.alias("entity_id"), F.col("n_name").alias("canonical_text"), F.lit("TERM").alias("entity_type"), F.lit("general").alias("domain"),
        F.lit("normalize").alias("normalization_policy"), F.col("n_regionkey").cast("int").alias("priority"),
        (F.col("n_nationkey") % 3 != 0).alias("enabled"), F.lit("user").alias("source"),
    )
    lower = nation.select((key * 2).alias("alias_id"), key.alias("entity_id"), F.lower("n_name").alias("alias"))
    wide = nation.where("n_regionkey <> 1").join(region, F.col("n_regionkey") == F.col("r_regionkey"))
    aliases = lower.unionByName(wide.select((key * 2 + 1).alias("alias_id"), key.alias("entity_id"), F.col("r_name").alias("alias")))
    path = _folder(spark, "dictionary")
    writers.write_dictionary(spark, path, entities, aliases)
    view = entity_view(*readers.read_dictionary(spark, path), "general")
    return view.select("entity_id", "canonical_text", "priority", F.array_join("aliases", ",").alias("aliases"))

"""The driver's tables in their domain roles, as DataFrames and as DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillet.functions.text import KEPT, REMOVABLE, dropped_punctuation, simulate_asr
from quillet.settings import SCENES

SCENE_NAMES = sorted(SCENES)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the driver. documents that come as fewer pieces than there are cores (one
    small file of one row group) are dealt out, as all work on their texts is heavy; a
    large table has more pieces than that and is read as it is."""
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    cores = spark.sparkContext.defaultParallelism
    return df.repartition(cores) if name == "documents" and df.rdd.getNumPartitions() < cores else df


def scene_of(key: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, SCENE_NAMES)), (key % len(SCENE_NAMES) + 1).cast("int"))


def sql_scene(key: str) -> str:
    names = ", ".join(f"'{n}'" for n in SCENE_NAMES)
    return f"([{names}])[({key} % {len(SCENE_NAMES)} + 1)::INT]"


SQL_SPACE = r"[\s\x0b\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"


def sql_strip(c: str) -> str:
    return rf"regexp_replace({c}, '^{SQL_SPACE}+|{SQL_SPACE}+$', '', 'g')"


def sql_collapse(c: str) -> str:
    return sql_strip(rf"regexp_replace({c}, '{SQL_SPACE}+', ' ', 'g')")


def sql_simulate(c: str, strength: str = "medium") -> str:
    marks = dropped_punctuation(strength).replace("'", "''")
    blanks = " " * len(dropped_punctuation(strength))
    return sql_collapse(f"translate({c}, '{marks}', '{blanks}')")


def records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents as pipeline records: id, pos, scene, language, input, refined_text, passed."""
    labels = table(spark, sf_dir, "labels").groupBy("doc_id").agg(F.min("quality").alias("quality"), F.max("toxic").alias("toxic"))
    docs = table(spark, sf_dir, "documents").join(labels, "doc_id", "left")
    return docs.select(
        F.col("doc_id").alias("id"), F.col("doc_id").alias("pos"), scene_of(F.col("doc_id")).alias("scene"),
        F.col("lang").alias("language"), "source", F.col("text").alias("input"), simulate_asr(F.col("text")).alias("refined_text"),
        "quality", "toxic", (F.coalesce("quality", F.lit(1)) == 1).alias("passed"),
        (F.length("text") < 200).alias("is_fragment"),
    )


SQL_RECORDS = f"""
records AS (
  SELECT d.doc_id AS id, d.doc_id AS pos, {sql_scene("d.doc_id")} AS scene, d.lang AS language, d.source, d.text AS input,
    {sql_simulate("d.text")} AS refined_text, quality, toxic, coalesce(quality, 1) = 1 AS passed, length(d.text) < 200 AS is_fragment
  FROM documents d LEFT JOIN (SELECT doc_id, min(quality) AS quality, max(toxic) AS toxic FROM labels GROUP BY doc_id) l USING (doc_id)
)
"""
assert set("".join(KEPT.values())) & set(REMOVABLE) == {"："}

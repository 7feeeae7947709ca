"""The corpus pipeline: language ID, near-dedup, decontamination, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return
the columns of documents. Every stage is written as Parquet and read back as the next
one's input. The intermediate tables of a stage are removed when the next one of the
same thread begins, by which time its result must be written.
"""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillet.llm.common import scratch, session_dir, stored, table
from quillet.llm.decontamination import contamination
from quillet.llm.language_id import UNDETERMINED, identify, learn
from quillet.llm.near_dedup import near_duplicates
from quillet.llm.packing import pack

#: Ids that stand for rows without an id of their own lie from here on, after all others.
SURROGATE = 1 << 62


def _free_name(docs: DataFrame, name: str) -> str:
    """``name``, lengthened until ``docs`` has no such column."""
    taken = {c.lower() for c in docs.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def _columns(docs: DataFrame) -> list:
    return [F.col(f"`{c}`") for c in docs.columns]


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language can be told stay: those with a text that has letters and
    byte sequences that the model knows.

    The model is learnt from the labelled documents themselves (a bounded sample). Where
    none is labelled no language is known, and all documents with letters stay. Null,
    empty and letterless texts go; repeated rows, null ids and labels, very long texts and
    further columns of any name are no exception; an empty table stays empty.
    """
    with scratch(spark):
        model = learn(docs)
    if not model.languages:
        return docs.where(F.col("text").rlike(r"\p{L}"))
    told = identify(docs.select(F.struct(*_columns(docs)).alias("_in"), "text"), model)
    told = told.where((F.col("lang_pred") != UNDETERMINED) & (F.col("score") > 0))
    return told.select(*[F.col(f"_in.`{c}`") for c in docs.columns])


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group stays: the one of the smallest id.

    Rows are told apart by doc_id and text: of rows that agree in both one stays; different
    texts under one doc_id, and texts without an id, are documents of their own that come
    after all others. Texts without words, null ones included, are like nothing and stay.
    Very long texts are compared whole; further columns may have any name; an empty table
    stays empty.
    """
    id_name = _free_name(docs, "_id")
    text_hash = F.xxhash64(F.coalesce("text", F.lit("")), F.col("text").isNull())
    with scratch(spark):
        # ids that do not stand for one row; few, so Spark finds them small enough to broadcast
        repeated = stored(
            docs.where("doc_id is not null").groupBy("doc_id").agg(F.count("*").alias("n"), F.min(text_hash).alias("first")).where("n > 1"), "repeated-ids"
        )
        rows = docs.where("doc_id is not null").join(repeated, "doc_id", "left_anti").select(*_columns(docs), F.col("doc_id").alias(id_name))
        own = F.lit(SURROGATE).bitwiseOR(F.xxhash64("doc_id", text_hash).bitwiseAND(F.lit(SURROGATE - 1)))
        kept_id = F.when(F.col("doc_id").isNotNull() & (text_hash == F.col("_first")), F.col("doc_id")).otherwise(own)
        odd = docs.join(repeated.select("doc_id", F.col("first").alias("_first")), "doc_id").select(*_columns(docs), kept_id.alias(id_name))
        odd = odd.unionByName(docs.where("doc_id is null").select(*_columns(docs), own.alias(id_name)))
        rows = rows.unionByName(odd.dropDuplicates([id_name]))
        judged = near_duplicates(rows.select(F.col(id_name).alias("doc_id"), "text"))
        dropped = stored(judged.where(~F.col("kept")).select(F.col("doc_id").alias(id_name)), "dropped")
    return rows.join(dropped, id_name, "left_anti").select(*_columns(docs))


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are not contaminated with passages of the benchmark stay.

    Null and empty texts have no words and stay; rows with a null id and repeated rows are
    judged each, very long texts whole; further columns may have any name; without documents
    or benchmark items nothing is dropped.
    """
    name = _free_name(docs, "contamination")
    with scratch(spark):
        judged = contamination(docs, table(spark, sf_dir, "benchmark"), name=name)
    return judged.where(~F.col(f"{name}.contaminated")).select(*_columns(docs))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The sequences of all documents that are left, with their token ids.

    Null and empty texts are an end token alone; repeated rows and null ids are packed
    each; very long texts make many pieces; an empty table has no sequences.
    """
    with scratch(spark):
        return pack(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("language_id", language_id),
    ("near_dedup", near_dedup),
    ("decontaminate", decontaminate),
    ("packing", packing),
]

ORACLE_SQL = None  # language models, sketching and tokenisation have no SQL form


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    folder = f"{session_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    for name, stage in STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
    return docs

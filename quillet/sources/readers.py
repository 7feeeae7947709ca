"""Readers: JSON lines, single JSON values, rubrics, seeds, scene folders and audio."""

from __future__ import annotations

import io
import sqlite3
import wave
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from quillet.operators.entities import ALIAS, ENTITY

SAMPLE_RATE = 16_000
WINDOW = 512


class MalformedInput(ValueError):
    """A line that is no JSON object, with its file."""


def exists(spark: SparkSession, path: str) -> bool:
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(where)


def read_jsonl(spark: SparkSession, path: str, schema: str | StructType) -> DataFrame:
    """Lines as rows. A missing path is an empty table, blank lines are skipped, and a
    line that is no JSON fails the job when it is read."""
    if not exists(spark, path):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def read_jsonl_strict(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Like ``read_jsonl``, but checks first and names the file and text of a bad line."""
    if not exists(spark, path):
        return spark.createDataFrame([], schema)
    lines = spark.read.text(path).withColumn("file", F.input_file_name()).where(F.trim("value") != "")
    variant = F.try_parse_json("value")
    bad = lines.where(variant.isNull() | ~F.schema_of_variant(variant).startswith("OBJECT")).limit(1).collect()
    if bad:
        raise MalformedInput(f"{bad[0]['file']}: not a JSON object: {bad[0]['value'][:80]!r}")
    return spark.read.schema(schema).json(path)


def read_json(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """A file that holds one JSON value."""
    reader = spark.read.option("multiLine", True)
    return (reader.schema(schema) if schema else reader).json(path)


def read_rubric(spark: SparkSession, path: str) -> DataFrame:
    """Items of a rubric ``{"items": [...]}``: sample_id, status, qa and the texts."""
    item = "source_record_id string, status string, audio string, scene string, oral string, clean string, qa variant"
    items = read_json(spark, path, f"items array<struct<{', '.join(x.replace(' ', ':', 1) for x in item.split(', '))}>>")
    return items.select(F.explode("items").alias("i")).select(
        F.col("i.source_record_id").alias("sample_id"), "i.status", "i.audio", "i.scene", "i.oral", "i.clean", F.to_json("i.qa").alias("qa")
    )


def read_scenes(spark: SparkSession, root: str, name: str, schema: str) -> DataFrame:
    """``root/scene=<scene>/<name>`` of all scenes, with the scene as a column."""
    if not exists(spark, root):
        return spark.createDataFrame([], f"{schema}, scene string")
    return spark.read.schema(schema).option("basePath", root).option("pathGlobFilter", name).json(root)


def preferred_source(rows: DataFrame, order: tuple[str, ...] = ("asr_sim", "clean")) -> DataFrame:
    """Rows of each scene's best source: the first of ``order`` that the scene has."""
    rank = F.lit(len(order))
    for i, name in reversed(list(enumerate(order))):
        rank = F.when(F.col("source_kind") == name, i).otherwise(rank)
    ranked = rows.withColumn("_rank", rank)
    best = ranked.groupBy("scene").agg(F.min("_rank").alias("_best"))
    return ranked.join(F.broadcast(best), "scene").where((F.col("_rank") == F.col("_best")) & (F.col("_rank") < len(order))).drop("_rank", "_best")


def flat_seeds(value: Column) -> Column:
    """Seed strings of a JSON value: lists are flattened at any depth, objects give their
    term, name, keyword or entity; the first of equals stays."""

    @F.pandas_udf("array<string>")
    def flatten(texts: pd.Series) -> pd.Series:
        import json

        def walk(v) -> Iterator[str]:
            if isinstance(v, str):
                if v.strip():
                    yield v.strip()
            elif isinstance(v, list):
                for x in v:
                    yield from walk(x)
            elif isinstance(v, dict):
                named = next((v[k] for k in ("term", "name", "keyword", "entity") if isinstance(v.get(k), str) and v[k].strip()), None)
                if named:
                    yield named.strip()
                else:
                    for x in v.values():
                        yield from walk(x)

        return texts.map(lambda t: [] if t is None else list(dict.fromkeys(walk(json.loads(t)))))

    return flatten(value)


def wav_windows(spark: SparkSession, path: str, tail_s: float = 1.0) -> DataFrame:
    """(file, seq, seconds, rms, samples) of 16 kHz mono windows of WAV files: channels
    averaged, resampled linearly, the last window padded, a silent tail added."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for file, raw in zip(batch["path"], batch["content"]):
                with wave.open(io.BytesIO(raw)) as w:
                    data = np.frombuffer(w.readframes(w.getnframes()), dtype={1: np.uint8, 2: np.int16, 4: np.int32}[w.getsampwidth()]).astype(np.float32)
                    data = (data - 128) / 128 if w.getsampwidth() == 1 else data / float(1 << (8 * w.getsampwidth() - 1))
                    mono, rate = data.reshape(-1, w.getnchannels()).mean(axis=1), w.getframerate()
                if rate != SAMPLE_RATE and len(mono):
                    at = np.linspace(0, len(mono) - 1, round(len(mono) * SAMPLE_RATE / rate))
                    mono = np.interp(at, np.arange(len(mono)), mono).astype(np.float32)
                full = np.concatenate([mono, np.zeros(int(tail_s * SAMPLE_RATE), np.float32)])
                full = np.concatenate([full, np.zeros(-len(full) % WINDOW, np.float32)]).reshape(-1, WINDOW)
                yield pd.DataFrame({
                    "file": file, "seq": np.arange(len(full)), "seconds": WINDOW / SAMPLE_RATE,
                    "rms": np.sqrt((full**2).mean(axis=1)).astype(float), "samples": list(full),
                })

    files = spark.read.format("binaryFile").load(path).select("path", "content")
    return files.mapInPandas(run, "file string, seq long, seconds double, rms double, samples array<float>")


def pcm_samples(raw: Column) -> Column:
    """32-bit float samples of binary PCM; a length that is no multiple of 4 fails."""

    @F.pandas_udf("array<float>")
    def decode(chunks: pd.Series) -> pd.Series:
        def one(b):
            if b is not None and len(b) % 4:
                raise MalformedInput("PCM data must be a multiple of 4 bytes")
            return None if b is None else np.frombuffer(b, dtype="<f4")

        return chunks.map(one)

    return decode(raw)


#: The tables of a dictionary file and their columns.
DICTIONARY_TABLES = {
    "entities": ("protected_entities", "id, canonical_text, entity_type, domain, normalization_policy, priority, enabled, source"),
    "aliases": ("entity_aliases", "id, entity_id, alias"),
}
FETCH_ROWS = 4096


def read_dictionary(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Entities and aliases of SQLite dictionary files, as ``EntityStore`` holds them.

    Each file is opened in the task that reads it and handed on in blocks of rows. A file
    without the tables fails the job; an empty table has no rows.
    """
    files = spark.read.format("binaryFile").load(path).select("content")

    def rows_of(kind: str, schema: str) -> DataFrame:
        name, columns = DICTIONARY_TABLES[kind]
        names = [c.split()[0] for c in schema.split(", ")]

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for batch in batches:
                for content in batch["content"]:
                    data = bytearray(content)
                    data[18:20] = b"\x01\x01"  # a copy in memory has no write-ahead log
                    db = sqlite3.connect(":memory:")
                    db.deserialize(bytes(data))
                    found = db.execute(f"SELECT {columns} FROM {name}")
                    while block := found.fetchmany(FETCH_ROWS):
                        frame = pd.DataFrame(block, columns=names)
                        if "enabled" in names:
                            frame["enabled"] = frame["enabled"].astype(bool)
                        yield frame
                    db.close()

        return files.mapInPandas(run, schema)

    return rows_of("entities", ENTITY), rows_of("aliases", ALIAS)


def read_prompts(spark: SparkSession, path: str, section: str | None = None) -> DataFrame:
    """(key, system, user) of a prompt file, without keys that begin with an underscore.

    With ``section`` the file maps it to {key: {system, user_template}}; without, the file
    has the maps system_prompts and user_template, each by key. What a key lacks is null.
    """
    shown = ~F.col("key").startswith("_")
    if section is not None:
        config = read_json(spark, path, f"`{section}` map<string,variant>")
        part = lambda name: F.try_variant_get("value", f"$.{name}", "string")
        return config.select(F.explode(section)).where(shown).select("key", part("system").alias("system"), part("user_template").alias("user"))
    config = read_json(spark, path, "system_prompts map<string,string>, user_template map<string,string>")
    keys = F.array_union(*[F.coalesce(F.map_keys(c), F.array().cast("array<string>")) for c in ("system_prompts", "user_template")])
    rows = config.select("system_prompts", "user_template", F.explode(keys).alias("key")).where(shown)
    return rows.select("key", F.try_element_at("system_prompts", "key").alias("system"), F.try_element_at("user_template", "key").alias("user"))


def prompt_for(prompts: DataFrame, wanted: DataFrame, fallback: str = "zh") -> DataFrame:
    """``wanted``, which has a column key, with the system and user prompt of its key, each
    else that of ``fallback``, else an empty text."""
    spare = prompts.where(F.col("key") == fallback).agg(F.first("system").alias("_system"), F.first("user").alias("_user"))
    # one row of fallback texts, as an aggregate without keys gives
    joined = wanted.join(prompts, "key", "left").join(F.broadcast(spare), F.lit(True), "left")
    return joined.select(
        *wanted.columns,
        F.coalesce("system", "_system", F.lit("")).alias("system"), F.coalesce("user", "_user", F.lit("")).alias("user"),
    )


def visible_config(values: dict) -> dict:
    """A configuration without the keys that begin with an underscore, at any depth."""
    return {k: visible_config(v) if isinstance(v, dict) else v for k, v in values.items() if not k.startswith("_")}

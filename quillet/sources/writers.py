"""Writers: JSON lines, small JSON reports, fine-tuning files, logs and resets."""

from __future__ import annotations

import json
import sqlite3
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from quillet.sources.readers import DICTIONARY_TABLES


def _fs(spark: SparkSession, path: str):
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where, where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def write_jsonl(df: DataFrame, path: str, append: bool = False) -> None:
    df.write.mode("append" if append else "overwrite").json(path)


def append_log(df: DataFrame, path: str) -> None:
    """One committed batch of an append-only log."""
    df.write.mode("append").json(path)


def write_report(spark: SparkSession, path: str, report: dict) -> None:
    """A small JSON value in one file, replaced as a whole: written aside, then renamed."""
    where, fs = _fs(spark, path)
    files, gateway = spark.sparkContext._jvm.org.apache.hadoop.fs, spark.sparkContext._gateway
    aside = files.Path(f"{path}.{uuid.uuid4().hex}.tmp")
    stream = fs.create(aside, True)
    stream.write(bytearray((json.dumps(report, ensure_ascii=False, indent=2) + "\n").encode()))
    stream.close()
    kind = getattr(files, "Options$Rename")
    how = gateway.new_array(kind, 1)
    how[0] = kind.OVERWRITE  # the old report stands until the new one takes its place
    files.FileContext.getFileContext(where.toUri(), spark.sparkContext._jsc.hadoopConfiguration()).rename(aside, where, how)


def report_rows(df: DataFrame, most: int = 10_000) -> list[dict]:
    """The rows of a small aggregate for a report; more than ``most`` raise."""
    rows = df.limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"a report holds at most {most} rows")
    return [r.asDict(recursive=True) for r in rows]


def write_dictionary(spark: SparkSession, path: str, entities: DataFrame, aliases: DataFrame, most: int = 100_000) -> None:
    """Both tables of a dictionary as one new SQLite file; more than ``most`` rows raise."""
    db = sqlite3.connect(":memory:")
    for df, (name, columns) in ((entities, DICTIONARY_TABLES["entities"]), (aliases, DICTIONARY_TABLES["aliases"])):
        db.execute(f"CREATE TABLE {name} ({columns})")
        rows = [tuple(r.values()) for r in report_rows(df, most)]
        db.executemany(f"INSERT INTO {name} VALUES ({', '.join('?' * len(df.columns))})", rows)
    db.commit()
    where, fs = _fs(spark, path)
    stream = fs.create(where, False)
    stream.write(bytearray(db.serialize()))
    stream.close()
    db.close()


def export_sft(split: DataFrame, path: str) -> None:
    """``split`` (conversations, split) as JSON lines, one folder for train and val."""
    split.select("split", "conversations").write.mode("overwrite").partitionBy("split").json(path)


def stream_log(updates: DataFrame, path: str, checkpoint: str):
    """A streaming query that appends updates to a log folder."""
    return updates.writeStream.format("json").option("path", path).option("checkpointLocation", checkpoint).outputMode("append")


def stream_emit(updates: DataFrame, send: Callable[[DataFrame, int], None], checkpoint: str):
    """A streaming query that hands each micro-batch to ``send``."""
    return updates.writeStream.foreachBatch(send).option("checkpointLocation", checkpoint).outputMode("append")


DERIVED = ("oral", "asr_sim", "processed", "train", "stats", "rejects")


def reset_derived(spark: SparkSession, root: str, dry_run: bool = False) -> list[str]:
    """Remove what can be made again under ``root``; clean records and seeds stay."""
    gone = []
    for name in DERIVED:
        where, fs = _fs(spark, f"{root}/{name}")
        if fs.exists(where):
            gone.append(f"{root}/{name}")
            if not dry_run:
                fs.delete(where, True)
    return gone

"""External calls that are made once: answers are kept by the content of their requests.

What the cache has is taken out by an anti-join before any call. Requests that are left are
dealt out by their keys and called in order, in chunks; each chunk's answers are kept in a
file of their own as soon as they are there, under a name that its keys give. So a run that
stops half-way has kept what it has called, and neither a task that is tried again nor the
next run calls it anew.
"""

from __future__ import annotations

import hashlib
import json
import time
import uuid
from collections.abc import Callable, Iterator

import pandas as pd
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillet.sources.store import shared_table

CHUNK = 64
ANSWERS = "key string, answer string"


def read_answers(spark: SparkSession, path: str) -> DataFrame:
    """(key, answer) of all chunks that are kept under ``path``, each key once."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    if not where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(where):
        return spark.createDataFrame([], ANSWERS)
    return spark.read.schema(ANSWERS).json(path).groupBy("key").agg(F.min("answer").alias("answer"))


def _kept(path: str, name: str) -> list[dict] | None:
    files, base = fs.FileSystem.from_uri(path)
    if files.get_file_info(f"{base}/{name}").type != fs.FileType.File:
        return None
    with files.open_input_stream(f"{base}/{name}") as stream:
        return [json.loads(line) for line in stream.read().splitlines()]


def _keep(path: str, name: str, rows: list[dict]) -> None:
    files, base = fs.FileSystem.from_uri(path)
    files.create_dir(base, recursive=True)
    aside = f"{base}/.{uuid.uuid4().hex}"
    with files.open_output_stream(aside) as out:
        out.write("".join(json.dumps(r, ensure_ascii=False) + "\n" for r in rows).encode())
    files.move(aside, f"{base}/{name}")


def answered(rows: DataFrame, request: str, path: str, make: Callable[[], Callable[[str], str]], name: str = "", attempts: int = 3, pause_s: float = 1.0, chunk: int = CHUNK) -> DataFrame:
    """``rows`` with answer and error for the text in the column ``request``.

    ``path`` is the cache's folder, shared by all executors; ``name`` stands for the model
    and its version and is part of the key. Each distinct request that the cache lacks is
    called once; a call that fails is tried ``attempts`` times with doubled pauses, its
    error is told and nothing is kept, so the next run tries it again. A null request has
    neither answer nor error; repeated rows share one call.
    """
    spark = rows.sparkSession
    keyed = rows.withColumn("_key", F.sha2(F.concat(F.lit(f"{name}\n"), F.col(request)), 256))
    known = read_answers(spark, path)
    missing = keyed.where(F.col("_key").isNotNull()).groupBy(F.col("_key").alias("key")).agg(F.min(request).alias("request")).join(known, "key", "left_anti")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        call = make()

        def ask(text: str) -> tuple[str | None, str | None]:
            for k in range(attempts):
                try:
                    return call(text), None
                except Exception as e:  # an external service may fail in any way
                    error = f"{type(e).__name__}: {e}"
                    if k + 1 < attempts:
                        time.sleep(pause_s * 2**k)
            return None, error

        for batch in batches:
            for at in range(0, len(batch), chunk):
                part = batch.iloc[at : at + chunk]
                file = f"{hashlib.sha256(''.join(part['key']).encode()).hexdigest()[:32]}.jsonl"
                kept, failed = _kept(path, file), {}
                if kept is None:
                    got = {k: ask(t) for k, t in zip(part["key"], part["request"])}
                    failed = {k: e for k, (_, e) in got.items() if e is not None}
                    kept = [{"key": k, "answer": a} for k, (a, e) in got.items() if e is None]
                    # a chunk with failures gets another name than the whole one, which stays to be called
                    _keep(path, f"part-{file}" if failed else file, kept)
                out = pd.DataFrame({"key": part["key"], "answer": part["key"].map({r["key"]: r["answer"] for r in kept})})
                yield out.assign(error=part["key"].map(failed)).astype(object).where(lambda x: x.notna(), None)

    # an order by key, so that a task that is tried again makes the same chunks
    dealt = missing.repartition("key").sortWithinPartitions("key")
    fresh = shared_table(dealt.mapInPandas(run, f"{ANSWERS}, error string"), "answers")
    # what was known before this run, without what it has added meanwhile
    old = known.join(fresh, "key", "left_anti").withColumn("error", F.lit(None).cast("string"))
    answers = old.unionByName(fresh).withColumnRenamed("key", "_key")
    return keyed.join(answers, "_key", "left").drop("_key")

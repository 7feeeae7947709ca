"""Shared pieces of the training-data operators: the shared work folder, stored
intermediate tables, and vectorised word and shingle fingerprints."""

from __future__ import annotations

import os
import tempfile
import threading
import uuid
from contextlib import contextmanager

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

BATCH_ROWS = 1000
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = "abcdefghijklmnopqrstuvwxyz"


def work_dir(spark: SparkSession) -> str:
    """Shared folder for intermediate tables: ``spark.checkpoint.dir`` of the session.

    Only a local master may fall back to a folder of its own (tests, notebooks); on a
    cluster a missing setting is an error, as executors would not share the folder.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = tempfile.mkdtemp(prefix="quillet-")
        spark.sparkContext.setCheckpointDir(base)
        spark.conf.set("spark.checkpoint.dir", base)
    return base.rstrip("/")


class _Place(threading.local):
    """Folders of this thread: what ``stored`` writes to, and the scratch folder left last."""

    def __init__(self):
        self.folders: list[str] = []
        self.left: str | None = None


_place = _Place()


def _hadoop_path(spark: SparkSession, path: str):
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where, where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def delete_folder(spark: SparkSession, path: str) -> None:
    where, files = _hadoop_path(spark, path)
    files.delete(where, True)


def session_dir(spark: SparkSession) -> str:
    """Folder of this application in the shared folder; it is removed when its driver ends."""
    path = f"{work_dir(spark)}/quillet-{spark.sparkContext.applicationId}"
    where, files = _hadoop_path(spark, path)
    if not files.exists(where):
        files.mkdirs(where)
        files.deleteOnExit(where)
    return path


def stored(df: DataFrame, name: str, partitions: list[str] | None = None, batch_rows: int = BATCH_ROWS) -> DataFrame:
    """Write ``df`` to a new table in the shared folder and return a reader of it.

    This cuts the lineage: a lost executor costs its running tasks only.
    """
    spark = df.sparkSession
    path = f"{_place.folders[-1] if _place.folders else session_dir(spark)}/{name}-{uuid.uuid4().hex}"
    writer = df.write.option("compression", "zstd")
    if partitions:
        writer = writer.partitionBy(*partitions)
    with small_batches(spark, batch_rows):
        writer.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


@contextmanager
def small_batches(spark: SparkSession, rows: int = BATCH_ROWS):
    """Arrow batches of fewer rows for what runs in this context: whole texts are long,
    and a batch is held several times over, in the JVM and in Python."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, str(rows))
    try:
        yield
    finally:
        spark.conf.set(key, before)


@contextmanager
def scratch(spark: SparkSession):
    """Within this context ``stored`` writes to a new folder; the folder that the last such
    context of this thread has left is deleted first. For steps whose results are written
    before the next one begins. Runs of other threads and applications have folders of
    their own, and what is left goes with the application's folder."""
    if _place.left:
        delete_folder(spark, _place.left)
    _place.left = f"{session_dir(spark)}/scratch-{uuid.uuid4().hex}"
    _place.folders.append(_place.left)
    try:
        yield
    finally:
        _place.folders.pop()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z and nothing else. Pure ASCII takes the fast built-in path."""
    return F.when(F.octet_length(text) == F.length(text), F.lower(text)).otherwise(
        F.translate(text, UPPER, LOWER)
    )


# --- vectorised fingerprints -------------------------------------------------------

_BASE = 0x9E3779B97F4A7C15  # odd, so it has an inverse modulo 2**64
_INVERSE = pow(_BASE, -1, 2**64)
_SLAB = 1 << 21
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_powers: dict[str, np.ndarray] = {}


def mix64(x: np.ndarray) -> np.ndarray:
    """Bijective 64-bit finaliser; works in place on a uint64 array."""
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def _power_table(n: int) -> tuple[np.ndarray, np.ndarray]:
    have = _powers.get("up")
    if have is None or len(have) < n:
        size = max(n, _SLAB)
        for key, base in (("up", _BASE), ("down", _INVERSE)):
            arr = np.full(size, base, dtype=np.uint64)
            arr[0] = 1
            _powers[key] = np.cumprod(arr, dtype=np.uint64)
    return _powers["up"][:n], _powers["down"][:n]


def word_fingerprints(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """64-bit fingerprints of the words ``[^\\x20\\x09-\\x0D]+`` of each text, in order,
    with the number of words of each text. A-Z must already be lower-case.

    Polynomial prefix sums give every word's value without a Python object per word.
    """
    buffer = np.frombuffer(b"\n".join(texts) + b"\n", dtype=np.uint8)
    n = len(buffer)
    space = _SPACE[buffer]
    before = np.empty(n, dtype=bool)
    before[0] = True
    before[1:] = space[:-1]
    starts = np.flatnonzero(~space & before)
    ends = np.flatnonzero(space & ~before)
    up, down = _power_table(n + 1)
    prefix = np.zeros(n + 1, dtype=np.uint64)
    np.cumsum((buffer.astype(np.uint64) + np.uint64(1)) * up[:n], out=prefix[1:])
    words = prefix[ends] - prefix[starts]
    words *= down[starts]
    words += (ends - starts).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)
    mix64(words)
    lengths = np.fromiter(map(len, texts), dtype=np.int64, count=len(texts)) + 1
    counts = np.diff(np.searchsorted(starts, np.concatenate(([0], np.cumsum(lengths)))))
    return words, counts


_SHINGLE = [np.uint64(x) for x in (0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3, 0x589965CC75374CC3, 0x1D8E4E27C47D124F)]


def shingle_sets(texts: list[bytes], width: int = 5) -> list[np.ndarray]:
    """Sorted distinct fingerprints of each text's word shingles.

    Fewer words than ``width`` make one shingle of the whole sequence; no words, none.
    """
    words, counts = word_fingerprints(texts)
    ends = np.cumsum(counts)
    if len(words) >= width:
        m = len(words) - width + 1
        rolled = words[:m] * _SHINGLE[0]
        for k in range(1, width):
            rolled += words[k : k + m] * (_SHINGLE[k % 5] + np.uint64(2 * (k // 5)))
        mix64(rolled)
    out = []
    for end, count in zip(ends.tolist(), counts.tolist()):
        if count >= width:
            out.append(np.unique(rolled[end - count : end - width + 1]))
        elif count:
            value = np.full(1, 0xC2B2AE3D27D4EB4F + count, dtype=np.uint64)
            for k in range(count):
                value += words[end - count + k : end - count + k + 1] * (_SHINGLE[k % 5] + np.uint64(2 * (k // 5) + 1))
            out.append(mix64(value))
        else:
            out.append(np.empty(0, dtype=np.uint64))
    return out


def lowered(text: str | None) -> bytes:
    return b"" if text is None else text.encode().lower()


def slabs(texts: list[bytes], limit: int = _SLAB):
    """Ranges of neighbouring texts of about ``limit`` bytes together."""
    start, size = 0, 0
    for i, text in enumerate(texts):
        if size and size + len(text) + 1 > limit:
            yield start, i
            start, size = i, 0
        size += len(text) + 1
    if start < len(texts):
        yield start, len(texts)


def shuffle_partitions(spark: SparkSession) -> int:
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)


def environment_threads() -> None:
    """One thread in each Python worker: Spark already runs one worker a core."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"

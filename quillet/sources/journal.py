"""Stream sink with commits: each task writes a file of its own, and a batch is a manifest
that names the files; only files of a manifest are ever read.

A failed task leaves no manifest and so no half batch. A batch that is run again finds its
manifest and adds nothing. Manifests are written aside and renamed; on a local disk files
are flushed to it before their manifest is.

With ``send`` rows are handed to a function of that name first, each within ``timeout_s``.
Rows that can't be sent are kept with sent = false and mark the batch, not the query.
"""

from __future__ import annotations

import json
import os
import uuid
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor
from concurrent.futures import TimeoutError as Late
from dataclasses import dataclass
from importlib import import_module

from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceStreamWriter, WriterCommitMessage
from pyspark.sql.types import StructType


@dataclass
class Written(WriterCommitMessage):
    file: str
    rows: int
    unsent: int


def _durable(files: fs.FileSystem, path: str, data: bytes) -> None:
    if isinstance(files, fs.LocalFileSystem):
        with open(path, "wb") as out:
            out.write(data)
            out.flush()
            os.fsync(out.fileno())
    else:
        with files.open_output_stream(path) as out:
            out.write(data)


class JournalWriter(DataSourceStreamWriter):
    def __init__(self, path: str, query: str, send: str | None, timeout_s: float):
        self.path, self.query, self.send, self.timeout_s = path, query, send, timeout_s

    def _place(self):
        files, base = fs.FileSystem.from_uri(self.path)
        for folder in ("data", f"commits/{self.query}"):
            files.create_dir(f"{base}/{folder}", recursive=True)
        return files, base

    def _sent(self, rows: Iterator[dict]) -> Iterator[dict]:
        """Rows with whether they were sent. After one that is late the others of the task
        aren't tried: its connection is taken for closed."""
        module, _, name = self.send.partition(":")
        send, open_ = getattr(import_module(module), name), True
        pool = ThreadPoolExecutor(1)
        for row in rows:
            ok = False
            if open_:
                try:
                    ok = pool.submit(send, row).result(self.timeout_s) is not False
                except Late:
                    open_ = False
                except Exception:  # the receiver may fail in any way
                    ok = False
            yield row | {"sent": ok}
        pool.shutdown(wait=False, cancel_futures=True)

    def write(self, iterator) -> Written | None:
        rows = (r.asDict(recursive=True) for r in iterator)
        out = list(self._sent(rows) if self.send else rows)
        if not out:
            return None
        files, base = self._place()
        name = f"{uuid.uuid4().hex}.jsonl"
        _durable(files, f"{base}/data/{name}", "".join(json.dumps(r, ensure_ascii=False, default=str) + "\n" for r in out).encode())
        return Written(name, len(out), sum(not r.get("sent", True) for r in out))

    def _remove(self, messages: list[Written | None]) -> None:
        files, base = self._place()
        for m in messages:
            if m is not None:
                files.delete_file(f"{base}/data/{m.file}")

    def commit(self, messages: list[Written | None], batchId: int) -> None:
        files, base = self._place()
        manifest = f"{base}/commits/{self.query}/{batchId:020d}.json"
        if files.get_file_info(manifest).type == fs.FileType.File:
            self._remove(messages)
            return
        done = [m for m in messages if m is not None]
        report = {"batch": batchId, "files": [m.file for m in done], "rows": sum(m.rows for m in done), "unsent": sum(m.unsent for m in done)}
        aside = f"{base}/commits/{self.query}/.{uuid.uuid4().hex}"
        _durable(files, aside, json.dumps(report).encode())
        files.move(aside, manifest)

    def abort(self, messages: list[Written | None], batchId: int) -> None:
        self._remove(messages)


class JournalSink(DataSource):
    """``writeStream.format("journal")`` with path, query and perhaps send and timeout_s."""

    @classmethod
    def name(cls) -> str:
        return "journal"

    def streamWriter(self, schema: StructType, overwrite: bool) -> JournalWriter:
        if not self.options.get("path"):
            raise ValueError("journal needs the option path")
        return JournalWriter(self.options["path"], self.options.get("query", "main"), self.options.get("send"), float(self.options.get("timeout_s", 5)))


def write_journal(updates: DataFrame, path: str, checkpoint: str, query: str = "main", send: str | None = None, timeout_s: float = 5.0):
    """A streaming query (not started) that appends to the journal at ``path``.

    ``send`` names a function ``module:function`` that takes a row as a dict and returns
    False, raises or takes longer than ``timeout_s`` if it can't be sent.
    """
    updates.sparkSession.dataSource.register(JournalSink)
    writer = updates.writeStream.format("journal").option("path", path).option("query", query).option("timeout_s", timeout_s)
    if send:
        writer = writer.option("send", send)
    return writer.option("checkpointLocation", checkpoint).outputMode("append")


def journal_batches(spark: SparkSession, path: str) -> DataFrame:
    """(query, batch, files, rows, unsent): the manifests."""
    found = spark.read.schema("batch long, files array<string>, rows long, unsent long").option("recursiveFileLookup", True).json(f"{path}/commits")
    return found.selectExpr("regexp_extract(input_file_name(), 'commits/([^/]+)/', 1) as query", "*")


def read_journal(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Rows of all committed batches."""
    files = [r.f for r in journal_batches(spark, path).selectExpr("explode(files) as f").orderBy("f").collect()]
    return spark.read.schema(schema).json([f"{path}/data/{f}" for f in files]) if files else spark.createDataFrame([], schema)

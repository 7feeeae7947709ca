"""Stream source of audio chunks: a folder of numbered files, each with one JSON object per
line (session, seq, pcm in base64), as a receiving service spools them.

The offset is the number of the next file. Files count as soon as all before them are
there, so a file that comes late is waited for and never skipped; each file is one
partition, and a batch takes at most ``files_per_batch`` of them. Reading an offset range
again gives the same rows, so a restarted query neither loses nor repeats any.
"""

from __future__ import annotations

import base64
import json
from collections.abc import Iterator

from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

SCHEMA = "session string, seq long, pcm binary, error string"
FILES_PER_BATCH = 64


def file_name(number: int) -> str:
    return f"chunks-{number:012d}.jsonl"


class _File(InputPartition):
    def __init__(self, number: int):
        self.number = number


class ChunkReader(DataSourceStreamReader):
    def __init__(self, path: str, files_per_batch: int):
        self.path, self.files_per_batch = path, files_per_batch
        self.next = 0

    def _place(self):
        return fs.FileSystem.from_uri(self.path)

    def initialOffset(self) -> dict:
        return {"file": 0}

    def latestOffset(self) -> dict:
        """From where the last answer ended, over the files that are there without a gap."""
        files, base = self._place()
        end = self.next
        while end - self.next < self.files_per_batch and files.get_file_info(f"{base}/{file_name(end)}").type == fs.FileType.File:
            end += 1
        self.next = end
        return {"file": end}

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        # a restarted query begins with the range that it has planned last
        self.next = max(self.next, end["file"])
        return [_File(n) for n in range(start["file"], end["file"])]

    def read(self, partition: _File) -> Iterator[tuple]:
        files, base = self._place()
        with files.open_input_stream(f"{base}/{file_name(partition.number)}") as stream:
            for line in stream.read().splitlines():
                if line.strip():
                    chunk = json.loads(line)
                    pcm = base64.b64decode(chunk["pcm"])
                    # samples are 32-bit floats
                    error = None if len(pcm) % 4 == 0 else f"{len(pcm)} bytes are no whole samples"
                    yield chunk["session"], chunk["seq"], pcm, error

    def commit(self, end: dict) -> None:
        pass


class ChunkSource(DataSource):
    """``spark.readStream.format("pcm_chunks").option("path", folder)``."""

    @classmethod
    def name(cls) -> str:
        return "pcm_chunks"

    def schema(self) -> str:
        return SCHEMA

    def streamReader(self, schema) -> ChunkReader:
        path = self.options.get("path")
        if not path:
            raise ValueError("pcm_chunks needs the option path")
        return ChunkReader(path, int(self.options.get("files_per_batch", FILES_PER_BATCH)))


def read_chunks(spark: SparkSession, path: str, files_per_batch: int = FILES_PER_BATCH) -> DataFrame:
    """Stream of SCHEMA; ``error`` tells why a chunk can't be used."""
    spark.dataSource.register(ChunkSource)
    return spark.readStream.format("pcm_chunks").option("path", path).option("files_per_batch", files_per_batch).load()


def spool_chunks(path: str, number: int, chunks: list[tuple[str, int, bytes]]) -> None:
    """Write the file with this number; it is seen as a whole or not at all."""
    files, base = fs.FileSystem.from_uri(path)
    files.create_dir(base, recursive=True)
    lines = [json.dumps({"session": s, "seq": n, "pcm": base64.b64encode(pcm).decode()}) for s, n, pcm in chunks]
    with files.open_output_stream(f"{base}/.{file_name(number)}") as stream:
        stream.write("".join(f"{x}\n" for x in lines).encode())
    files.move(f"{base}/.{file_name(number)}", f"{base}/{file_name(number)}")

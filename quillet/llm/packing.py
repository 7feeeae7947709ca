"""Packing by power-of-two decomposition: no sequence crosses documents.

A document of L tokens is cut into floor(L / max_length) pieces of the full length and
the powers of two of the rest, largest first. Every piece is a sequence of its own, and
sequences of equal length make a bucket, so that batches of one bucket need no padding.
"""

from __future__ import annotations

from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillet.llm.common import slabs
from quillet.llm.encoding import WordCoder, cut_words

BATCH_BYTES = 4 << 20


def piece_lengths(n: int, max_length: int) -> list[int]:
    """Full pieces, then the binary digits of the rest from the largest down."""
    rest = n % max_length
    return [max_length] * (n // max_length) + [1 << k for k in range(rest.bit_length() - 1, -1, -1) if rest >> k & 1]


def pack(docs: DataFrame, tokenizer_path: str, end_id: int = 1, max_length: int = 2048) -> DataFrame:
    """One row per piece: doc_id, start, length, doc_tokens, ids, bucket, sequence_id, offset.

    ``ids`` holds the piece's token ids as little-endian unsigned 32-bit numbers;
    ``bucket`` is log2 of the length; each piece is a sequence, so ``offset`` is 0 and
    nothing is padded. ``max_length`` must be a power of two, and the tokenizer
    one of words: lower case, white space dropped. Null and empty texts are
    the end id alone: one piece of length 1. Repeated rows are packed each, as their
    own sequences; other columns are ignored; an empty table gives no rows. There is no
    shuffle: a sequence number is made of the partition's and the row's number in it.
    """
    if max_length < 1 or max_length & (max_length - 1):
        raise ValueError("max_length must be a power of two")
    end = int(end_id).to_bytes(4, "little")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = WordCoder.get(tokenizer_path)
        for batch in batches:
            texts, doc_ids = batch.column("text").to_pylist(), batch.column("doc_id").to_pylist()
            for a, b in slabs([t or "" for t in texts], BATCH_BYTES):
                of = coder.lookup()
                rows: list[tuple] = []
                for doc_id, text in zip(doc_ids[a:b], texts[a:b]):
                    raw = b"".join(map(of, cut_words(text or ""))) + end
                    n, start = len(raw) // 4, 0
                    for length in piece_lengths(n, max_length):
                        rows.append((doc_id, start, length, n, raw[4 * start : 4 * (start + length)], length.bit_length() - 1))
                        start += length
                columns = zip(*rows)
                kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.int32())
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, k) for c, k in zip(columns, kinds)],
                    ["doc_id", "start", "length", "doc_tokens", "ids", "bucket"],
                )

    pieces = docs.select("doc_id", "text").mapInArrow(
        run, "doc_id long, start long, length long, doc_tokens long, ids binary, bucket int"
    )
    return pieces.withColumn("sequence_id", F.monotonically_increasing_id()).withColumn("offset", F.lit(0).cast("long"))


def write_buckets(pieces: DataFrame, path: str) -> None:
    """Write the sequences as one folder of Parquet files for each length."""
    pieces.write.partitionBy("bucket").parquet(path)


def crc_of_ids(ids: list[int]) -> int:
    return crc32(np.array(ids, dtype="<u4").tobytes())

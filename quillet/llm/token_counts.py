"""Token counts: batch encoding in an Arrow function that returns lengths only."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from quillet.llm.common import slabs
from quillet.llm.encoding import UnitEncoder, cut

BATCH_BYTES = 4 << 20


def token_counts(docs: DataFrame, tokenizer_path: str, batch_bytes: int = BATCH_BYTES) -> DataFrame:
    """One row per document: doc_id, n_bytes (UTF-8) and n_tokens of its whole text.

    Texts are grouped into batches of about ``batch_bytes`` bytes, so that a batch of
    long texts holds fewer of them, and every text is cut at safe boundaries (see
    ``encoding``): its count is the sum over its units. Null and empty texts count 0.
    Special strings inside texts are handled as the library does by default. Repeated
    rows are counted each; other columns are ignored; an empty table gives no rows.
    The count needs no shuffle.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = UnitEncoder.get(tokenizer_path, len)
        for batch in batches:
            text = batch.column("text")
            n_bytes = pc.fill_null(pc.binary_length(text), 0).cast(pa.int64())
            counts: list[int] = []
            texts = text.to_pylist()
            sizes = n_bytes.to_pylist()
            for a, b in slabs([_Sized(n) for n in sizes], batch_bytes):
                units = [cut(t) if t else [] for t in texts[a:b]]
                of = encoder.learn(units).__getitem__
                counts += [sum(map(of, u)) for u in units]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id").cast(pa.int64()), n_bytes, pa.array(counts, pa.int64())],
                ["doc_id", "n_bytes", "n_tokens"],
            )

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n_bytes long, n_tokens long")


class _Sized:
    """Stands for a text of ``n`` bytes when batches are cut."""

    __slots__ = ("n",)

    def __init__(self, n: int):
        self.n = n

    def __len__(self) -> int:
        return self.n

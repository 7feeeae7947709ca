"""Encoding and decoding with merge-type (BPE) sentencepiece vocabularies.

A text is normalised by the library, cut where no piece of the vocabulary can reach across,
and each distinct unit is encoded once per worker: adjacent symbols that join to a piece
stand in an agenda ordered by score (ties: leftmost first), and the best pair is merged
until none is left. Symbols that are no pieces become their UTF-8 bytes' pieces.

The new units of every Arrow batch are held against the library, strung together as one
text, in both directions. Should they differ, the batch's texts are coded by the library.
"""

from __future__ import annotations

import re
from array import array
from collections.abc import Iterator
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from quillet.llm.common import slabs

SPACE = "▁"
BATCH_BYTES = 2 << 20
CACHE_UNITS = 400_000
LONG_UNIT = 128
LATIN = "A-Za-zÀ-ÖØ-öø-ɏ"
NEVER = float("inf")
CHECKED_TOGETHER = 32


class MergeCoder:
    """Encoder and decoder of one vocabulary; it outlives the tasks of its worker."""

    _of: dict[str, MergeCoder] = {}

    @classmethod
    def get(cls, path: str) -> MergeCoder:
        if path not in cls._of:
            cls._of[path] = cls(path)
        return cls._of[path]

    def __init__(self, path: str):
        from sentencepiece import SentencePieceProcessor

        self.library = sp = SentencePieceProcessor(model_file=path)
        special = lambda i: sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i)
        self.pieces = [sp.id_to_piece(i) for i in range(sp.vocab_size())]
        self.ids = {p: i for i, p in enumerate(self.pieces) if not special(i)}
        self.ranks = {p: -sp.get_score(i) for p, i in self.ids.items()}
        self.byte_ids = [sp.piece_to_id(f"<0x{b:02X}>") for b in range(256)]
        self.byte_of = {i: b for b, i in enumerate(self.byte_ids)}
        if not all(map(sp.is_byte, self.byte_ids)) or any(map(sp.is_unused, range(len(self.pieces)))):
            raise ValueError(f"{path}: only vocabularies with byte pieces and without unused pieces are supported")
        # what an id stands for in a text; byte pieces stand for nothing by themselves
        self.text_of = [None if i in self.byte_of else "" if sp.is_control(i) else p.replace(SPACE, " ") for i, p in enumerate(self.pieces)]
        self.end = sp.eos_id()
        self.units = self._cutter()
        self.known: dict[str, bytes] = {}
        self.last: dict[str, bytes] = {}
        self.checked = self.differing = 0

    def _cutter(self):
        """Cuts a normalised text where no piece of the vocabulary holds both sides: before
        each run of spaces, around line ends, and between Latin letters and other
        characters; at fewer of these places, or none, if there are such pieces."""
        plain = [p.lstrip(SPACE) for p in self.ids]
        if any(SPACE in p or ("\n" in p and len(p) > 1) for p in plain):
            return lambda text: [text] if text else []
        if any(re.search(f"[{LATIN}][^{LATIN}]|[^{LATIN}][{LATIN}]", p) for p in plain):
            return re.compile(f"{SPACE}*[^{SPACE}\n]+|{SPACE}+|\n").findall
        return re.compile(f"{SPACE}*[{LATIN}]+|{SPACE}*[^{LATIN}{SPACE}\n]+|{SPACE}+|\n").findall

    def encode_unit(self, unit: str) -> list[int]:
        """Ids of one unit by the agenda of adjacent pairs, which is a plain list of their
        ranks for short units and a heap for long ones."""
        if len(unit) > LONG_UNIT:
            return self._encode_long(unit)
        symbols, rank = list(unit), self.ranks.get
        agenda = [rank(a + b, NEVER) for a, b in zip(symbols, symbols[1:])]
        while agenda and (best := min(agenda)) != NEVER:
            at = agenda.index(best)  # the leftmost of equals
            symbols[at] += symbols.pop(at + 1)
            del agenda[at]
            if at:
                agenda[at - 1] = rank(symbols[at - 1] + symbols[at], NEVER)
            if at < len(agenda):
                agenda[at] = rank(symbols[at] + symbols[at + 1], NEVER)
        return self._emit(symbols)

    def _encode_long(self, unit: str) -> list[int]:
        symbols, rank, n = list(unit), self.ranks.get, len(unit)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        agenda = [(r, i, i + 1, both) for i in range(n - 1) if (r := rank(both := symbols[i] + symbols[i + 1])) is not None]
        heapify(agenda)
        while agenda:
            _, left, right, both = heappop(agenda)
            # a symbol that was merged away is empty, one that has grown joins to something else
            if not symbols[left] or not symbols[right] or after[left] != right or symbols[left] + symbols[right] != both:
                continue
            symbols[left], symbols[right] = both, ""
            follower, leader = after[right], before[left]
            after[left] = follower
            if follower < n:
                before[follower] = left
                if (r := rank(joined := both + symbols[follower])) is not None:
                    heappush(agenda, (r, left, follower, joined))
            if leader >= 0 and (r := rank(joined := symbols[leader] + both)) is not None:
                heappush(agenda, (r, leader, left, joined))
        return self._emit([s for s in symbols if s])

    def _emit(self, symbols: list[str]) -> list[int]:
        try:
            return [self.ids[s] for s in symbols]
        except KeyError:
            return [i for s in symbols for i in ([self.ids[s]] if s in self.ids else [self.byte_ids[b] for b in s.encode()])]

    def decode(self, ids: list[int], prefix: bool = True) -> str:
        """Text of the ids; ``prefix``: the space that normalising puts first is taken off.
        Control ids stand for nothing, runs of byte pieces for the characters they encode."""
        parts = [self.text_of[i] for i in ids]
        if None in parts:
            raw = bytearray()
            for k, (i, part) in enumerate(zip(ids, parts)):
                if part is None:
                    raw.append(self.byte_of[i])
                    parts[k] = ""
                if raw and (part is not None or k + 1 == len(ids)):
                    parts[k] = raw.decode(errors="replace") + parts[k]
                    raw.clear()
        text = "".join(parts)
        return text[1:] if prefix and text.startswith(" ") else text

    def _agrees(self, fresh: dict[str, bytes]) -> bool:
        """Whether the library codes the units, strung together, in the same way, and every
        unit decodes to what it says. Where two of them would not be cut apart, a line end
        stands between them."""
        known = fresh | {u: array("i", self.encode_unit(u)).tobytes() for u in (SPACE, "\n")}
        strings = []
        for n, u in enumerate(fresh):
            if n % CHECKED_TOGETHER == 0:
                strings.append([SPACE, "\n"])
            strings[-1] += [u] if u[0] in (SPACE, "\n") and strings[-1][-1][-1] != SPACE else ["\n", u]
        texts = ["".join(units).replace(SPACE, " ")[1:] for units in strings]
        if list(map(self.library.normalize, texts)) != ["".join(units) for units in strings]:
            return False
        coded = self.library.encode(texts, num_threads=1)
        own = [b"".join([known[u] for u in units]) for units in strings]
        decoded = self.library.decode([[*ids, self.end] for ids in coded])
        return [array("i", ids).tobytes() for ids in coded] == own and list(map(self.decode, coded)) == texts == decoded

    def learn(self, wanted: set[str]) -> dict[str, bytes] | None:
        """Lookup from units to their ids, or None if the library codes the new ones
        otherwise. What is known decodes to the unit itself, with spaces for its marks."""
        fresh = {}
        for u in wanted:
            if (ids := self.last.get(u)) is not None:
                self.known[u] = ids
            else:
                fresh[u] = array("i", self.encode_unit(u)).tobytes()
        if not fresh:
            return self.known
        self.checked += len(fresh)
        if not self._agrees(fresh):
            self.differing += len(fresh)
            return None
        long = {u: fresh.pop(u) for u in list(fresh) if len(u) > LONG_UNIT}
        self.known |= fresh
        return self.known | long if long else self.known

    def code(self, texts: list[str]) -> tuple[list[bytes], list[str]]:
        """32-bit ids, with an end id, and the decoded text of each text."""
        end = array("i", [self.end]).tobytes()
        normal = [self.library.normalize(t) if t else "" for t in texts]
        units = list(map(self.units, normal))
        if len(self.known) > CACHE_UNITS:
            self.known, self.last = {}, self.known
        known = self.learn({u for us in units for u in us if u not in self.known})
        if known is None:
            coded = [self.library.encode(t, add_eos=True, num_threads=1) for t in texts]
            return [array("i", c).tobytes() for c in coded], [self.library.decode(c) for c in coded]
        ids = [b"".join([known[u] for u in us]) + end for us in units]
        return ids, [t.replace(SPACE, " ").removeprefix(" ") for t in normal]


def encode_documents(docs: DataFrame, model_path: str, batch_bytes: int = BATCH_BYTES) -> DataFrame:
    """One row per document: doc_id, ids (array<int>, the end id last) and decoded, the
    text that decoding these ids gives.

    Whole texts are coded, in slabs of about ``batch_bytes`` bytes; a null text counts as
    empty and has the end id alone. Repeated rows are coded each, a null doc_id is kept,
    other columns are ignored, an empty table gives no rows. There is no shuffle.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = MergeCoder.get(model_path)
        for batch in batches:
            texts = [t or "" for t in batch.column("text").to_pylist()]
            doc_ids = batch.column("doc_id").cast(pa.int64())
            for a, b in slabs(texts, batch_bytes):
                ids, decoded = coder.code(texts[a:b])
                ends = np.cumsum([0, *(len(x) // 4 for x in ids)], dtype=np.int32)
                flat = pa.array(np.frombuffer(b"".join(ids), dtype=np.int32))
                yield pa.RecordBatch.from_arrays(
                    [doc_ids[a:b], pa.ListArray.from_arrays(pa.array(ends), flat), pa.array(decoded, pa.string())],
                    ["doc_id", "ids", "decoded"],
                )

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, ids array<int>, decoded string")

"""Splitting running text: stable chunks, refinement windows and the content guard.

Plain Python on one text. As columns, windows are one regex pass over the text, chunks an
Arrow function over slices, and only texts that a refiner changed reach the guard's.
"""

from __future__ import annotations

import re
from collections import Counter

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F

from quillet.functions.metrics import matching_ratio
from quillet.functions.text import SENTENCE_END, SOFT_BREAK, strip

_END = re.compile(f"[{re.escape(SENTENCE_END)}]\\s*")
_SOFT = re.compile(f"[{re.escape(SOFT_BREAK)}]\\s*")
# Where a refinement window may end, best and second best.
WINDOW_ENDS = frozenset("。！？!?；;\n")
WINDOW_SOFT = frozenset("，、：:）)】] ")
_SENTENCE = re.compile(r"[^。！？!?；;\n]+[。！？!?；;\n]?")
_LOOP = re.compile(r"(.{8,80}?)(?:\1){2,}")
#: Texts of so many bytes are turned into Python objects at once.
SLICE_BYTES = 1_000_000


def next_cut(text: str, begin: int, limit: int, flush: bool) -> int | None:
    """End of the chunk that starts at ``begin``, or None if more text is needed.

    A sentence end within the limit closes it; longer text is cut after its last soft
    break within the limit, or at the limit; a flush takes what is left.
    """
    sentence = _END.search(text, begin)
    if sentence and sentence.end() - begin <= limit:
        return sentence.end()
    if len(text) - begin > limit:
        soft = None
        for soft in _SOFT.finditer(text, begin, begin + limit):
            pass
        return soft.end() if soft else begin + limit
    return len(text) if flush and begin < len(text) else None


def stable_chunks(text: str, limit: int = 80, flush: bool = False, begin: int = 0) -> tuple[list[str], int]:
    """Stripped non-blank chunks from ``begin`` on, and where the pending rest begins."""
    out = []
    while (cut := next_cut(text, begin, limit, flush)) is not None:
        part = text[begin:cut].strip()
        begin = cut
        if part:
            out.append(part)
    return out, begin


def refinement_windows(text: str, limit: int = 80) -> list[str]:
    """The stripped text in pieces of at most ``limit`` characters, lossless.

    A piece ends after the last sentence end of its second half, else after the last soft
    break there, else at the limit.
    """
    if limit < 32:
        raise ValueError("a refinement window needs at least 32 characters")
    text, out, begin = text.strip(), [], 0
    while len(text) - begin > limit:
        half = range(begin + limit - 1, begin + limit // 2 - 1, -1)
        cut = next((i + 1 for marks in (WINDOW_ENDS, WINDOW_SOFT) for i in half if text[i] in marks), begin + limit)
        out.append(text[begin:cut])
        begin = cut
    return [*out, text[begin:]] if begin < len(text) else out


def join_parts(parts) -> str:
    """Parts stripped and joined, with a space only between two ASCII characters."""
    out: list[str] = []
    for part in map(str.strip, parts):
        if part:
            if out and out[-1][-1].isascii() and part[0].isascii():
                out.append(" ")
            out.append(part)
    return "".join(out)


def first_loop(text: str) -> str | None:
    """The phrase of 8 to 80 characters that the text repeats three times in a row, first
    by place, then shortest; line ends are in none.

    Short texts are searched by pattern, long ones by comparing the text with itself at
    each distance, which is linear for each of the 73 lengths.
    """
    if len(text) < 400:
        found = _LOOP.search(text)
        return found[1] if found else None
    codes = np.frombuffer(text.encode("utf-32-le"), dtype=np.uint32)
    best = None
    for p in range(8, 81):
        same = (codes[:-p] == codes[p:]) & (codes[:-p] != 10)
        # ends of runs of equal places: a run of 2p means three times in a row
        breaks = np.flatnonzero(~same)
        starts = np.concatenate(([0], breaks + 1))
        lengths = np.concatenate((breaks, [len(same)])) - starts
        long = np.flatnonzero(lengths >= 2 * p)
        if len(long) and (best is None or starts[long[0]] < best[0]):
            best = (int(starts[long[0]]), p)
    return None if best is None else text[best[0] : best[0] + best[1]]


def guard_reasons(raw: str, refined: str) -> list[str]:
    """Why a refined text must not replace its source; empty if it may."""
    raw, refined = raw.strip(), refined.strip()
    if not refined:
        return ["empty_refiner_output"]
    count = lambda t: Counter(s for s in map(str.strip, _SENTENCE.findall(t)) if s)
    before, out = count(raw), []
    if any(n >= 3 and len(s) >= 8 and n > before[s] for s, n in count(refined).items()):
        out.append("repeated_sentence")
    # what is part of the source can't repeat a phrase that the source lacks
    if refined not in raw and (phrase := first_loop(refined)) and phrase not in raw:
        out.append("repeated_phrase")
    if len(raw) >= 16 and len(refined) < 0.65 * len(raw):
        if len(raw) >= 24 or matching_ratio(raw, refined) < 0.35:
            out.append("severe_content_loss")
    if len(raw) >= 100 and raw[-1] in WINDOW_ENDS and refined[-1] not in WINDOW_ENDS and len(refined) < 0.8 * len(raw):
        out.append("truncated_refiner_output")
    return out


def _one_of(marks) -> str:
    return "[" + "".join(f"\\x{{{ord(c):x}}}" for c in sorted(marks)) + "]"


def _parts(c: Column, pattern: str) -> Column:
    """The stripped text in pieces as ``pattern`` takes them one after the other."""
    return F.coalesce(F.regexp_extract_all(strip(c), F.lit(f"(?s){pattern}"), F.lit(0)), F.array().cast("array<string>"))


def chunks_column(c: Column, limit: int = 80) -> Column:
    """``stable_chunks`` of the stripped text, with a flush, as a column.

    A batch is cut in slices of bounded bytes, so what a worker holds as Python objects does
    not grow with the batch.
    """

    @F.arrow_udf("array<string>")
    def cut(texts: pa.Array) -> pa.Array:
        sizes = pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False)
        turns = (np.cumsum(sizes, dtype=np.int64) // SLICE_BYTES).tolist()
        begins = [i for i in range(len(turns)) if i == 0 or turns[i] != turns[i - 1]]
        kind, parts = pa.list_(pa.string()), []
        for begin, end in zip(begins, [*begins[1:], len(turns)]):
            part = texts.slice(begin, end - begin).to_pylist()
            parts.append(pa.array([[] if t is None else stable_chunks(t.strip(), limit, flush=True)[0] for t in part], kind))
        return pa.concat_arrays(parts) if parts else pa.array([], kind)

    return cut(c)


def windows_column(c: Column, limit: int = 80) -> Column:
    """``refinement_windows`` as a column."""
    if limit < 32:
        raise ValueError("a refinement window needs at least 32 characters")
    half = f".{{{limit // 2},{limit - 1}}}"
    return _parts(c, rf".{{1,{limit}}}+\z|{half}{_one_of(WINDOW_ENDS)}|{half}{_one_of(WINDOW_SOFT)}|.{{{limit}}}")


def guard_column(raw: Column, refined: Column) -> Column:
    """``guard_reasons`` as a column; a text that is not blank and only stripped passes."""

    @F.pandas_udf("array<string>")
    def check(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([guard_reasons(x or "", y or "") for x, y in zip(a, b)])

    kept = F.coalesce((strip(raw) == strip(refined)) & (strip(raw) != ""), F.lit(False))
    return F.when(kept, F.array().cast("array<string>")).otherwise(check(F.when(~kept, raw), F.when(~kept, refined)))

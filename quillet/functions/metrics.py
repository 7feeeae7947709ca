"""Text metrics: normalisation, token lists, edit distances and rates."""

from __future__ import annotations

import re
import unicodedata

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

WORD_TOKENS = r"[㐀-䶿一-鿿]+|[a-z0-9]+"
MIXED_TOKENS = r"[㐀-䶿一-鿿]|[a-z0-9]+"
_ASCII_BREAK = re.compile(r"[!-/:-@\[-`{-~\s]+")
METRICS = "struct<wer_errors:int,wer_units:int,cer_errors:int,cer_units:int,mer_errors:int,mer_units:int>"


class Simplifier:
    """Traditional to simplified by the longest phrase of a table that begins at a place;
    single characters are phrases of one, what no phrase covers stays as it is.

    The phrases are a trie, so a text is read once, with steps back of less than the
    longest phrase.
    """

    def __init__(self, table: dict[str, str]):
        self.root: dict = {}
        for phrase, simple in table.items():
            node = self.root
            for c in phrase:
                node = node.setdefault(c, {})
            if phrase:
                node[None] = simple

    def __call__(self, text: str) -> str:
        out, at = [], 0
        while at < len(text):
            node, end, found = self.root, at + 1, text[at]
            for place in range(at, len(text)):
                node = node.get(text[place])
                if node is None:
                    break
                if None in node:
                    end, found = place + 1, node[None]
            out.append(found)
            at = end
        return "".join(out)


def fold_text(text: str, simplify: Simplifier | None = None) -> str:
    """NFKC, traditional to simplified where a table is given, case folded; punctuation,
    symbols and separators become single spaces. ASCII texts take a short way."""
    if text.isascii():
        return " ".join(_ASCII_BREAK.sub(" ", text.lower()).split())
    wide = unicodedata.normalize("NFKC", text)
    folded = (simplify(wide) if simplify else wide).casefold()
    return " ".join("".join(" " if unicodedata.category(c)[0] in "PSZ" else c for c in folded).split())


def normalize_text(c: Column, simplify: Simplifier | None = None) -> Column:
    @F.pandas_udf("string")
    def fold(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: None if t is None else fold_text(t, simplify))

    return fold(c)


def word_tokens(normalized: Column) -> Column:
    """Runs of CJK characters are one word each, so are runs of Latin letters and digits."""
    return F.regexp_extract_all(normalized, F.lit(f"({WORD_TOKENS})"))


def mixed_tokens(normalized: Column) -> Column:
    return F.regexp_extract_all(normalized, F.lit(f"({MIXED_TOKENS})"))


def edit_distance(a, b) -> int:
    """Unit-cost edit distance of two sequences, bit-parallel in one big integer a row.

    Common ends are cut off first; the rest costs len(b) steps on len(a)-bit numbers.
    """
    start, ea, eb = 0, len(a), len(b)
    while start < min(ea, eb) and a[start] == b[start]:
        start += 1
    while ea > start and eb > start and a[ea - 1] == b[eb - 1]:
        ea, eb = ea - 1, eb - 1
    a, b = a[start:ea], b[start:eb]
    if not len(a) or not len(b):
        return len(a) + len(b)
    places: dict = {}
    for i, x in enumerate(a):
        places[x] = places.get(x, 0) | 1 << i
    full, top = (1 << len(a)) - 1, 1 << (len(a) - 1)
    plus, minus, distance = full, 0, len(a)
    for y in b:
        match = places.get(y, 0)
        vertical = match | minus
        diagonal = (((match & plus) + plus) ^ plus) | match
        up = minus | (~(diagonal | plus) & full)
        down = plus & diagonal
        distance += bool(up & top) - bool(down & top)
        up = (up << 1 | 1) & full
        down = down << 1 & full
        plus = down | (~(vertical | up) & full)
        minus = up & vertical
    return distance


def token_distance(a: Column, b: Column) -> Column:
    """Edit distance of two token arrays; a null array counts as empty."""

    @F.pandas_udf("int")
    def measure(a: pd.Series, b: pd.Series) -> pd.Series:
        tidy = lambda x: [] if x is None else list(x)
        return pd.Series([edit_distance(tidy(x), tidy(y)) for x, y in zip(a, b)], dtype="int32")

    return measure(a, b)


def text_metrics(reference: Column, hypothesis: Column, simplify: Simplifier | None = None) -> Column:
    """Errors and reference units of words, characters and mixed tokens; null is empty."""
    word, mixed = re.compile(WORD_TOKENS), re.compile(MIXED_TOKENS)

    @F.pandas_udf(METRICS)
    def measure(ref: pd.Series, hyp: pd.Series) -> pd.DataFrame:
        rows = []
        for r, h in zip(ref, hyp):
            r, h = fold_text(r or "", simplify), fold_text(h or "", simplify)
            row: list[int] = []
            for cut in (word.findall, lambda t: t.replace(" ", ""), mixed.findall):
                row += [edit_distance(cut(r), cut(h)), len(cut(r))]
            rows.append(row)
        return pd.DataFrame(np.array(rows, dtype=np.int32).reshape(-1, 6), columns=["wer_errors", "wer_units", "cer_errors", "cer_units", "mer_errors", "mer_units"])

    return measure(reference, hypothesis)


def sample_rate(errors: Column, units: Column) -> Column:
    """Per-sample rate: without reference units 0 if there is no error, else 1."""
    return F.when(units != 0, errors / units).when(errors == 0, 0.0).otherwise(1.0)


def similarity(a: Column, b: Column) -> Column:
    """1 - edit distance / longer length, of strings; two empty strings are equal."""
    longest = F.greatest(F.length(a), F.length(b))
    return F.when(longest > 0, 1 - F.levenshtein(a, b) / longest).otherwise(1.0)


def matching_ratio(a: str, b: str) -> float:
    """Ratcliff-Obershelp ratio: twice the characters in matching blocks over all."""
    from difflib import SequenceMatcher

    return SequenceMatcher(None, a, b, autojunk=False).ratio()

"""Exact memoised encoding: texts are cut at safe boundaries and each distinct unit is
encoded once per worker, in batches, by the tokenizer library itself.

A cut before a space that a non-space character follows is safe for byte-level and for
word-end BPE alike: no pre-token spans such a place, white space before it is grouped in
the same way with or without what follows, and special tokens hold no spaces. So the ids
of a text are the ids of its units one after the other, whatever the text's length.
"""

from __future__ import annotations

import json
import re
from array import array
from itertools import chain

from quillet.llm.common import environment_threads

_LOOSE = re.compile(r" (?:\s|\Z)")
CACHE_UNITS = 150_000
LONG_UNIT = 512


def cut(text: str) -> list[str]:
    """Units whose concatenation is ``text``, each cut made before a space that a
    non-space character follows. The space itself leads the unit after the cut."""
    first, *rest = text.split(" ")
    if not _LOOSE.search(text):
        return [first, *(" " + u for u in rest)]
    units = [first]
    for u in rest:
        if not u or u[0].isspace():
            units[-1] += " " + u
        else:
            units.append(" " + u)
    return units


def cut_words(text: str) -> list[str]:
    """Units for tokenizers that drop white space: what lies between spaces and line ends."""
    return text.replace("\n", " ").split(" ")


def load_tokenizer(path: str):
    environment_threads()
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    tokenizer.no_truncation()
    tokenizer.no_padding()
    return tokenizer


class UnitEncoder:
    """Memoised encoder of one worker process; it outlives tasks.

    ``value`` turns an Encoding into what is kept for a unit. Beyond ``CACHE_UNITS`` units
    a new generation of the cache begins, which takes over from the last what is used
    again; units of more than ``LONG_UNIT`` characters are encoded each time.
    """

    _of: dict[tuple, "UnitEncoder"] = {}

    @classmethod
    def get(cls, path: str, value) -> "UnitEncoder":
        key = (path, value.__name__)
        if key not in cls._of:
            cls._of[key] = cls(path, value)
        return cls._of[key]

    def __init__(self, path: str, value):
        self.tokenizer = load_tokenizer(path)
        self.value = value
        self.cache: dict[str, object] = {}
        self.last: dict[str, object] = {}

    def _encode(self, units: list[str]) -> dict[str, object]:
        coded = self.tokenizer.encode_batch_fast(units, add_special_tokens=False)
        return dict(zip(units, map(self.value, coded)))

    def learn(self, units: list[list[str]]) -> dict[str, object]:
        """Make the values of all units of a batch known and return the lookup."""
        wanted = set(chain.from_iterable(units))
        if len(self.cache) > CACHE_UNITS:
            self.cache, self.last = {}, self.cache
        missing = wanted - self.cache.keys()
        known = missing & self.last.keys()
        self.cache.update((u, self.last[u]) for u in known)
        new = list(missing - known)
        if not new:
            return self.cache
        fresh = self._encode(new)
        long = {u: fresh.pop(u) for u in list(fresh) if len(u) > LONG_UNIT}
        self.cache |= fresh
        return self.cache | long if long else self.cache


class WordCoder:
    """Ids, as little-endian 32-bit numbers, of the units of a tokenizer that lower-cases,
    drops white space and marks word ends.

    Units of plain Latin letters, with a comma or full stop at most, are one or two
    pre-tokens. Where the vocabulary numbers its merges in order, a rank-based byte-pair
    coder gives their ids; the word-end mark is a byte that UTF-8 never holds. All other
    units, and all units of other vocabularies, are encoded by the library.
    """

    _of: dict[str, "WordCoder"] = {}
    PLAIN = re.compile(r"([A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff]+)([,.]?)")

    @classmethod
    def get(cls, path: str) -> "WordCoder":
        if path not in cls._of:
            cls._of[path] = cls(path)
        return cls._of[path]

    def __init__(self, path: str):
        self.tokenizer = load_tokenizer(path)
        with open(path, encoding="utf-8") as file:
            self.rank = _ranked_words(json.load(file))
        self.memo, self.last = _Memo(self._learn), {}

    def lookup(self):
        """The function from a unit to its ids; ask for it anew for each batch of texts."""
        if len(self.memo) > CACHE_UNITS:
            self.last, self.memo = self.memo, _Memo(self._learn)
        return self.memo.__getitem__

    def _library(self, unit: str) -> bytes:
        return array("I", self.tokenizer.encode(unit, add_special_tokens=False).ids).tobytes()

    def _learn(self, unit: str) -> bytes:
        ids = self.last.get(unit)
        if ids is None:
            plain = self.rank and self.PLAIN.fullmatch(unit)
            if plain:
                word = plain[1].lower()
                ids = self.memo.get(word) or self.last.get(word)
                if ids is None:
                    ids = array("I", self.rank(word.encode() + b"\xff")).tobytes()
                    self.memo[word] = ids
                if plain[2]:
                    ids += self.memo[plain[2]]
            else:
                ids = self._library(unit)
        if len(unit) <= LONG_UNIT:
            self.memo[unit] = ids
        return ids


class _Memo(dict):
    def __init__(self, learn):
        super().__init__()
        self.learn = learn

    def __missing__(self, unit: str) -> bytes:
        return self.learn(unit)


def _ranked_words(config: dict):
    """Coder of one word with its end mark, or None if ids don't follow the merges."""
    import tiktoken

    vocabulary = config["model"]["vocab"]
    merges = [m if isinstance(m, list) else m.split(" ") for m in config["model"]["merges"]]
    ids = [vocabulary.get(a + b) for a, b in merges]
    if config["model"].get("end_of_word_suffix") != "</w>" or None in ids or ids != sorted(set(ids)):
        return None
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    letters = {chr(b): b for b in printable} | {chr(256 + i): b for i, b in enumerate(sorted(set(range(256)) - set(printable)))}
    special = {t["content"] for t in config["added_tokens"]}
    ranks = {}
    for token, number in vocabulary.items():
        if token not in special:
            end = token.endswith("</w>")
            ranks[bytes(letters[c] for c in token.removesuffix("</w>")) + b"\xff" * end] = number
    return tiktoken.Encoding("words", pat_str=".+", mergeable_ranks=ranks, special_tokens={})._core_bpe.encode_single_piece

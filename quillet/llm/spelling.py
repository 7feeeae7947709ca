"""Spelling variants: words at an edit distance of one, grouped under the common spelling.

The vocabulary is laid out as compact tries of at most ``SHARD_WORDS`` words of a range.
Shards are broadcast in waves of bounded bytes. In each task the distance-one automaton of
every word is run depth-first through every shard of the wave; the neighbours that it
accepts are reduced to their number and the commonest. Sums over waves, and then the
chains from word to form to root, are joins on the word.
"""

from __future__ import annotations

import math
import re
import zlib
from array import array
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillet.llm.common import shuffle_partitions, stored

SHARD_WORDS = 50_000
WAVE_BYTES = 64 << 20
HELD_COUNTS = 400_000


# --- words of the corpus -----------------------------------------------------------------


def word_counts(docs: DataFrame, min_length: int = 6, min_count: int = 5, every: int = 199) -> DataFrame:
    """(word, n): runs of Latin letters of the whole texts, with A-Z lower-cased.

    In one of ``every`` pairs of a document and a run, by crc32 of ``<doc_id>:<run>``, a
    letter is deleted (code point crc32 % length). Words of fewer than ``min_length`` code
    points or ``min_count`` occurrences are left out. A null text has no runs, a null
    doc_id reads as '' in the checksum, repeated rows count each, an empty table gives
    none.
    """
    runs = re.compile(f"[A-Za-zÀ-ÿ]{{{min_length},}}")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter = Counter()

        def sums() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array(held.keys(), pa.string()), pa.array(held.values(), pa.int64())], ["word", "n"])
            held.clear()
            return out

        for batch in batches:
            for key, text in zip(batch.column("key").to_pylist(), batch.column("text").to_pylist()):
                start = zlib.crc32(key)
                # bytes.lower() changes A-Z only
                for run, n in Counter(runs.findall(text.lower().decode())).items():
                    h = zlib.crc32(run.encode(), start)
                    if h % every == 0:
                        at = h % len(run)
                        run = run[:at] + run[at + 1 :]
                        if len(run) < min_length:
                            continue
                    held[run] += n
                if len(held) > HELD_COUNTS:
                    yield sums()
        yield sums()

    key = F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(":")).cast("binary")
    texts = docs.where("text is not null").select(key.alias("key"), F.col("text").cast("binary").alias("text"))
    return texts.mapInArrow(count, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= min_count)


# --- tries and the automaton -------------------------------------------------------------


class Trie:
    """Compact trie in level order: node i has the label ``labels[i]``, its children are
    the nodes from ``first[i]`` to before ``first[i + 1]``, and ``n[i]`` is the count of
    the word that ends there, or 0. Node 0 is the root."""

    __slots__ = ("labels", "first", "n")

    def __init__(self, labels: str, first: array, n: array):
        self.labels, self.first, self.n = labels, first, n

    @classmethod
    def of(cls, words: list[str], counts: list[int]) -> Trie:
        """From words in order, each once."""
        labels, first, n = ["\0"], array("I"), array("q")
        level, depth = [(0, len(words))], 0
        while level:
            below = []
            for lo, hi in level:
                ends = lo < hi and len(words[lo]) == depth
                n.append(counts[lo] if ends else 0)
                first.append(len(labels))
                at = lo + ends
                while at < hi:
                    c, begin = words[at][depth], at
                    while at < hi and words[at][depth] == c:
                        at += 1
                    labels.append(c)
                    below.append((begin, at))
            level, depth = below, depth + 1
        first.append(len(labels))
        return cls("".join(labels), first, n)

    @property
    def size(self) -> int:
        return len(self.labels.encode()) + 4 * len(self.first) + 8 * len(self.n)

    def pack(self) -> tuple[str, bytes, bytes]:
        return self.labels, self.first.tobytes(), self.n.tobytes()

    @classmethod
    def unpack(cls, labels: str, first: bytes, n: bytes) -> Trie:
        return cls(labels, array("I", first), array("q", n))

    def neighbours(self, word: str) -> Iterator[tuple[str, int]]:
        """(neighbour, count) of the trie's words at distance one of ``word``, each once.

        The automaton's states are (letters read, edits made). Within a run of equal
        letters only the last may be deleted and an equal letter is only inserted after
        it, so no word is accepted by two ways.
        """
        labels, first, size = self.labels, self.first, len(word)

        def rest(node: int, at: int) -> int:
            """Count of the word that goes on from the node with exactly word[at:]."""
            for c in word[at:]:
                node = labels.find(c, first[node], first[node + 1])
                if node < 0:
                    return 0
            return self.n[node]

        stack = [(0, 0)]
        while stack:
            node, at = stack.pop()
            here = word[at] if at < size else ""
            if here and (at + 1 == size or word[at + 1] != here) and (n := rest(node, at + 1)):
                yield word[:at] + word[at + 1 :], n
            for child in range(first[node], first[node + 1]):
                c = labels[child]
                if c == here:
                    stack.append((child, at + 1))
                    continue
                if n := rest(child, at):
                    yield word[:at] + c + word[at:], n
                if here and (n := rest(child, at + 1)):
                    yield word[:at] + c + word[at + 1 :], n


_SHARD = "labels string, first binary, n binary, bytes long"


def trie_shards(words: DataFrame, shard_words: int = SHARD_WORDS) -> DataFrame:
    """Stored tries (shard, labels, first, n, bytes) over ranges of ``words`` (word, n)."""

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def packed(held: list[tuple[str, int]]) -> pa.RecordBatch:
            trie = Trie.of([w for w, _ in held], [n for _, n in held])
            columns = [*trie.pack(), trie.size]
            kinds = [pa.string(), pa.binary(), pa.binary(), pa.int64()]
            return pa.RecordBatch.from_arrays([pa.array([x], k) for x, k in zip(columns, kinds)], ["labels", "first", "n", "bytes"])

        held: list[tuple[str, int]] = []
        for batch in batches:
            held += zip(batch.column("word").to_pylist(), batch.column("n").to_pylist())
            while len(held) > shard_words:
                yield packed(held[:shard_words])
                del held[:shard_words]
        if held:
            yield packed(held)

    ranges = max(1, math.ceil(words.count() / shard_words))
    ranged = words.repartitionByRange(ranges, "word").sortWithinPartitions("word").mapInArrow(build, _SHARD)
    return stored(ranged.withColumn("shard", F.monotonically_increasing_id()), "tries")


def _waves(sizes: list[tuple[int, int]], limit: int) -> Iterator[list[int]]:
    """Numbers of shards (number, bytes), in groups of at most ``limit`` bytes or one shard."""
    wave, held = [], 0
    for number, size in sizes:
        if wave and held + size > limit:
            yield wave
            wave, held = [], 0
        wave.append(number)
        held += size
    if wave:
        yield wave


_NEAR = "word string, n_near long, best_n long, best string"


def near_words(words: DataFrame, shard_words: int = SHARD_WORDS, wave_bytes: int = WAVE_BYTES) -> DataFrame:
    """Stored (word, n_near, best_n, best) of the words that have a neighbour: how many,
    and the one of largest count (ties: first in code-point order) with its count.

    ``words`` (word, n) has each word once. The driver knows the sizes of the shards and
    holds one wave of them at a time.
    """
    spark = words.sparkSession
    shards = trie_shards(words, shard_words)
    sizes = [(r.shard, r.bytes) for r in shards.select("shard", "bytes").orderBy("shard").collect()]
    dealt = words.select("word").repartition(shuffle_partitions(spark))
    found = spark.createDataFrame([], _NEAR)
    for wave in _waves(sizes, wave_bytes):
        chosen = shards.where(F.col("shard").isin(wave)).select("labels", "first", "n").collect()
        sent = spark.sparkContext.broadcast([(r.labels, bytes(r.first), bytes(r.n)) for r in chosen])

        def search(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            tries = [Trie.unpack(*t) for t in sent.value]
            for batch in batches:
                out = ([], [], [], [])
                for word in batch.column("word").to_pylist():
                    number, best = 0, (0, "")
                    for trie in tries:
                        for other, n in trie.neighbours(word):
                            number += 1
                            if n > best[0] or n == best[0] and other < best[1]:
                                best = n, other
                    if number:
                        for column, x in zip(out, (word, number, *best)):
                            column.append(x)
                kinds = [pa.string(), pa.int64(), pa.int64(), pa.string()]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds)], ["word", "n_near", "best_n", "best"])

        found = found.unionByName(stored(dealt.mapInArrow(search, _NEAR), "near"))
        sent.destroy()
    best = F.min(F.struct((-F.col("best_n")).alias("minus"), "best")).alias("b")
    whole = found.groupBy("word").agg(F.sum("n_near").alias("n_near"), best)
    return whole.select("word", "n_near", (-F.col("b.minus")).alias("best_n"), F.col("b.best").alias("best"))


# --- forms and roots ---------------------------------------------------------------------


def group_spellings(words: DataFrame, ratio: int = 5, shard_words: int = SHARD_WORDS, wave_bytes: int = WAVE_BYTES) -> DataFrame:
    """One row per word of ``words`` (word, n): word, form, root, n, n_near, form_n.

    Words are near if they differ by one inserted, deleted or replaced code point. A
    word's form is its near word of largest n (ties: first in code-point order) if that
    is at least ``ratio`` (2 or more) times its own n; the root follows forms to the last.
    ``words`` has each word once with n > 0; an empty table gives no rows.
    """
    words = stored(words.select("word", "n"), "words")
    near = near_words(words, shard_words, wave_bytes)
    joined = words.join(near, "word", "left")
    is_form = F.col("best_n") >= ratio * F.col("n")
    formed = stored(joined.select(
        "word", "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"),
        F.when(is_form, F.col("best")).alias("form"), F.when(is_form, F.col("best_n")).alias("form_n"),
    ), "forms")
    low, high = words.agg(F.min("n"), F.max("n")).first()
    # each step multiplies n, so chains are short; a round doubles the steps that are known
    steps = int(math.log(high / low, ratio)) + 1 if low else 1
    hops = formed.where("form is not null").select("word", F.col("form").alias("root"))
    for _ in range(math.ceil(math.log2(steps)) if steps > 1 else 0):
        on = hops.select(F.col("word").alias("root"), F.col("root").alias("further"))
        hops = stored(hops.join(on, "root", "left").select("word", F.coalesce("further", "root").alias("root")), "roots")
    return formed.join(hops, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")

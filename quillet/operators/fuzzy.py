"""Fuzzy dictionary matching as a distributed similarity join.

A match is a window of a text's comparable characters that is close to a surface of the
dictionary in sound and in writing. Nothing holds the whole dictionary per text:

1. Surfaces become rows with their readings. Similarity in sound that a hint needs allows
   k edits, so of k + 1 pieces of a surface one stands unchanged in any window that can
   pass. Pieces (two to four units) are the postings; surfaces too short for that are
   posted by all of their bigrams.
2. Texts become blocks with context on both sides, so that what is held at once stays small
   however long a text is. The grams of all blocks of a batch meet the postings as numbers;
   of a hit's surroundings one pass over arrays tells whether any window there can be
   within k edits, and what is left proposes the few windows whose lengths fit.
3. Windows that reach a hint's score are spans. The distinct ones (a misspelling that is
   common counts once) meet the bigram postings of all surfaces for exact scores, best and
   runner-up; the spans get them back by a join.
4. Decisions are columns; the best of a text that don't overlap are taken.
"""

from __future__ import annotations

import math
import unicodedata
from collections.abc import Iterator
from functools import lru_cache, reduce
from itertools import product

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillet.operators.matching import BOUNDARIES, MatchConfig
from quillet.operators.windows import greedy_spans
from quillet.sources.store import shared_table

#: Units of a block's own part.
BLOCK = 512
#: Units of blocks, and hits, that are handled at once.
UNITS_AT_ONCE, HITS_AT_ONCE = 250_000, 200_000
#: Postings that are broadcast at once; a larger dictionary takes several turns.
POSTINGS_A_TURN = 1_000_000
MAX_READINGS = 64
MODES = ("off", "shadow", "hint", "auto")


# --- comparable characters, runs and blocks ----------------------------------------------


class _Folds(dict):
    """Comparable characters of each character: NFKC, case folded, without punctuation and
    separators. Hard boundaries become a line end where ``runs`` are kept apart."""

    def __init__(self, runs: bool):
        super().__init__(dict.fromkeys(map(ord, BOUNDARIES), "\n") if runs else {})

    def __missing__(self, code: int) -> str:
        folded = unicodedata.normalize("NFKC", chr(code)).casefold()
        self[code] = out = "".join(c for c in folded if unicodedata.category(c)[0] not in "PZ")
        return out


class _Folding:
    """The comparable characters of a text, and where in it each comes from, by tables of
    all characters that are filled as they are met."""

    UNMET = 255

    def __init__(self):
        self.folds = _Folds(runs=True)
        self.first = np.zeros(0x110000, dtype=np.uint32)
        self.counts = np.full(0x110000, self.UNMET, dtype=np.uint8)

    def __call__(self, text: str) -> tuple[str, np.ndarray]:
        codes = _codes(text)
        counts = self.counts[codes]
        if (counts == self.UNMET).any():
            for code in np.unique(codes[counts == self.UNMET]).tolist():
                out = self.folds[code]
                self.counts[code], self.first[code] = len(out), ord(out[0]) if out else 0
            counts = self.counts[codes]
        at = np.repeat(np.arange(len(text), dtype=np.int32), counts)
        units = self.first[codes[at]]
        if (counts > 1).any():
            begins = np.cumsum(counts, dtype=np.int64) - counts
            for code in np.unique(codes[counts > 1]).tolist():
                for k, c in enumerate(self.folds[code]):
                    units[begins[codes == code] + k] = ord(c)
        return units.tobytes().decode("utf-32-le"), at


def _codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le"), dtype=np.uint32)


def _cut(codes: np.ndarray, begins: np.ndarray, ends: np.ndarray) -> pa.Array:
    """The stretches of a text, given as codes, as an array of strings."""
    flat, parts = _ranges(begins, ends)
    some = codes[flat]
    width = 1 + (some > 0x7F).astype(np.int32) + (some > 0x7FF) + (some > 0xFFFF)
    at = np.concatenate(([0], np.cumsum(width)))[parts].astype(np.int32)
    data = some.tobytes().decode("utf-32-le").encode()
    return pa.StringArray.from_buffers(len(begins), pa.py_buffer(at.tobytes()), pa.py_buffer(data))


def _ranges(begins: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All numbers of the ranges one after the other, and where each range begins and the last one ends."""
    n = ends - begins
    parts = np.concatenate(([0], np.cumsum(n)))
    return np.arange(parts[-1]) + np.repeat(begins - parts[:-1], n), parts


def _stretches(ends: np.ndarray, most: int) -> list[tuple[int, int]]:
    """Ranges of what ends at ``ends``, each of about ``most`` or a single one."""
    turns = (ends // most).tolist()
    begins = [i for i in range(len(turns)) if i == 0 or turns[i] != turns[i - 1]]
    return list(zip(begins, [*begins[1:], len(turns)]))


def text_blocks(texts: DataFrame, context: int, width: int = BLOCK) -> DataFrame:
    """Blocks of the comparable characters of ``texts`` (id, text).

    Columns: id, lead and size (units of the block before its own part, and of that part),
    units (with ``context`` units on both sides), places (where in the text each unit comes
    from), source (that stretch of the text) and source_at. Runs between hard boundaries
    are set apart by line ends. Null and empty texts have none.
    """
    width = max(width, context)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        folds = _Folding()
        for batch in batches:
            texts = batch.column("text")
            sizes = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False), dtype=np.int64)
            for begin, end in _stretches(sizes, UNITS_AT_ONCE):
                rows, numbers, strings, places, begins = [], ([], [], []), ([], []), [], [0]
                for row, text in enumerate(texts.slice(begin, end - begin).to_pylist(), begin):
                    if not text:
                        continue
                    units, at = folds(text)
                    for own in range(0, len(units), width):
                        a, b = max(0, own - context), min(len(units), own + width + context)
                        rows.append(row)
                        for column, x in zip(numbers, (own - a, min(width, len(units) - own), int(at[a]))):
                            column.append(x)
                        for column, x in zip(strings, (units[a:b], text[at[a] : at[b - 1] + 1])):
                            column.append(x)
                        places.append(at[a:b])
                        begins.append(begins[-1] + b - a)
                flat = pa.array(np.concatenate(places) if places else np.empty(0, np.int32), pa.int32())
                yield pa.RecordBatch.from_arrays(
                    [batch.column("id").take(pa.array(rows, pa.int64())), *(pa.array(x, pa.int32()) for x in numbers), *(pa.array(x, pa.string()) for x in strings),
                     pa.ListArray.from_arrays(pa.array(begins, pa.int32()), flat)],
                    ["id", "lead", "size", "source_at", "units", "source", "places"],
                )

    kind = dict(texts.dtypes)["id"]
    return texts.select("id", "text").mapInArrow(run, f"id {kind}, lead int, size int, source_at int, units string, source string, places array<int>")


# --- sounds ------------------------------------------------------------------------------


class Sounds:
    """Sounds of characters, from a table (character, sound, rank) with a row for each way
    to read a character (rank 0 first). Each sound stands for one character of its own, so
    that strings of sounds compare as strings; characters without a sound keep themselves.

    The table holds characters, so it is bounded by their number and is kept whole.
    """

    def __init__(self, table: DataFrame | None = None):
        rows = table.select("character", "sound", "rank").distinct().collect() if table is not None else []
        codes = {s: s if len(s) == 1 else chr(0xF0000 + i) for i, s in enumerate(sorted({r["sound"] for r in rows}))}
        self.of: dict[str, list[str]] = {}
        for r in sorted(rows, key=lambda r: (r["character"], r["rank"], r["sound"])):
            self.of.setdefault(r["character"], []).append(codes[r["sound"]])

    def readings(self, units: str) -> list[str]:
        """All ways to read a surface."""
        ways = [self.of.get(c, [c]) for c in units]
        if math.prod(map(len, ways)) > MAX_READINGS:
            raise ValueError(f"more than {MAX_READINGS} readings of {units!r}")
        return list(dict.fromkeys(map("".join, product(*ways))))

    def columns(self, units: Column) -> Column:
        """Array of the readings of a text: the first takes each character's first sound,
        the next ones the second and so on, or the last that a character has."""
        most = max(map(len, self.of.values()), default=1)
        chars = "".join(self.of)
        ways = [F.translate(units, chars, "".join(s[min(k, len(s) - 1)] for s in self.of.values())) if chars else units for k in range(most)]
        return F.array_distinct(F.array(*ways))


# --- surfaces and postings ---------------------------------------------------------------


def window_slack(n: int) -> int:
    return max(1, min(2, n // 4))


def least_similarity(config: MatchConfig) -> float:
    """Similarity in sound below which no score reaches a hint: writing is never closer
    than sound, and length, domain and priority give their weights at most."""
    others = config.length_weight + config.domain_weight + config.priority_weight
    both = config.pinyin_weight + config.character_weight
    return (config.hint_score - others) / both if both else 0.0


def allowed_edits(longest: int, least: float) -> int:
    return max(0, math.floor((1 - least) * longest + 1e-9))


def pieces(reading: str, least: float) -> list[tuple[str, int, int]]:
    """(gram, offset, reach): one of the grams stands in every window that can pass, at
    most ``reach`` places off. k edits leave one of k + 1 pieces as it is; where pieces
    would be single units, a window is known by sharing a bigram at all."""
    n = len(reading)
    k = allowed_edits(n + window_slack(n), least)
    if n // (k + 1) < 2:
        # one unit more in a surface of three leaves one of its bigrams; else any may be left, anywhere
        reach = 1 if n == 3 and k == 1 else n + 2
        return [(reading[i : i + 2], i, reach) for i in range(n - 1)]
    cuts = [n * i // (k + 1) for i in range(k + 2)]
    return [(reading[a:b], a, k) for a, b in zip(cuts, cuts[1:])]


SURFACE = (
    "entity_id long, canonical string, entity_type string, domain string, policy string, priority int, number int, surface string, "
    "units string, reading string, n int, pieces array<struct<gram:string,off:int,reach:int>>, bigrams array<string>"
)


def surface_rows(dictionary: DataFrame, config: MatchConfig, sounds: Sounds) -> DataFrame:
    """Stored rows of SURFACE, one for each reading of each surface with comparable
    characters of the enabled entities. ``number`` orders the surfaces of an entity."""
    least = least_similarity(config)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        folds = _Folds(runs=False)
        for batch in batches:
            out = []
            for row in batch.itertuples(index=False):
                units = row.surface.translate(folds)
                for reading in sounds.readings(units) if units else ():
                    grams = {x[i : i + 2] for x in (units, reading) for i in range(len(units) - 1)}
                    posted = [dict(zip(("gram", "off", "reach"), p)) for p in pieces(reading, least)]
                    out.append((*row, units, reading, len(units), posted, sorted(grams)))
            yield pd.DataFrame(out, columns=[part.split(" ")[0] for part in SURFACE.split(", ")])

    aliases = F.coalesce("aliases", F.array().cast("array<string>"))
    listed = dictionary.where("enabled").select(
        F.col("entity_id").cast("long"), F.col("canonical_text").alias("canonical"), "entity_type", "domain", F.col("normalization_policy").alias("policy"),
        F.col("priority").cast("int"), F.posexplode(F.array_distinct(F.concat(F.array("canonical_text"), aliases))).alias("number", "surface"),
    )
    return shared_table(listed.where("surface is not null").mapInPandas(run, SURFACE), "surfaces")


def check_dictionary(dictionary: DataFrame, domain: str, config: MatchConfig) -> None:
    """Raises for more entities than the limit and for entities of other domains."""
    size = dictionary.count()
    if size > config.max_entities:
        raise ValueError(f"{size} entities exceed the limit of {config.max_entities}")
    foreign = dictionary.where(~F.col("domain").isin(domain, "general")).select("domain").distinct().orderBy("domain").limit(20).collect()
    if foreign:
        raise ValueError("entities of other domains: " + ", ".join(r["domain"] for r in foreign))


# --- scores ------------------------------------------------------------------------------


def folded(text: Column) -> Column:
    """Equal for texts that differ in case only."""
    return F.lower(F.upper(F.lower(text)))


def closeness(a: Column, b: Column) -> Column:
    return 1.0 - F.levenshtein(a, b) / F.greatest(F.length(a), F.length(b))


def scored(rows: DataFrame, config: MatchConfig, domain: str, char: Column, sound: Column) -> DataFrame:
    """``rows`` (window, n, domain, priority) with the single scores and the final one."""
    m = F.length("window")
    out = rows.withColumns({
        "char_score": char, "pinyin_score": sound,
        "length_score": 1.0 - F.abs(m - F.col("n")) / F.greatest(m, "n"),
        "domain_score": F.when(F.col("domain") == domain, 1.0).otherwise(0.8),
        "priority_score": F.least(F.lit(20), F.greatest(F.lit(0), "priority")) / 20.0,
    })
    return out.withColumn(
        "final_score",
        config.pinyin_weight * F.col("pinyin_score") + config.character_weight * F.col("char_score") + config.length_weight * F.col("length_score")
        + config.domain_weight * F.col("domain_score") + config.priority_weight * F.col("priority_score"),
    )


@lru_cache(maxsize=None)
def _moved(reach: int) -> frozenset[tuple[int, int]]:
    """Shifts (left, right) of a window's ends against the place where its surface would
    lie; lengths differ by two at most."""
    return frozenset((a, b) for a in range(-reach, reach + 1) for b in range(a - 2, a + 3) if abs(a) + abs(b) <= 2 * reach and abs(b) <= reach)


HIT = (
    "source_at int, n int, priority int, stretch string, written string, source string, reading string, surface_units string, surface string, domain string, "
    "said array<string>, places array<int>, lengths array<int>"
)


def _gram_keys(codes: np.ndarray, n: int) -> np.ndarray:
    """A number for each ``n`` codes in a row; equal ones have equal numbers."""
    size = len(codes) - n + 1
    keys = codes[:size].astype(np.uint64)
    for k in range(1, n):
        keys *= np.uint64(0x9E3779B97F4A7C15)
        keys += codes[k : size + k]
    return keys * np.uint64(0xD6E8FEB86659FD93)


class _Postings:
    """Posted grams by their numbers, with the surfaces that they are pieces of. Where two
    grams had the same number, a hit would propose one more stretch, which is then judged
    as any other."""

    def __init__(self, posted: pa.Table, config: MatchConfig, domain: str):
        self.rows, self.least = posted.combine_chunks(), least_similarity(config)
        self.both, self.length, self.hint = config.pinyin_weight + config.character_weight, config.length_weight, config.hint_score
        near = np.array([1.0 if d == domain else 0.8 for d in posted.column("domain").to_pylist()])
        priority = posted.column("priority").to_numpy()
        self.rest = config.domain_weight * near + config.priority_weight * np.clip(priority, 0, 20) / 20.0
        self.off, self.reach, self.n = (posted.column(c).to_numpy().astype(np.int64) for c in ("off", "reach", "n"))
        self.kind = self.n << 32 | self.reach
        grams, names = posted.column("gram").to_pylist(), posted.column("reading").to_pylist()
        self.readings = names
        known: dict[tuple, int] = {}
        whole = zip(names, *(posted.column(c).to_pylist() for c in ("surface_units", "surface", "domain", "priority", "reach")))
        self.surfaces = known
        self.owner = np.array([known.setdefault(x, len(known)) for x in whole], dtype=np.int64)
        self.tables = []
        for length in sorted(set(map(len, grams))):
            rows = np.array([i for i, g in enumerate(grams) if len(g) == length])
            keys = _gram_keys(_codes("".join(grams[i] for i in rows)), length)[::length]
            order = np.argsort(keys, kind="stable")
            unique, first, counts = np.unique(keys[order], return_index=True, return_counts=True)
            seen = np.zeros(1 << 18, dtype=bool)
            seen[unique >> np.uint64(46)] = True
            self.tables.append((length, rows[order], unique, first, counts, seen))

    def hits(self, codes: np.ndarray):
        """(place, posting) of the grams in ``codes``, some at once."""
        for length, rows, unique, first, counts, seen in self.tables:
            if len(codes) < length:
                continue
            keys = _gram_keys(codes, length)
            at = np.flatnonzero(seen[keys >> np.uint64(46)])
            which = np.minimum(np.searchsorted(unique, keys[at]), len(unique) - 1)
            met = unique[which] == keys[at]
            at, which = at[met], which[met]
            for a, b in _stretches(np.cumsum(counts[which]), HITS_AT_ONCE):
                n = counts[which[a:b]]
                nth = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
                yield length, np.repeat(at[a:b], n), rows[np.repeat(first[which[a:b]], n) + nth]

    def windows(self, codes: np.ndarray, begin: np.ndarray, row: np.ndarray):
        """(hit, left, m): windows around the places ``begin``, where the reading of ``row``
        would lie, that are as close to it as a hint needs, by their distances. Scores are
        bounded by that of the sound and decided later. ``codes`` are padded, so that all
        stretches lie within."""
        out = [np.empty((3, 0), dtype=np.int64)]
        kinds = self.kind[row]
        for kind in np.unique(kinds):
            mine = np.flatnonzero(kinds == kind)
            n, reach = int(self.n[row[mine[0]]]), int(self.reach[row[mine[0]]])
            owners, which = np.unique(row[mine], return_inverse=True)
            wanted = np.ascontiguousarray(np.array([_codes(self.readings[r]) for r in owners]).T)
            # the distance to the nearest part of the stretch tells most hits
            at, width = begin[mine] - reach, n + 2 * reach
            stretch = [codes[at + j] for j in range(width)]
            near = reduce(np.minimum, _distances(stretch, wanted, which, True)) <= allowed_edits(n + window_slack(n), self.least)
            mine, which, at = mine[near], which[near], at[near]
            stretch = [x[near] for x in stretch]
            rest = self.rest[row[mine]]
            for left in range(-reach, reach + 1):
                # the window ends ``right`` units off as well
                ends = [m for m in range(max(2, n - window_slack(n)), n + window_slack(n) + 1) if (left, left + m - n) in _moved(reach)]
                if not ends or not len(mine):
                    continue
                distances = _distances(stretch[left + reach : left + reach + ends[-1]], wanted, which, False)
                for m in ends:
                    longest = max(m, n)
                    close = distances[m] <= allowed_edits(longest, self.least)
                    best = self.both * (1 - distances[m] / longest) + self.length * (1 - abs(m - n) / longest) + rest
                    met = mine[close & (best >= self.hint - 1e-6)]
                    out.append(np.stack([met, np.full(len(met), left), np.full(len(met), m)]))
        return np.concatenate(out, axis=1)


def _distances(text: list[np.ndarray], wanted: np.ndarray, which: np.ndarray, anywhere: bool) -> list[np.ndarray]:
    """Edit distances of the rows ``which`` of ``wanted`` to the first 0, 1, ... units of
    ``text``, or to those that begin anywhere in it; all hits at once."""
    n, small = len(wanted), np.uint8 if len(wanted) + len(text) < 250 else np.int32
    before = [np.full(len(which), 0 if anywhere else j, dtype=small) for j in range(len(text) + 1)]
    for i in range(n):
        letter, now = wanted[i][which], [np.full(len(which), i + 1, dtype=small)]
        for j, unit in enumerate(text):
            least = before[j] + (unit != letter)
            np.minimum(least, before[j + 1] + small(1), out=least)
            np.minimum(least, now[j] + small(1), out=least)
            now.append(least)
        before = now
    return before


def proposed_stretches(blocks: DataFrame, posted: DataFrame, config: MatchConfig, domain: str) -> DataFrame:
    """(id, *HIT): the stretches of ``blocks`` in which some windows may be close enough to a
    posted surface, with these windows and that surface.

    The postings of a turn go to every task; blocks are handled as arrays of numbers, a
    bounded number of units and hits at once.
    """
    table = posted.toArrow()
    shared = blocks.sparkSession.sparkContext.broadcast(table)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        postings = _Postings(shared.value, config, domain) if shared.value.num_rows else None
        pad = int((postings.n + 2 * postings.reach).max()) if postings else 0
        for batch in batches:
            if not postings:
                continue
            units = batch.column("units").to_pylist()
            sizes = np.cumsum([len(u) for u in units], dtype=np.int64)
            for begin, end in _stretches(sizes, UNITS_AT_ONCE):
                yield found(batch.slice(begin, end - begin), units[begin:end], postings, pad)

    def found(batch: pa.RecordBatch, units: list[str], postings: _Postings, pad: int) -> pa.RecordBatch:
        lead, size, source_at = (batch.column(c).to_numpy() for c in ("lead", "size", "source_at"))
        readings = batch.column("readings").to_pylist()
        places = batch.column("places")
        flat, offsets = places.flatten().to_numpy(), places.offsets.to_numpy().astype(np.int64) - places.offsets[0].as_py()
        written = _codes("".join(units))
        source, stretches = _codes("".join(sources := batch.column("source").to_pylist())), np.cumsum([0, *map(len, sources)])
        block = np.array([b for b, r in enumerate(readings) for _ in r], dtype=np.int64)
        begins = np.concatenate(([0], np.cumsum([len(r) for r in readings])))
        sounds = [x for r in readings for x in r]
        lengths = np.array([len(x) for x in sounds], dtype=np.int64)
        # a line end parts the blocks: nothing reaches over it
        starts = pad + np.cumsum(lengths + 1) - lengths - 1
        codes = _codes("\n" * pad + "\n".join(sounds) + "\n" * (pad + 1))
        parts = [np.empty((4, 0), dtype=np.int64)]
        for length, at, row in postings.hits(codes):
            which = np.searchsorted(starts, at, side="right") - 1
            inside, held = at - starts[which], lengths[which]
            b = block[which]
            own = (which >= 0) & (inside >= lead[b]) & (inside < lead[b] + size[b]) & (inside + length <= held)
            row, which, first = row[own], which[own], (at - postings.off[row])[own]
            hit, left, m = postings.windows(codes, first, row)
            row, which, begin = row[hit], which[hit], first[hit] + left - starts[which[hit]]
            inside = (begin >= 0) & (begin + m <= lengths[which])
            parts.append(np.stack([which, begin, m, row])[:, inside])
        which, begin, m, row = np.concatenate(parts, axis=1)
        # pieces of one surface propose the same windows; what is left goes by stretches that begin alike
        owner = postings.owner[row]
        place = (which * len(postings.surfaces) + owner) * len(codes) + begin
        order = np.lexsort((m, place))
        alone = order[np.concatenate(([True], (place[order][1:] != place[order][:-1]) | (m[order][1:] != m[order][:-1])))[: len(order)]]
        heads = np.flatnonzero(np.concatenate(([True], place[alone][1:] != place[alone][:-1]))[: len(alone)])
        tails = np.append(heads[1:], len(alone)) if len(alone) else heads
        longest = m[alone[tails - 1]] if len(alone) else m
        which, a, row = which[alone[heads]], begin[alone[heads]], row[alone[heads]]
        z, b = a + longest, block[which]
        listed, ends = _ranges(offsets[b] + a, offsets[b] + z)
        first, last = flat[offsets[b] + a], flat[offsets[b] + z - 1]
        shift = stretches[b] - source_at[b]
        # all readings of a block, that of the hit among them
        each, several = _ranges(begins[b], begins[b + 1])
        again = np.repeat(np.arange(len(b)), begins[b + 1] - begins[b])
        of = lambda name: postings.rows.column(name).take(pa.array(row, pa.int64())).combine_chunks()
        whole = lambda x: pa.array(x, pa.int32())
        lists = lambda at, values: pa.ListArray.from_arrays(whole(at), values)
        columns = {
            "id": batch.column("id").take(pa.array(b, pa.int64())), "source_at": whole(first), **{c: of(c) for c in ("n", "priority")},
            "stretch": _cut(codes, starts[which] + a, starts[which] + z), "written": _cut(written, offsets[b] + a, offsets[b] + z), "source": _cut(source, first + shift, last + 1 + shift),
            **{c: of(c) for c in ("reading", "surface_units", "surface", "domain")}, "said": lists(several, _cut(codes, (starts[each] + a[again]), (starts[each] + z[again]))),
            "places": lists(ends, whole(flat[listed])), "lengths": lists(np.append(heads, len(alone)), whole(m[alone])),
        }
        return pa.RecordBatch.from_arrays(list(columns.values()), list(columns))

    kind = dict(blocks.dtypes)["id"]
    return blocks.mapInArrow(run, f"id {kind}, {HIT}")


SPAN_KEY = ["window", "sounds", "observed_folded"]


def hopeful_spans(blocks: DataFrame, surfaces: DataFrame, config: MatchConfig, domain: str) -> DataFrame:
    """(id, start, end, observed, *SPAN_KEY): windows whose score with some surface reaches
    a hint. ``blocks`` has the readings of its units in ``readings``."""
    least = least_similarity(config)
    posted = surfaces.select("*", F.inline("pieces")).select("gram", "off", "reach", "n", "reading", F.col("units").alias("surface_units"), "surface", "domain", "priority")
    turns = max(1, math.ceil(posted.count() / POSTINGS_A_TURN))

    def turn(part: int) -> DataFrame:
        some = posted.where(F.pmod(F.xxhash64("gram"), F.lit(turns)) == part) if turns > 1 else posted
        # windows are cut from a stretch that holds them all, not from the block
        windows = proposed_stretches(blocks, some, config, domain).select("*", F.explode("lengths").alias("m"))
        windows = windows.withColumn("heard", F.substring("stretch", F.lit(1), F.col("m")))
        edits = F.floor((1 - least) * F.greatest("m", "n") + 1e-9).cast("int")
        # the distance of each length of window has its own bound; -1 stands for beyond the bound of the longest
        near = F.levenshtein("heard", "reading", allowed_edits(_longest(surfaces) + 2, least))
        windows = windows.where(~F.contains("heard", F.lit("\n"))).withColumn("distance", near).where((F.col("distance") >= 0) & (F.col("distance") <= edits))
        windows = windows.withColumn("window", F.substring("written", F.lit(1), F.col("m")))
        ranked = scored(windows, config, domain, closeness(F.col("window"), F.col("surface_units")), closeness(F.col("heard"), F.col("reading")))
        start = F.element_at("places", F.lit(1))
        end = F.element_at("places", F.col("m")) + 1
        good = ranked.where(F.col("final_score") >= config.hint_score).withColumn("start", start).withColumn("end", end)
        good = good.withColumn("observed", F.substring("source", F.col("start") - F.col("source_at") + 1, F.col("end") - F.col("start")))
        good = good.withColumn("observed_folded", folded(F.col("observed"))).where(F.col("observed_folded") != folded(F.col("surface")))
        sounds = F.array_distinct(F.transform("said", lambda r: F.substring(r, F.lit(1), F.col("m"))))
        return good.select("id", "start", "end", "observed", "window", sounds.alias("sounds"), "observed_folded")

    return reduce(DataFrame.unionByName, map(turn, range(turns))).distinct()


def _longest(surfaces: DataFrame) -> int:
    return surfaces.agg(F.max("n")).first()[0] or 0


BEST = "top array<struct<minus:double,priority:int,entity_id:bigint,number:int>>"


def best_surfaces(keys: DataFrame, surfaces: DataFrame, config: MatchConfig, domain: str) -> DataFrame:
    """The two best entities (``top``, best first) for each distinct window of SPAN_KEY,
    over all surfaces that share a bigram with it in writing or sound and fit its length."""
    pair = F.lit("(?s)(?=(.{2})).")
    grams = F.flatten(F.transform(F.concat(F.array("window"), "sounds"), lambda x: F.regexp_extract_all(x, pair, F.lit(1))))
    asked = keys.select("*", F.explode(F.array_distinct(grams)).alias("gram"))
    posted = surfaces.select("entity_id", "number", "reading", "n", F.explode("bigrams").alias("gram"))
    slack = F.greatest(F.lit(1), F.least(F.lit(2), F.floor(F.col("n") / 4).cast("int")))
    met = asked.join(posted, "gram").where(F.abs(F.length("window") - F.col("n")) <= slack)
    met = met.select(*SPAN_KEY, "entity_id", "number", "reading").distinct()
    full = met.join(surfaces.drop("pieces", "bigrams"), ["entity_id", "number", "reading"]).where(F.col("observed_folded") != folded(F.col("surface")))
    sound = F.array_max(F.transform("sounds", lambda s: closeness(s, F.col("reading"))))
    rows = scored(full, config, domain, closeness(F.col("window"), F.col("units")), sound)
    # of an entity the surface of the highest score, then the first one
    fields = ["char_score", "pinyin_score", "length_score", "domain_score", "priority_score", "final_score"]
    by_entity = rows.groupBy(*SPAN_KEY, "entity_id").agg(F.min(F.struct(
        (-F.col("final_score")).alias("minus"), (-F.col("priority")).alias("low"), "entity_id", "number", *fields,
        "canonical", "entity_type", "domain", "policy", "priority", F.col("surface").alias("matched_surface"), F.col("units").alias("surface_units"),
    )).alias("b"))
    ranked = by_entity.withColumn("rank", F.row_number().over(Window.partitionBy(*SPAN_KEY).orderBy("b.minus", "b.low", "b.entity_id")))
    return ranked.where("rank <= 2").groupBy(*SPAN_KEY).agg(F.sort_array(F.collect_list("b")).alias("top"))


def decided(rows: DataFrame, config: MatchConfig, mode: str, allow_auto: bool) -> DataFrame:
    """``rows`` with decision and reasons, from the scores, the margin and the entity."""
    kind, n = F.upper("entity_type"), F.length("surface_units")
    ascii_only = F.octet_length("surface_units") == n
    checks = {
        "entity_too_short": (n == 1) | (ascii_only & (n < 4)),
        "preserve_policy": F.col("policy") != "normalize",
        "entity_type_not_auto": ~kind.isin(*config.auto_entity_types),
        "high_risk_entity_type": kind.isin(*config.high_risk_entity_types),
        "auto_score_below_threshold": F.col("final_score") < config.auto_score,
        "pinyin_score_below_threshold": F.col("pinyin_score") < config.auto_min_pinyin,
        "candidate_margin_too_small": F.col("margin") < config.auto_min_margin,
    }
    failed = F.array_compact(F.array(*[F.when(c, F.lit(name)) for name, c in checks.items()]))
    able = F.size("failed") == 0
    named = lambda *names: F.array(*map(F.lit, names))
    if mode == "shadow":
        decision, reasons = F.lit("KEEP_RAW"), F.concat("failed", F.when(able, named("shadow_would_auto_normalize")).otherwise(named("shadow_mode")))
    elif mode == "auto" and allow_auto:
        decision = F.when(able, F.lit("AUTO_NORMALIZE")).otherwise("HINT_ONLY")
        reasons = F.when(able, named("score_pass", "margin_pass", "final_event")).otherwise(F.col("failed"))
    else:
        decision = F.lit("HINT_ONLY")
        reasons = F.when(able, named("hint_mode" if allow_auto else "partial_event")).otherwise(F.col("failed"))
    return rows.withColumn("failed", failed).withColumn("decision", decision).withColumn("reasons", reasons).drop("failed")


def fuzzy_matches(texts: DataFrame, dictionary: DataFrame, domain: str = "general", config: MatchConfig = MatchConfig(), mode: str = "shadow",
                  allow_auto: bool = False, blocked: DataFrame | None = None, sounds: DataFrame | None = None) -> DataFrame:
    """Matches of the dictionary in ``texts`` (id, text): id and the fields of a match.

    ``dictionary`` is an entity view (entity_id, canonical_text, entity_type, domain,
    normalization_policy, priority, aliases, enabled). ``blocked`` (id, start, end) are
    spans that no match may touch. ``sounds`` (character, sound, rank) is the phonetic
    table. Literal occurrences are no matches. A text's matches don't overlap: of the
    ``max_logged_candidates`` best by decision, score, length, priority, entity and place,
    each is taken unless a better one is in its way.

    An id stands for one text: rows that repeat an id and text count once. Null and empty
    texts, an empty dictionary and mode off give no rows.
    """
    if mode not in MODES:
        raise ValueError(f"mode must be one of {', '.join(MODES)}")
    check_dictionary(dictionary, domain, config)
    known = Sounds(sounds)
    surfaces = surface_rows(dictionary, config, known)
    if mode == "off":
        texts = texts.limit(0)
    blocks = text_blocks(texts, 2 * _longest(surfaces) + 8).withColumn("readings", known.columns(F.col("units")))
    spans = hopeful_spans(blocks, surfaces, config, domain)
    if blocked is not None:
        b = blocked.select(F.col("id").alias("_id"), F.col("start").alias("_start"), F.col("end").alias("_end"))
        spans = spans.join(b, (F.col("id") == F.col("_id")) & (F.col("start") < F.col("_end")) & (F.col("_start") < F.col("end")), "left_anti")
    spans = shared_table(spans, "spans")

    best = best_surfaces(spans.select(*SPAN_KEY).distinct(), surfaces, config, domain)
    # two windows of units can come from the same stretch of a text
    ranked = spans.join(best, SPAN_KEY).groupBy("id", "start", "end", "observed").agg(F.sort_array(F.flatten(F.collect_list("top"))).alias("top"))
    ranked = ranked.withColumn("b", F.get("top", F.lit(0))).withColumn("others", F.filter("top", lambda t: t["entity_id"] != F.col("b.entity_id")))
    runner_up = F.get("others", F.lit(0))["final_score"] if config.max_candidates_per_span > 1 else F.lit(None).cast("double")
    rows = ranked.select("id", "start", "end", "observed", "b.*", runner_up.alias("runner_up_score")).where(F.col("final_score") >= config.hint_score)
    rows = rows.withColumn("margin", F.coalesce(F.col("final_score") - F.col("runner_up_score"), F.lit(1.0)))
    rows = decided(rows, config, mode, allow_auto).withColumn("match_type", F.when(F.col("pinyin_score") >= F.col("char_score"), "PINYIN_FUZZY").otherwise("CHAR_FUZZY"))

    level = F.when(F.col("decision") == "AUTO_NORMALIZE", 0).when(F.col("decision") == "HINT_ONLY", 1).otherwise(2)
    order = [level, F.col("minus"), F.col("start") - F.col("end"), F.col("low"), F.col("entity_id"), F.col("start")]
    rows = rows.withColumn("rank", F.row_number().over(Window.partitionBy("id").orderBy(*order))).where(F.col("rank") <= config.max_logged_candidates)
    fields = [
        "start", "end", "observed", "entity_id", "canonical", "entity_type", "domain", "matched_surface", "match_type", "char_score", "pinyin_score", "length_score",
        "domain_score", "priority_score", "final_score", "runner_up_score", "margin", "priority", "decision", "reasons",
    ]
    taken = rows.groupBy("id").agg(greedy_spans(F.sort_array(F.collect_list(F.struct("rank", *fields)))).alias("m"))
    return taken.select("id", F.inline("m")).select("id", *fields)

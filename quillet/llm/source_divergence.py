"""Source divergence audit: how far the word shares of sources lie apart within a language.

1. Every task counts the terms of its texts per language and source, with the documents
   that hold them; the sums are stored once. Each (language, source) has a row without a
   term as well, so groups without terms are known.
2. The terms that enough documents of a language hold become sparse vectors of their
   counts by source. Terms with the same vector are one row with a multiplicity.
3. A pair of sources is evaluated once per distinct vector; the value counts as often as
   the vector occurs. Blocks of vectors are evaluated as matrices, so no row is made for
   a pair and a vector; what leaves a task is one sum for each pair of sources.
4. The terms of each source are ranked by their own vectors' values.

Shares are whole numbers and all arithmetic is exact in 64 bits while the terms of a
language number less than 2.8e14.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillet.llm.common import LOWER, UPPER, stored

#: Letters are A-Z, a-z and what is not ASCII; A-Z are lower-cased, all else divides terms.
_TERMS = bytes(b if b >= 0x80 or chr(b) in LOWER else ord(chr(b).lower()) if chr(b) in UPPER else 0x20 for b in range(256))
HELD_COUNTS = 400_000
#: Rows of (language, source) up to which their totals are broadcast; beyond, they are joined.
BROADCAST_GROUPS = 100_000
MATRIX_CELLS = 1 << 20
SCALE = 1_000_000_000


def _count_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sums of a task: (lang, source, term, n, docs), sent on whenever many are held."""
    n: dict[tuple, Counter] = defaultdict(Counter)
    docs: dict[tuple, Counter] = defaultdict(Counter)

    def sums() -> pa.RecordBatch:
        rows = [(lang, source, t, c, docs[lang, source][t]) for (lang, source), counts in n.items() for t, c in counts.items()]
        columns = list(zip(*rows)) or [()] * 5
        kinds = [pa.string(), pa.string(), pa.binary(), pa.int64(), pa.int64()]
        n.clear()
        docs.clear()
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], ["lang", "source", "term", "n", "docs"])

    held = 0
    for batch in batches:
        for lang, source, text in zip(*(batch.column(c).to_pylist() for c in ("lang", "source", "text"))):
            terms = text.translate(_TERMS).split()
            counts = n[lang, source]
            held -= len(counts)
            counts.update(terms)
            counts[None] += 0  # the group itself
            held += len(counts)
            docs[lang, source].update({*terms, None})
            if held > HELD_COUNTS:
                yield sums()
                held = 0
    yield sums()


def share(n: str, total: str, terms: str) -> str:
    """SQL of 1 + floor(SCALE * (n + 2) / (total + 2 * terms)); two steps keep it in 64 bits."""
    a, b = f"({n} + 2)", f"({total} + 2 * {terms})"
    return f"(1 + (31250L * {a} div {b}) * 32000L + (31250L * {a} % {b}) * 32000L div {b})"


def _shares(n: np.ndarray, totals: np.ndarray, terms: int) -> np.ndarray:
    a, b = n + 2, totals + 2 * terms
    whole, rest = np.divmod(31250 * a, b)
    return 1 + whole * 32000 + rest * 32000 // b


def _evaluate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, a, b, value): the sums over a task's vectors for each pair a < b of sources."""
    sums: dict[str, np.ndarray] = {}

    def rows() -> pa.RecordBatch:
        out = ([], [], [], [])
        for lang, value in sums.items():
            a, b = np.triu_indices(len(value), 1)
            for column, more in zip(out, ([lang] * len(a), a.tolist(), b.tolist(), value[a, b].tolist())):
                column += more
        sums.clear()
        kinds = [pa.string(), pa.int32(), pa.int32(), pa.int64()]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds)], ["lang", "a", "b", "value"])

    for batch in batches:
        by_lang = defaultdict(list)
        langs = batch.column("lang").to_pylist()
        for i, lang in enumerate(langs):
            by_lang[lang].append(i)
        for lang, all_rows in by_lang.items():
            totals = np.array(batch.column("totals")[all_rows[0]].as_py(), dtype=np.int64)
            terms = batch.column("terms")[all_rows[0]].as_py()
            size = len(totals)
            if lang not in sums:
                if sum(v.size for v in sums.values()) + size * size > 4 * MATRIX_CELLS:
                    yield rows()
                sums[lang] = np.zeros((size, size), dtype=np.int64)
            step = max(1, MATRIX_CELLS // size)
            for at in range(0, len(all_rows) if terms else 0, step):
                chosen = batch.take(pa.array(all_rows[at : at + step]))
                vectors, times = chosen.column("vector"), chosen.column("times").to_numpy()
                entries = vectors.flatten()
                n = np.zeros((len(chosen), size), dtype=np.int64)
                row = np.repeat(np.arange(len(chosen)), vectors.value_lengths().to_numpy())
                n[row, entries.field("no").to_numpy()] = entries.field("n").to_numpy()
                p = _shares(n, totals, terms)
                for a in range(size - 1):
                    apart = p[:, a : a + 1] - p[:, a + 1 :]
                    sums[lang][a, a + 1 :] += times @ (apart * apart // (p[:, a : a + 1] + p[:, a + 1 :]))
    yield rows()


def divergence(docs: DataFrame, min_docs: int = 10, top: int = 10) -> DataFrame:
    """Rows (lang, source, part, item, value, rank) for each source of each language.

    Terms are runs of letters with A-Z lower-cased; a language keeps those that at least
    ``min_docs`` of its documents (rows) hold. With p and q the shares of a term in two
    groups, (p - q)^2 / (p + q), rounded down, is how far it sets them apart. Part
    ``pair``: every other source of the language, by the sum over all kept terms. Part
    ``term``: the ``top`` terms that the source has more of than its language as a whole.

    Null lang, source and text are read as ''. Repeated rows count each, a source without
    terms is a group with counts of 0, a language without kept terms has pairs of value 0
    and no terms, a language with one source has no pairs. Ties go to the smaller item in
    UTF-8 order. Other columns are ignored; an empty table gives no rows.
    """
    filled = docs.select(*(F.coalesce(F.col(c), F.lit("")).alias(c) for c in ("lang", "source")), F.coalesce("text", F.lit("")).cast("binary").alias("text"))
    counted = filled.mapInArrow(_count_terms, "lang string, source string, term binary, n long, docs long")
    counts = stored(counted.groupBy("lang", "source", F.col("term").cast("string").alias("term")).agg(F.sum("n").alias("n"), F.sum("docs").alias("docs")), "counts")

    numbered = F.row_number().over(Window.partitionBy("lang").orderBy("source")) - 1
    groups = stored(counts.where("term is null").select("lang", "source", numbered.alias("no")), "groups")
    bounded = groups.count() <= BROADCAST_GROUPS
    small = lambda df: F.broadcast(df) if bounded else df

    entries = counts.where("term is not null").join(small(groups), ["lang", "source"])
    vector = F.sort_array(F.collect_list(F.struct("no", "n"))).alias("vector")
    terms = stored(entries.groupBy("lang", "term").agg(F.sum("docs").alias("docs"), vector).where(F.col("docs") >= min_docs).drop("docs"), "terms")
    vectors = stored(terms.groupBy("lang", "vector").agg(F.count("*").alias("times")), "vectors")

    sums = vectors.select("lang", "times", F.inline("vector")).groupBy("lang", "no").agg(F.sum(F.col("times") * F.col("n")).alias("total"))
    kept = vectors.groupBy("lang").agg(F.sum("times").alias("terms"))
    whole = groups.join(sums, ["lang", "no"], "left").join(kept, "lang", "left").na.fill(0, ["total", "terms"])
    whole = stored(
        whole.groupBy("lang", "terms").agg(F.sum("total").alias("all"), F.sort_array(F.collect_list(F.struct("no", "total"))).alias("t")).select(
            "lang", "terms", "all", F.transform("t", lambda x: x["total"]).alias("totals")
        ), "totals"
    )

    # a vector of no terms stands for each language, so that every pair occurs
    every = vectors.unionByName(whole.select("lang", F.slice(F.array(F.struct(F.lit(0).alias("no"), F.lit(0).cast("long").alias("n"))), 1, 0).alias("vector"), F.lit(0).cast("long").alias("times")))
    pairs = every.join(small(whole.select("lang", "terms", "totals")), "lang").mapInArrow(_evaluate, "lang string, a int, b int, value long")
    pairs = pairs.groupBy("lang", "a", "b").agg(F.sum("value").alias("value"))
    ways = F.array(F.struct(F.col("a").alias("no"), F.col("b").alias("other")), F.struct(F.col("b").alias("no"), F.col("a").alias("other")))
    pairs = pairs.select("lang", "value", F.inline(ways)).join(small(groups), ["lang", "no"]).join(
        small(groups.select("lang", F.col("no").alias("other"), F.col("source").alias("item"))), ["lang", "other"]
    )

    shares = f"transform(vector, v -> struct(v.no as no, {share('v.n', 'totals[v.no]', 'terms')} as p))"
    total = "aggregate(vector, 0L, (s, v) -> s + v.n)"
    ranked = terms.join(small(whole), "lang").selectExpr("lang", "term as item", f"{share(total, 'all', 'terms')} as q", f"inline({shares})").where("p > q")
    ranked = ranked.selectExpr("lang", "no", "item", "(p - q) * (p - q) div (p + q) as value").join(small(groups), ["lang", "no"])

    best = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    columns = lambda df, part: df.select("lang", "source", F.lit(part).alias("part"), "item", "value", F.row_number().over(best).alias("rank"))
    return columns(pairs, "pair").unionByName(columns(ranked, "term").where(F.col("rank") <= top))

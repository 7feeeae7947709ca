"""Near-duplicate documents: fast similarity sketching, banding, exact verification.

Sketch. Each document's set of 5-word shingles is thrown into ``t`` bins for up to
``2 t`` rounds. In round ``i < t`` every element goes to a hashed bin, in round
``t + j`` to bin ``j``; a bin keeps its smallest value, and values of earlier rounds are
smaller than those of later ones. A document stops once all its bins are filled, so
every coordinate fills, and the share of equal coordinates of two sketches is
concentrated around their Jaccard similarity as if the coordinates were drawn without
replacement.

Banding. ``bands`` groups of ``rows`` coordinates are hashed; documents that share one
are candidates. At a similarity of exactly 0.75 the defaults (51 bands of 5) lose a link
with probability (1 - 0.75**5)**51 = 1e-6; above it far less.

Verification without pair rows. Equal sets collapse first, so copies are one row. Then
each bucket compares its members with one leader; components of the exact links follow.
Buckets whose members are all in one component are settled. Each of the rest, one of
those with the same members, is compared in pairs of blocks of bounded bytes: a task holds
two blocks of a bucket, counts the intersections of their full sets, skips what is
connected already, and returns only links that join components, so its output never
exceeds its documents. Links are confirmed on the full shingle sets of the whole texts (as
64-bit fingerprints).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillet.llm.common import _SHINGLE, lowered, mix64, shingle_sets, slabs, stored
from quillet.llm.graph import connected_components

_EMPTY = np.iinfo(np.uint64).max
BLOCK_BYTES = 2 << 20


def fast_similarity_sketch(elements: np.ndarray, owners: np.ndarray, n: int, t: int) -> np.ndarray:
    """Sketches (n x t, uint64) of n sets given as elements with their set's number.

    Sets without elements keep unfilled rows.
    """
    sketch = np.full(n * t, _EMPTY, dtype=np.uint64)
    base = owners * t
    low = np.uint64((1 << 40) - 1)
    for i in range(2 * t):
        if not len(elements):
            break
        x = mix64(elements ^ np.uint64((0x9E3779B97F4A7C15 * (i + 1)) & (2**64 - 1)))
        bins = ((x >> np.uint64(40)) % np.uint64(t)).astype(np.int64) if i < t else i - t
        np.minimum.at(sketch, base + bins, (x & low) | np.uint64(i << 40))
        keep = ~(sketch.reshape(n, t) != _EMPTY).all(axis=1)[base // t]
        elements, base = elements[keep], base[keep]
    return sketch.reshape(n, t)


def _features(bands: int, rows: int):
    t = bands * rows

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            texts = [lowered(x) for x in batch["text"]]
            for a, b in slabs(texts):
                sets = shingle_sets(texts[a:b])
                sizes = np.array([len(s) for s in sets], dtype=np.int64)
                marks = []
                for s in sets:
                    m = mix64(s ^ np.uint64(0x2545F4914F6CDD1D))
                    marks.append((s.sum(dtype=np.uint64), m.sum(dtype=np.uint64)))
                sketches = fast_similarity_sketch(np.concatenate(sets), np.repeat(np.arange(len(sets)), sizes), len(sets), t)
                parts = sketches.reshape(len(sets), bands, rows)
                keys = np.arange(1, bands + 1, dtype=np.uint64) * np.uint64(0x9FB21C651E98DF25) + np.zeros((len(sets), 1), dtype=np.uint64)
                for k in range(rows):
                    keys += parts[:, :, k] * (_SHINGLE[k % 5] + np.uint64(2 * (k // 5)))
                keys = mix64(keys).view(np.int64)
                k1, k2 = np.array(marks, dtype=np.uint64).reshape(-1, 2).T.view(np.int64)
                yield pd.DataFrame({
                    "doc_id": batch["doc_id"].iloc[a:b].array,
                    "n_shingles": sizes, "k1": k1, "k2": k2,
                    "bands": [r if n else r[:0] for r, n in zip(keys, sizes)],
                })

    return run


def _verify(num: int, den: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            # each distinct text of a batch is cut once: leaders recur
            ids = {}
            for i, x in zip([*batch["a"], *batch["b"]], [*batch["text_a"], *batch["text_b"]]):
                ids.setdefault((i, x), len(ids))
            texts = [lowered(x) for _, x in ids]
            sets = []
            for s, e in slabs(texts):
                sets += shingle_sets(texts[s:e])
            keep = []
            for a, ta, b, tb in zip(batch["a"], batch["text_a"], batch["b"], batch["text_b"]):
                x, y = sets[ids[a, ta]], sets[ids[b, tb]]
                both = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(den * both >= num * (len(x) + len(y) - both))
            yield batch.loc[np.array(keep, dtype=bool), ["a", "b"]]

    return run


class _Forest:
    """Disjoint sets over the component labels of one task."""

    def __init__(self):
        self.up: dict[int, int] = {}

    def find(self, x: int) -> int:
        while (y := self.up.get(x, x)) != x:
            self.up[x] = x = self.up.get(y, y)
        return x

    def join(self, x: int, y: int) -> bool:
        x, y = self.find(x), self.find(y)
        self.up[max(x, y)] = min(x, y)
        return x != y


def _sets(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The shingle set of each text, as bytes."""
    for batch in batches:
        texts = [lowered(x) for x in batch["text"]]
        sets = []
        for a, b in slabs(texts):
            sets += shingle_sets(texts[a:b])
        yield pd.DataFrame({"rep": batch["rep"].array, "grams": [s.tobytes() for s in sets]})


def _compare_blocks(num: int, den: int):
    """Links between the documents of two blocks that join different components."""

    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        _, i, j = key
        sets = [np.frombuffer(x, dtype=np.uint64) for x in rows["grams"]]
        sizes = np.array([len(s) for s in sets], dtype=np.int64)
        _, ids = np.unique(np.concatenate(sets), return_inverse=True)
        mark = np.zeros(len(ids) and ids.max() + 1, dtype=bool)
        ends = np.cumsum(sizes)
        block, rep, component = (rows[c].to_numpy() for c in ("block", "rep", "component"))
        right = np.flatnonzero(block == j)
        ids_right = np.concatenate([ids[ends[y] - sizes[y] : ends[y]] for y in right] or [ids[:0]])
        begins = np.cumsum(sizes[right]) - sizes[right]
        forest, out = _Forest(), []
        for x in np.flatnonzero(block == i):
            n, of_x = sizes[x], ids[ends[x] - sizes[x] : ends[x]]
            maybe = (component[right] != component[x]) & (den * np.minimum(n, sizes[right]) >= num * np.maximum(n, sizes[right]))
            if not maybe.any():
                continue
            mark[of_x] = True
            both = np.add.reduceat(mark[ids_right], begins, dtype=np.int64)
            mark[of_x] = False
            linked = maybe & (den * both >= num * (n + sizes[right] - both))
            for y in right[linked]:
                if forest.join(int(component[x]), int(component[y])):
                    out.append((min(rep[x], rep[y]), max(rep[x], rep[y])))
        return pd.DataFrame(out, columns=["a", "b"], dtype="int64")

    return run


def near_duplicates(docs: DataFrame, bands: int = 51, rows: int = 5, num: int = 75, den: int = 100) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id, kept.

    ``docs`` needs doc_id and text; other columns are ignored, whatever their names.
    Documents are linked when den * intersection >= num * union of their shingle sets.
    Null, empty and blank texts have no shingles: they are linked with nothing and kept.
    Equal texts are always linked. A repeated doc_id is one node: the links of all its
    texts are its links, and each of its rows is returned. A null doc_id takes no part: its component is null and it is kept.
    An empty table gives an empty result.
    """
    spark = docs.sparkSession
    features = stored(
        docs.select("doc_id", "text").mapInPandas(
            _features(bands, rows),
            "doc_id long, n_shingles long, k1 long, k2 long, bands array<long>",
        ),
        "features",
    )
    sets = features.where("n_shingles > 0 and doc_id is not null")
    reps = stored(
        sets.groupBy("k1", "k2", "n_shingles").agg(
            F.min("doc_id").alias("rep"), F.min_by("bands", "doc_id").alias("bands")
        ),
        "representatives",
    )
    postings = reps.select("rep", F.explode("bands").alias("bucket"))
    buckets = postings.groupBy("bucket").agg(F.min("rep").alias("leader"), F.max("rep").alias("last"))
    shared = stored(
        postings.join(buckets.where("leader < last"), "bucket").select("bucket", "rep", "leader"), "buckets"
    )
    involved = shared.select(F.col("rep").alias("doc_id")).distinct()
    texts = stored(docs.select("doc_id", "text").join(involved, "doc_id", "left_semi"), "involved").distinct()

    def verified(pairs: DataFrame, name: str) -> DataFrame:
        """The pairs (a, b) whose full sets are similar enough."""
        side = lambda x: texts.select(F.col("doc_id").alias(x), F.col("text").alias(f"text_{x}"))
        both = pairs.join(side("b"), "b").join(side("a"), "a").select("a", "b", "text_a", "text_b")
        return stored(both.mapInPandas(_verify(num, den), "a long, b long"), name)

    first = shared.where("leader < rep").select(F.col("leader").alias("a"), F.col("rep").alias("b")).distinct()
    links = verified(first, "links-1")
    labels = connected_components(links, "labels-1")

    # what one leader did not settle: buckets that still hold several components
    labelled = shared.join(labels.withColumnRenamed("node", "rep"), "rep", "left").select(
        "bucket", "rep", F.coalesce("component", "rep").alias("component")
    )
    mark = lambda seed: F.sum(F.xxhash64(F.lit(seed), "rep").cast("decimal(38,0)"))
    unsettled = labelled.groupBy("bucket").agg(
        F.min("component").alias("lo"), F.max("component").alias("hi"), F.count("*").alias("size"), mark(1).alias("m1"), mark(2).alias("m2")
    ).where("lo < hi and size > 2").groupBy("m1", "m2", "size").agg(F.min("bucket").alias("bucket")).select("bucket")
    members = stored(labelled.join(unsettled, "bucket").distinct(), "unsettled")
    # their sets are made once, however many buckets they are in
    wanted = texts.withColumnRenamed("doc_id", "rep").join(members.select("rep").distinct(), "rep", "left_semi")
    grams = stored(wanted.select("rep", "text").mapInPandas(_sets, "rep long, grams binary").where("octet_length(grams) > 0"), "sets")
    held = members.join(grams, "rep")
    weighed = members.join(grams.select("rep", F.octet_length("grams").alias("bytes")), "rep")
    blocks = weighed.groupBy("bucket").agg(F.ceil(F.sum("bytes") / BLOCK_BYTES).cast("int").alias("blocks"))
    placed = held.join(blocks, "bucket").withColumn(
        "block", F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int")
    ).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    placed = placed.select(
        "bucket", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"),
        "rep", "component", "block", "grams",
    )
    more = placed.groupBy("bucket", "i", "j").applyInPandas(_compare_blocks(num, den), "a long, b long")
    # a doc_id of several texts ties their sets together
    keys = F.struct("n_shingles", "k1", "k2")
    several = features.where("doc_id is not null").groupBy("doc_id").agg(F.min(keys).alias("lo"), F.max(keys).alias("hi")).where("lo <> hi")
    ties = sets.join(several.select("doc_id"), "doc_id", "left_semi").join(reps, ["k1", "k2", "n_shingles"])
    # what is connected already goes on as stars
    stars = labels.where("node <> component").select(F.col("node").alias("a"), F.col("component").alias("b"))
    links = stars.unionByName(stored(more, "links-2")).unionByName(ties.select(F.col("doc_id").alias("a"), F.col("rep").alias("b")))
    final = connected_components(links, "labels-2").withColumnRenamed("node", "rep")

    resolved = reps.select("k1", "k2", "n_shingles", "rep").join(final, "rep", "left").select(
        "k1", "k2", "n_shingles", F.coalesce("component", "rep").alias("component_id")
    )
    with_set = sets.join(resolved, ["k1", "k2", "n_shingles"], "left").select("doc_id", "n_shingles", "component_id")
    # without shingles a document is alone, unless other rows of its doc_id are not
    bare = features.where("n_shingles = 0 or doc_id is null").select("doc_id", "n_shingles").join(
        final.withColumnRenamed("rep", "doc_id"), "doc_id", "left"
    ).select("doc_id", "n_shingles", F.coalesce("component", "doc_id").alias("component_id"))
    return with_set.unionByName(bare).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))

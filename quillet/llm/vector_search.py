"""Nearest neighbours by largest inner product: vantage-point trees under a shared top tree.

Angles between directions obey the triangle inequality whatever the norms, so the trees
work on directions, and each node also keeps the largest norm in it. If a query's k-th
score is w, a vector of norm n can only matter within the angle arccos(w / (|q| n)). A
node is left when the triangle inequality over the vantage points above it shows that all
of it lies farther away than ``factor`` times that angle. Factor 1 is exact; smaller
factors prune more and may lose neighbours. Angles only prune, with a slack for their
rounding; leaves rank by the inner products themselves, ties by the smallest id.

Top tree. A bounded sample gives a vantage-point tree whose leaves are cells; every vector
goes down to its cell, and the cell keeps its largest norm and the ranges of its angles to
the vantage points above. A cell of many vectors is dealt over several shards, each of
which has a tree of its own. Queries are blocked by cell as well. They search their own
cell first; with the k-th score from there, the top tree tells which other cells a block
still has to meet, before anything is joined. A task holds one shard and one block,
carries the best scores along, and passes on k rows a query.

Equal vectors are indexed once, with the k + 1 smallest of their ids: with ties going to
the smaller id, no other copy can be among the k nearest of any query.
"""

from __future__ import annotations

import io
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillet.llm.common import stored

SHARD_ROWS = 8192
QUERY_ROWS = 1024
#: Vectors that the top tree is fitted on, most cells, and least sampled vectors of a cell.
SAMPLE_ROWS = 4096
CELLS = 256
CELL_SAMPLE = 16
#: Tasks that share the shards a block meets; each passes its k best on, whatever the shards.
PARTS = 8
LEAF = 128
#: Pairs of shards and blocks in an Arrow batch; each is a few MB.
PAIR_ROWS = 4
#: Stands for no id, after all others.
NONE = np.iinfo(np.int64).max
EPS = np.finfo(float).eps


def usable_vectors(table: DataFrame) -> DataFrame:
    """Distinct (vec_id, embedding) without nulls, non-finite components or zero vectors."""
    bad = F.exists("embedding", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    some = F.exists("embedding", lambda x: x != 0)
    found = table.select("vec_id", F.col("embedding").cast("array<double>").alias("embedding"))
    return found.where(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull()).where(~bad & some).distinct()


def polar(vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(directions, natural logarithms of the norms), for components of any size."""
    largest = np.abs(vectors).max(axis=1)
    scaled = vectors / largest[:, None]
    norms = np.sqrt((scaled**2).sum(axis=1))
    return scaled / norms[:, None], np.log(largest) + np.log(norms)


def angles(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.arccos(np.clip(a @ b.T, -1, 1))


def angle_slack(dimension: int) -> float:
    """More than rounding can move an angle; most where it is near 0."""
    return 16 * np.sqrt(EPS * (dimension + 64))


def reach(score: np.ndarray, query_log: np.ndarray, log_norm: float, factor: float, slack: float) -> np.ndarray:
    """The angle beyond which no vector of at most that norm has the score; below 0 where
    there is none at any angle."""
    size = np.log(np.minimum(np.abs(score), np.finfo(float).max), where=score != 0, out=np.full(len(score), -np.inf))
    size[np.isneginf(score)] = np.inf
    ratio = np.sign(score) * np.exp(np.minimum(size - query_log - log_norm, 50))
    far = np.arccos(np.clip(ratio, -1, 1))
    return np.where(ratio > 1 + 1e-9, -1, factor * far + slack)


def inner_products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Row by row in double precision, summed from the first component to the last."""
    total = np.zeros(len(a))
    for d in range(a.shape[1]):
        total += a[:, d] * b[:, d]
    return total


def pair_products(a: np.ndarray, i: np.ndarray, b: np.ndarray, j: np.ndarray, step: int = 1 << 14) -> np.ndarray:
    parts = [inner_products(a[i[s : s + step]], b[j[s : s + step]]) for s in range(0, len(i), step)]
    return np.concatenate(parts) if parts else np.zeros(0)


class Best:
    """The k entries (score, id, payload) of each of n queries with the largest scores,
    ties to the smaller id."""

    def __init__(self, n: int, k: int, known: np.ndarray | None = None):
        self.k = k
        self.known = np.full(n, -np.inf) if known is None else known
        self.score = np.full((n, k), -np.inf)
        self.name = np.full((n, k), NONE)
        self.load = np.full((n, k), -1)

    def bar(self, at: np.ndarray) -> np.ndarray:
        """Scores below this can't matter: the k-th so far, or one known from elsewhere."""
        full = self.name[at, -1] != NONE
        return np.maximum(np.where(full, self.score[at, -1], -np.inf), self.known[at])

    def add(self, query: np.ndarray, score: np.ndarray, name: np.ndarray, load: np.ndarray) -> None:
        """Entries in any order; scores that are not numbers count for nothing."""
        some = (name != NONE) & ~np.isnan(score) & (score >= self.bar(query))
        if not some.any():
            return
        query, score, name, load = query[some], score[some], name[some], load[some]
        at = np.unique(query)
        row, column = np.nonzero(self.name[at] != NONE)
        query = np.concatenate([at[row], query])
        score = np.concatenate([self.score[at][row, column], score])
        name = np.concatenate([self.name[at][row, column], name])
        load = np.concatenate([self.load[at][row, column], load])
        order = np.lexsort((name, -score, query))
        query = query[order]
        rank = np.arange(len(query)) - np.searchsorted(query, query)
        order, query, rank = order[rank < self.k], query[rank < self.k], rank[rank < self.k]
        self.score[query, rank], self.name[query, rank], self.load[query, rank] = score[order], name[order], load[order]


class VantageTree:
    """A vantage-point tree over the directions of the rows of ``vectors``.

    ``nodes`` has a row (vantage, inside, outside, begin, end) for each node, children
    before parents: an inner node's vantage row and its children, or -1 and the leaf's
    part of ``order``. ``spans`` has (least, largest) angle of a node's rows to its
    parent's vantage point, ``sizes`` the logarithm of the largest norm in it.
    """

    def __init__(self, vectors: np.ndarray, saved: dict[str, np.ndarray] | None = None, leaf: int = LEAF):
        self.vectors, self.leaf = vectors, leaf
        self.directions, self.logs = polar(vectors)
        if saved is None:
            self._made: list[tuple] = []
            self.order = np.arange(len(vectors))
            self._build(0, len(vectors), (0.0, np.pi))
            self.nodes = np.array([m[:5] for m in self._made], dtype=np.int64)
            self.spans, self.sizes = np.array([m[5:7] for m in self._made]), np.array([m[7] for m in self._made])
        else:
            self.nodes, self.spans, self.sizes, self.order = (saved[x] for x in ("nodes", "spans", "sizes", "order"))

    def arrays(self) -> dict[str, np.ndarray]:
        return {"nodes": self.nodes, "spans": self.spans, "sizes": self.sizes, "order": self.order}

    def _build(self, begin: int, end: int, span: tuple[float, float]) -> int:
        rows = self.order[begin:end].copy()
        vantage = inside = outside = -1
        if end - begin > self.leaf:
            # the row farthest from the mean direction
            vantage = rows[(self.directions[rows] @ self.directions[rows].mean(axis=0)).argmin()]
            away = angles(self.directions[rows], self.directions[vantage][None])[:, 0]
            by = np.argsort(away, kind="stable")
            self.order[begin:end] = rows[by]
            away, half = away[by], len(rows) // 2
            inside = self._build(begin, begin + half, (away[0], away[half - 1]))
            outside = self._build(begin + half, end, (away[half], away[-1]))
        self._made.append((vantage, inside, outside, begin, end, *span, self.logs[rows].max()))
        return len(self._made) - 1

    def away(self, node: int, directions: np.ndarray) -> np.ndarray:
        return angles(directions, self.directions[self.nodes[node][0]][None])[:, 0]

    def goes_inside(self, node: int, away: np.ndarray) -> np.ndarray:
        """Which side a direction at that angle from the node's vantage point goes down."""
        return away <= (self.spans[self.nodes[node][1]][1] + self.spans[self.nodes[node][2]][0]) / 2

    def leaves_of(self, directions: np.ndarray) -> np.ndarray:
        """The leaf (number of its node) that each direction goes down to."""
        out = np.zeros(len(directions), dtype=np.int64)
        todo = [(len(self.nodes) - 1, np.arange(len(directions)))]
        while todo:
            node, at = todo.pop()
            vantage, inside, outside = self.nodes[node][:3]
            if vantage < 0:
                out[at] = node
            elif len(at):
                near = self.goes_inside(node, self.away(node, directions[at]))
                todo += [(inside, at[near]), (outside, at[~near])]
        return out

    def search(self, queries: np.ndarray, own: np.ndarray, ids: np.ndarray, best: Best, factor: float) -> None:
        """Adds the rows of the largest inner products of each query to ``best``.

        ``ids`` has the two smallest ids of each row, ``own`` the queries' ids: a row
        counts with its smallest id that is not the query's own, and a row without any
        is none.
        """
        directions, logs = polar(queries)
        slack = angle_slack(queries.shape[1])

        def meet(node: int, at: np.ndarray) -> None:
            rows = self.order[self.nodes[node][3] : self.nodes[node][4]]
            # a fast product, off by its rounding at most, tells which pairs to score
            blur = 8 * (queries.shape[1] + 4) * EPS * np.exp(np.minimum(logs[at] + self.sizes[node], 709)) + np.finfo(float).tiny
            maybe = ~(queries[at] @ self.vectors[rows].T < (best.bar(at) - blur)[:, None])
            i, j = np.nonzero(maybe)
            i, j = at[i], rows[j]
            name = np.where(ids[j, 0] == own[i], ids[j, 1], ids[j, 0])
            best.add(i, pair_products(queries, i, self.vectors, j), name, j)

        with np.errstate(over="ignore", invalid="ignore"):
            home = self.leaves_of(directions)
            for node in np.unique(home):
                meet(node, np.flatnonzero(home == node))
            todo = [(len(self.nodes) - 1, np.arange(len(queries)), np.zeros(len(queries)))]
            while todo:
                node, at, low = todo.pop()
                keep = low <= reach(best.bar(at), logs[at], self.sizes[node], factor, slack)
                at, low = at[keep], low[keep]
                vantage, inside, outside = self.nodes[node][:3]
                if not len(at):
                    continue
                if vantage < 0:
                    if len(at := at[home[at] != node]):
                        meet(node, at)
                    continue
                away = self.away(node, directions[at])
                for child in (inside, outside):
                    a, b = self.spans[child]
                    todo.append((child, at, np.maximum(low, np.maximum(a - away, away - b))))


class TopTree:
    """Cells of vectors of one length: the leaves of a vantage-point tree over a sample."""

    def __init__(self, sample: np.ndarray, cells: int):
        self.tree = VantageTree(sample, leaf=-(-len(sample) // cells))
        self.cell_of_leaf = np.full(len(self.tree.nodes), -1)
        self.vantages: list[int] = []  # inner nodes
        self.paths: list[list[int]] = []  # of each cell: places of the inner nodes above it
        self._walk(len(self.tree.nodes) - 1, [])

    def _walk(self, node: int, path: list[int]) -> None:
        vantage, inside, outside = self.tree.nodes[node][:3]
        if vantage < 0:
            self.cell_of_leaf[node] = len(self.paths)
            self.paths.append(path)
            return
        self.vantages.append(node)
        path = [*path, len(self.vantages) - 1]
        self._walk(inside, path)
        self._walk(outside, path)

    def all_angles(self, directions: np.ndarray) -> np.ndarray:
        points = self.tree.directions[self.tree.nodes[self.vantages, 0]]
        return angles(directions, points) if len(points) else np.zeros((len(directions), 0))

    def place(self, vectors: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
        """(cell, angles to the vantage points above the cell) of each vector."""
        directions, _ = polar(vectors)
        cells = self.cell_of_leaf[self.tree.leaves_of(directions)]
        away = self.all_angles(directions)
        return cells, [away[i, self.paths[c]] for i, c in enumerate(cells)]

    def wanted(self, queries: np.ndarray, known: np.ndarray, stats: dict[int, tuple], factor: float) -> list[int]:
        """The cells that hold what may matter to any of the queries; ``stats`` has of each
        cell the logarithm of its largest norm and its ranges of angles."""
        directions, logs = polar(queries)
        away, out = self.all_angles(directions), []
        for cell, (log_norm, least, largest) in stats.items():
            mine = away[:, self.paths[cell]]
            low = np.maximum(np.array(least) - mine, mine - np.array(largest)).max(axis=1, initial=0)
            if (low <= reach(known, logs, log_norm, factor, angle_slack(queries.shape[1]))).any():
                out.append(cell)
        return out


def _pack(**arrays: np.ndarray) -> bytes:
    out = io.BytesIO()
    np.savez(out, **arrays)
    return out.getvalue()


def _narrow(vectors: np.ndarray) -> np.ndarray:
    """As single precision where that loses nothing."""
    with np.errstate(over="ignore"):
        single = vectors.astype(np.float32)
    return single if (single == vectors).all() else vectors


def _place(shared):
    """Adds cell, angles and the logarithm of the norm to rows with dim and embedding."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for dim, rows in batch.groupby("dim", sort=False):
                vectors = np.stack(rows["embedding"].to_list())
                top = shared.value.get(dim)
                cells, away = top.place(vectors) if top else (np.zeros(len(rows), dtype=np.int64), [[]] * len(rows))
                yield rows.assign(cell=cells.astype(np.int32), angles=away, log_norm=polar(vectors)[1])

    return run


def _index(rows: pd.DataFrame) -> pd.DataFrame:
    """The tree of one shard, its vectors and the ids of each."""
    rows = rows.sort_values("first", kind="stable")
    ids = [np.asarray(x, dtype=np.int64) for x in rows["ids"]]
    vectors = np.stack(rows["embedding"].to_list())
    raw = _pack(vectors=_narrow(vectors), ids=np.concatenate(ids), counts=np.array([len(x) for x in ids]), **VantageTree(vectors).arrays())
    return pd.DataFrame({"dim": rows["dim"].iloc[:1], "cell": rows["cell"].iloc[:1], "shard": rows["shard"].iloc[:1], "packed": [raw]})


def _block(rows: pd.DataFrame) -> pd.DataFrame:
    raw = _pack(
        vectors=_narrow(np.stack(rows["embedding"].to_list())), ids=rows["vec_id"].to_numpy(dtype=np.int64),
        known=rows["known"].fillna(-np.inf).to_numpy(dtype=float),
    )
    return pd.DataFrame({"dim": rows["dim"].iloc[:1], "home": rows["cell"].iloc[:1], "block": rows["block"].iloc[:1], "asked": [raw]})


def _targets(shared, factor: float):
    """The cells besides its own that each block has to meet."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tops, stats = shared.value
        for batch in batches:
            for dim, home, block, asked in zip(*(batch[c] for c in ("dim", "home", "block", "asked"))):
                if dim in tops:
                    arrays = np.load(io.BytesIO(asked))
                    cells = tops[dim].wanted(arrays["vectors"].astype(float), arrays["known"], stats[dim], factor)
                    cells = [c for c in cells if c != home]
                    yield pd.DataFrame({"dim": dim, "home": home, "block": block, "cell": cells})

    return run


class _Found:
    """The k best candidates of each query of a block over the shards seen so far."""

    def __init__(self, raw: bytes, k: int):
        asked = np.load(io.BytesIO(raw))
        self.queries, self.ids, self.k = asked["vectors"].astype(float), asked["ids"], k
        self.best = Best(len(self.ids), k, asked["known"])

    def meet(self, raw: bytes, factor: float) -> None:
        index = np.load(io.BytesIO(raw))
        vectors, ids, counts = index["vectors"].astype(float), index["ids"], index["counts"]
        begins = np.cumsum(counts) - counts
        two = np.full((len(vectors), 2), NONE)
        two[:, 0] = ids[begins]
        two[counts > 1, 1] = ids[begins[counts > 1] + 1]
        # a few more than k: a factor below 1 loses less when it prunes by a farther one
        rows = Best(len(self.ids), self.k + 5 * (factor < 1), self.best.bar(np.arange(len(self.ids))))
        VantageTree(vectors, index).search(self.queries, self.ids, two, rows, factor)
        # every id of the rows found is a candidate
        query, place = np.nonzero(rows.load >= 0)
        row, score = rows.load[query, place], rows.score[query, place]
        n = counts[row]
        of = np.repeat(np.arange(len(row)), n)
        each = ids[begins[row[of]] + np.arange(len(of)) - (np.cumsum(n) - n)[of]]
        other = each != self.ids[query[of]]
        self.best.add(query[of][other], score[of][other], each[other], row[of][other])

    def rows(self) -> pd.DataFrame:
        query, place = np.nonzero(self.best.name != NONE)
        return pd.DataFrame({"query_id": self.ids[query], "vec_id": self.best.name[query, place], "score": self.best.score[query, place]})


def _search(k: int, factor: float):
    """Meets the shards of each (dim, home, block, part), which come one after the other,
    and yields the k best of each query of the block: holds one tree and one block."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at, found = None, None
        for batch in batches:
            for *key, packed, asked in zip(*(batch[c] for c in ("dim", "home", "block", "part", "packed", "asked"))):
                if at != key:
                    if found is not None:
                        yield found.rows()
                    at, found = key, _Found(asked, k)
                found.meet(packed, factor)
        if found is not None:
            yield found.rows()

    return run


def _top_trees(distinct: DataFrame, shard_rows: int) -> dict[int, TopTree]:
    """Top trees of the vector lengths that need more than one cell, of a bounded sample."""
    total = distinct.count()
    sample = distinct.select("dim", "embedding").orderBy(F.xxhash64("embedding"), "embedding").limit(SAMPLE_ROWS).toPandas()
    out = {}
    for dim, rows in sample.groupby("dim"):
        cells = min(CELLS, len(rows) // CELL_SAMPLE, -(-total * len(rows) // (len(sample) * shard_rows)))
        if cells > 1:
            out[int(dim)] = TopTree(np.stack(rows["embedding"].to_list()).astype(float), cells)
    return out


def nearest(table: DataFrame, is_query, k: int = 20, factor: float = 1.0, shard_rows: int = SHARD_ROWS, query_rows: int = QUERY_ROWS) -> DataFrame:
    """(query_id, rank, vec_id, score): the k rows of largest inner product of each query.

    ``is_query`` is a condition on vec_id. Candidates are all rows but those of the
    query's own vec_id, fewer than k if there are fewer; ties go to the smaller vec_id.
    Vectors that are null, zero, or hold null or non-finite components take no part, nor
    do rows with a null vec_id; a query is compared with vectors of its length only.
    Components may be of any finite size; a product that overflows to no number (infinite
    parts of both signs) is no candidate. Repeated rows count once. Other columns are
    ignored. Empty tables give empty results.
    """
    spark = table.sparkSession
    vectors = stored(usable_vectors(table).withColumn("dim", F.size("embedding")), "vectors")
    first = Window.partitionBy("embedding").orderBy("vec_id")
    copies = vectors.withColumn("copy", F.row_number().over(first)).where(F.col("copy") <= k + 1)
    distinct = stored(
        copies.groupBy("dim", "embedding").agg(F.sort_array(F.collect_list("vec_id")).alias("ids")), "distinct-vectors"
    )
    tops = _top_trees(distinct, shard_rows)
    shared = spark.sparkContext.broadcast(tops)

    def put(rows: DataFrame, columns: list[str], name: str) -> DataFrame:
        kept = ", ".join(f"{c} {t}" for c, t in rows.dtypes if c in columns)
        schema = f"{kept}, cell int, angles array<double>, log_norm double"
        return stored(rows.select(*columns).mapInPandas(_place(shared), schema), name)

    placed = put(distinct, ["dim", "embedding", "ids"], "placed")
    asked = put(vectors.where(is_query), ["vec_id", "embedding", "dim"], "asked")
    # where there is a top tree: a row of each of its cells
    depth = max((len(p) for t in tops.values() for p in t.paths), default=0)
    ends = lambda f: F.array(*[f(F.get("angles", F.lit(i))) for i in range(depth)])
    stats: dict[int, dict[int, tuple]] = {dim: {} for dim in tops}
    for r in placed.where(F.col("dim").isin(list(tops))).groupBy("dim", "cell").agg(F.max("log_norm").alias("log_norm"), ends(F.min).alias("least"), ends(F.max).alias("largest")).collect():
        n = len(tops[r["dim"]].paths[r["cell"]])
        stats[r["dim"]][r["cell"]] = (r["log_norm"], r["least"][:n], r["largest"][:n])

    def dealt(rows: DataFrame, name: str, most: int, by) -> DataFrame:
        """``rows`` with a number in which at most about ``most`` rows of a cell agree."""
        sizes = rows.groupBy("dim", "cell").agg(F.ceil(F.count("*") / most).cast("int").alias("pieces"))
        return rows.join(sizes, ["dim", "cell"]).withColumn(name, F.pmod(F.xxhash64(by), F.col("pieces")).cast("int")).drop("pieces")

    index = stored(
        dealt(placed.withColumn("first", F.col("ids")[0]), "shard", shard_rows, "first")
        .groupBy("dim", "cell", "shard").applyInPandas(_index, "dim int, cell int, shard int, packed binary"),
        "vector-index",
    )
    asked = stored(dealt(asked.select("dim", "cell", "vec_id", "embedding"), "block", query_rows, "vec_id"), "blocked")

    def blocks_of(queries: DataFrame, name: str) -> DataFrame:
        return stored(queries.groupBy("dim", "cell", "block").applyInPandas(_block, "dim int, home int, block int, asked binary"), name)

    def met(pairs: DataFrame, name: str) -> DataFrame:
        part = F.pmod(F.xxhash64("cell", "shard"), F.lit(PARTS)).cast("int")
        ordered = pairs.withColumn("part", part).repartition("dim", "home", "block", "part")
        ordered = ordered.sortWithinPartitions("dim", "home", "block", "part", "cell", "shard")
        ordered = ordered.select("dim", "home", "block", "part", "packed", "asked")
        found = ordered.mapInPandas(_search(k, factor), "query_id long, vec_id long, score double")
        return stored(found, name, batch_rows=PAIR_ROWS).distinct()

    ranked = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    blocks = blocks_of(asked.withColumn("known", F.lit(None).cast("double")), "query-blocks")
    found = met(index.join(blocks.withColumn("cell", F.col("home")), ["dim", "cell"]), "found-at-home")
    if tops:
        kth = found.withColumn("rank", F.row_number().over(ranked)).where(F.col("rank") == k)
        kth = kth.select(F.col("query_id").alias("vec_id"), F.col("score").alias("known"))
        blocks = blocks_of(asked.join(kth, "vec_id", "left"), "known-blocks")
        cells = spark.sparkContext.broadcast((tops, stats))
        targets = stored(blocks.mapInPandas(_targets(cells, factor), "dim int, home int, block int, cell int"), "targets", batch_rows=PAIR_ROWS)
        found = found.unionByName(met(index.join(targets, ["dim", "cell"]).join(blocks, ["dim", "home", "block"]), "found-elsewhere"))
    return found.withColumn("rank", F.row_number().over(ranked)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")

"""Vector search keeps ties and the neighbours beside outliers."""

import numpy as np
from pyspark.sql import functions as F
from test_other_ops import brute_nearest

from quillet.llm.vector_search import TopTree, nearest, polar


def check(spark, data):
    table = spark.createDataFrame(data, "vec_id long, embedding array<double>").repartition(3)
    got = nearest(table, F.col("vec_id") % 20 == 0, k=20)
    assert {(r.query_id, r["rank"], r.vec_id, round(r.score, 9)) for r in got.collect()} == brute_nearest(data, lambda q: q % 20 == 0, 20)


def test_ties_and_outliers(spark):
    rng = np.random.default_rng(2)
    # inner products of all others with the query are equal
    ties = [(0, [1.0, 0.0])] + [(int(i), [0.0, float(x)]) for x, i in enumerate(rng.permutation(np.arange(1, 400)), 1) if i % 20]
    check(spark, ties)
    normal = [(i, rng.standard_normal(4).tolist()) for i in range(600)]
    check(spark, normal + [(1001, [1e9, 0.0, 0.0, 0.0]), (1002, [0.0, -1e12, 0.0, 0.0])])


def test_norms_of_any_size(spark):
    """One vector 1e8 times as long, one at 1e160, one at 1e-170, over several cells and shards."""
    rng = np.random.default_rng(3)
    data = [(i, rng.standard_normal(32).tolist()) for i in range(2000)]
    data[7] = (7, (np.array(data[7][1]) * 1e8).tolist())
    data[40] = (40, (np.array(data[40][1]) * 1e160).tolist())
    data[60] = (60, (np.array(data[60][1]) * 1e-170).tolist())
    table = spark.createDataFrame(data, "vec_id long, embedding array<double>").repartition(3)
    got = {(r.query_id, r["rank"]): r for r in nearest(table, F.col("vec_id") % 20 == 0, k=20, shard_rows=300).collect()}
    want = brute_nearest(data, lambda q: q % 20 == 0, 20)
    assert len(got) == len(want) == 2000
    assert {(q, k, r.vec_id) for (q, k), r in got.items()} == {(q, k, v) for q, k, v, _ in want}
    exact = {(q, v): sum(x * y for x, y in zip(data[q][1], data[v][1])) for q, _, v, _ in want}
    assert all(abs(r.score - exact[q, r.vec_id]) <= 1e-12 * abs(exact[q, r.vec_id]) for (q, _), r in got.items())


def test_pruned_cells_lose_nothing(spark):
    """Tight clusters: most pairs of blocks and cells are dropped before the join."""
    rng = np.random.default_rng(4)
    centres = rng.standard_normal((16, 8))
    data = [(i, (centres[i % 16] * (1 + i % 3) + 0.02 * rng.standard_normal(8)).tolist()) for i in range(1600)]
    table = spark.createDataFrame(data, "vec_id long, embedding array<double>").repartition(3)
    got = nearest(table, F.col("vec_id") % 20 == 0, k=5, shard_rows=100).collect()
    assert {(r.query_id, r["rank"], r.vec_id, round(r.score, 9)) for r in got} == brute_nearest(data, lambda q: q % 20 == 0, 5)
    sample = np.array([v for _, v in data])
    top = TopTree(sample, 16)
    cells, away = top.place(sample)
    stats = {}
    for c in range(16):
        mine = np.array([a for a, cell in zip(away, cells) if cell == c])
        stats[c] = (polar(sample[cells == c])[1].max(), mine.min(axis=0), mine.max(axis=0))
    scores = np.sort(sample @ sample[0])[-6]
    assert len(top.wanted(sample[:1], np.array([scores]), stats, 1.0)) < 8

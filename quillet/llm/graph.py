"""Distributed connected components by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillet.llm.common import stored


#: A node with more than 1 / HUB of the links is a hub; there are fewer than 2 * HUB of them.
HUB = 1024


def _star(edges: DataFrame, large: bool, count: int) -> DataFrame:
    """One star step over ``count`` edges (u, v) with v < u.

    Large star: every larger neighbour of u is tied to u's smallest neighbour (or u).
    Small star: u and its smaller neighbours are tied to the smallest of them.
    The minimum is a partial aggregate. Links of hubs, which are few by definition, meet
    it by broadcast where they lie; only those of other nodes are dealt out by node.
    """
    links = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v"))) if large else edges
    low = links.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"), F.count("*").alias("degree"))
    hubs = F.broadcast(low.where(F.col("degree") * HUB > count).select("u", "m"))
    others = links.join(hubs, "u", "left_anti").join(low.select("u", "m"), "u")
    met = links.join(hubs, "u").select("u", "v", "m").unionByName(others.select("u", "v", "m"))
    if large:
        out = met.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        out = met.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(low.select("u", F.col("m").alias("v")))
    return out.where("v < u").distinct()


def connected_components(edges: DataFrame, name: str = "components", max_rounds: int = 60) -> DataFrame:
    """(node, component) for every node of an edge; the component is its smallest node.

    ``edges`` has two columns of one orderable type. Null ends and loops are ignored;
    repeated edges count once. An empty table gives an empty result. Each round is
    written to the shared folder; at the fixed point the graph is a set of stars.
    """
    a, b = edges.columns[:2]
    pairs = edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v"))
    pairs = pairs.where(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col("v") < F.col("u"))).distinct()
    pairs = stored(pairs, f"{name}-0")

    def state(df: DataFrame) -> tuple:
        return tuple(df.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())

    before = state(pairs)
    for k in range(max_rounds):
        if not before[0]:
            break
        pairs = stored(_star(_star(pairs, True, before[0]), False, before[0]), f"{name}-{k + 1}")
        after = state(pairs)
        if after == before:
            break
        before = after
    else:
        raise RuntimeError("connected components did not settle")
    roots = pairs.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return pairs.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots)

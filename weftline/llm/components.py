"""Connected components of a distributed edge table.

Alternates the large-star and small-star steps, which point every node at a smaller neighbour until each component is
a star around its least node. A node's neighbours are only ever reduced to their minimum, by a partial aggregate, so
a node with very many of them needs no task that holds them all. Each round is cut in the shared folder. A table of at most ONE_TASK edges,
which is counted first, is settled by one task instead.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut


ONE_TASK = 500_000  # edges, 16 bytes each


def _stars(batches):
    """(node, its component) of all edges that the batches hold together."""
    parent: dict = {}

    def root(x):
        while (p := parent.setdefault(x, x)) != x:
            parent[x] = parent[p]
            x = parent[x]
        return x

    for pdf in batches:
        for u, v in zip(pdf["u"].tolist(), pdf["v"].tolist()):
            a, b = root(u), root(v)
            if a != b:
                parent[max(a, b)] = min(a, b)
    nodes = list(parent)
    yield pd.DataFrame({"node": np.array(nodes, dtype="int64"), "component": np.array([root(x) for x in nodes], dtype="int64")})


def _forest(batches):
    """A spanning forest of the edges that one task sees, batch by batch: never more rows than came in."""
    for pdf in batches:
        parent: dict = {}

        def root(x):
            while (p := parent.setdefault(x, x)) != x:
                parent[x] = parent[p]
                x = parent[x]
            return x

        for u, v in zip(pdf["u"].tolist(), pdf["v"].tolist()):
            a, b = root(u), root(v)
            if a != b:
                parent[max(a, b)] = min(a, b)
        nodes = [x for x in parent if root(x) != x]
        yield pd.DataFrame({"u": np.array(nodes, dtype="int64"), "v": np.array([root(x) for x in nodes], dtype="int64")})


def components(edges: DataFrame, a: str = "a", b: str = "b", rounds: int = 50, one_task: int | None = None) -> DataFrame:
    """(node, component) for every node that has an edge; the component is its least node. Nodes are longs."""
    e = edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u <> v")
    e = cut(e.mapInPandas(_forest, "u long, v long").distinct())
    if e.limit((one_task := ONE_TASK if one_task is None else one_task) + 1).count() <= one_task:
        return cut(e.coalesce(1).mapInPandas(_stars, "node long, component long"))
    for _ in range(rounds):
        # large-star: every neighbour above u, and u, point at the least of u and its neighbours
        both = e.select("u", "v").union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        # small-star: every neighbour not above u, and u, point at the least of them
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct("u", F.col("m").alias("v")))).alias("x"))
        new = cut(small.select("x.u", "x.v").where("u <> v").distinct())
        # stars: no node has two parents and no parent has a parent
        roles = new.select(F.col("u").alias("x"), F.col("v").alias("p"), F.lit(1).alias("below")).union(new.select(F.col("v"), F.lit(None).cast("long"), F.lit(0)))
        seen = roles.groupBy("x").agg(F.min("p").alias("p0"), F.max("p").alias("p1"), F.min("below").alias("b0"), F.max("below").alias("b1"))
        done = seen.where("p0 < p1 OR b0 < b1").isEmpty()
        e = new
        if done:
            break
    else:
        raise RuntimeError(f"components didn't settle in {rounds} rounds")
    return e.select(F.col("u").alias("node"), F.col("v").alias("component")).union(e.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())

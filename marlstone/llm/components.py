"""Connected components of a distributed edge table.

Alternating large-star and small-star rounds (logarithmic in practice), each a
grouped minimum and a join. Where a node has over ``HUB`` edges the joins are
dealt over salts, so neither a hub nor a huge component meets in one task. Before
the rounds repeated edges are dropped and each partition replaces its edges
by a spanning forest of them, which only shortens the table; up to ``ONE_TASK``
edges that are left are finished in one task.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marlstone.llm.common import fanout_join, materialise


HUB, ONE_TASK, FOREST = 20_000, 200_000, 200_000


class UnionFind:
    """Sets of the numbers 0 .. n-1; the smallest is the root."""

    def __init__(self, n: int) -> None:
        self.parent, self.sets = list(range(n)), n

    def find(self, i: int) -> int:
        parent = self.parent
        while parent[i] != i:
            parent[i] = i = parent[parent[i]]
        return i

    def union(self, i: int, j: int) -> bool:
        i, j = self.find(i), self.find(j)
        if i == j:
            return False
        self.parent[max(i, j)] = min(i, j)
        self.sets -= 1
        return True


def gathered(batches, rows: int):
    """Batches put together until they have so many rows."""
    held, n = [], 0
    for pdf in batches:
        held.append(pdf)
        n += len(pdf)
        if n >= rows:
            yield pd.concat(held, ignore_index=True)
            held, n = [], 0
    if n:
        yield pd.concat(held, ignore_index=True)


def _forest(batches):
    """Edges to the least node of each component, of about FOREST edges at a time."""
    for pdf in gathered(batches, FOREST):
        ids, ends = np.unique(pdf[["a", "b"]].to_numpy().ravel(), return_inverse=True)
        ends = ends.reshape(-1, 2)
        found = UnionFind(len(ids))
        for i, j in ends.tolist():
            found.union(i, j)
        root = np.fromiter((found.find(i) for i in range(len(ids))), np.int64, len(ids))
        moved = root != np.arange(len(ids))
        yield pd.DataFrame({"a": ids[moved], "b": ids[root[moved]]})


def _whole(batches):
    """(id, component) of all nodes of one task's edges."""
    pairs = np.concatenate([np.zeros((0, 2), np.int64), *(pdf[["a", "b"]].to_numpy(np.int64) for pdf in batches)])
    ids, ends = np.unique(pairs.ravel(), return_inverse=True)
    found = UnionFind(len(ids))
    for i, j in ends.reshape(-1, 2).tolist():
        found.union(i, j)
    root = np.fromiter((found.find(i) for i in range(len(ids))), np.int64, len(ids))
    yield pd.DataFrame({"id": ids, "component": ids[root]})


def _both(edges: DataFrame) -> DataFrame:
    return edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))


def _star(edges: DataFrame, large: bool, hubs: bool) -> DataFrame:
    """One large-star or small-star step over edges (a, b), b < a."""
    near = _both(edges) if large else edges
    least = near.groupBy("a").agg(F.min("b").alias("m")).withColumn("m", F.least("a", "m"))
    met = fanout_join(near, least, "a", F.col("b"), "inner") if hubs else near.join(least, "a")
    if large:
        out = met.where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    else:
        out = met.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(least.select("a", F.col("m").alias("b")))
    return out.where("a <> b").distinct()


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(id, component): the least id reachable, for every id that has an edge to another."""
    pairs = edges.select(F.greatest(a, b).cast("long").alias("a"), F.least(a, b).cast("long").alias("b")).where("a <> b")
    state = materialise(pairs.distinct().mapInPandas(_forest, "a long, b long").distinct(), "edges")
    if state.count() <= ONE_TASK:
        return materialise(state.coalesce(1).mapInPandas(_whole, "id long, component long"), "components")
    mark = F.xxhash64("a", "b").cast("decimal(38,0)")
    before = None
    while True:
        now = state.agg(F.count("*"), F.sum(mark)).first()
        if now == before or not now[0]:
            return state.select(F.col("a").alias("id"), F.col("b").alias("component")).unionByName(state.select(F.col("b").alias("id"), F.col("b").alias("component")).distinct())
        before = now
        # Neither step gives a node more edges to smaller ones than it has neighbours now.
        degree = _both(state).groupBy("a").agg(F.count("*").alias("n")).agg(F.max("n")).first()[0]
        state = materialise(_star(_star(state, True, degree > HUB), False, degree > HUB), "edges")

"""Connected components of an undirected edge table, with no edge or label on the driver."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from silvae.llm.store import drop, materialize

_EDGES = "u long, v long"
#: Edges that a task holds at once.
FOREST = 20_000


def _tree(u: list[int], v: list[int]) -> pa.RecordBatch:
    """(node, smallest node of its tree) of some edges, by union-find."""
    up: dict[int, int] = {}

    def root(x: int) -> int:
        while (p := up.setdefault(x, x)) != x:
            up[x] = up[p]
            x = up[x]
        return x

    for a, b in zip(u, v, strict=True):
        a, b = root(a), root(b)
        if a != b:
            up[max(a, b)] = min(a, b)
    nodes = np.array(list(up), dtype=np.int64)
    roots = np.array([root(x) for x in up], dtype=np.int64)
    keep = nodes != roots
    return pa.RecordBatch.from_arrays([pa.array(nodes[keep]), pa.array(roots[keep])], ["u", "v"])


def _forest(batches):
    """The edges of a partition as trees, FOREST edges at a time."""
    u: list[int] = []
    v: list[int] = []
    for batch in batches:
        u += batch.column(0).to_pylist()
        v += batch.column(1).to_pylist()
        if len(u) >= FOREST:
            yield _tree(u, v)
            u, v = [], []
    yield _tree(u, v)


def components(edges: DataFrame, a: str = "a", b: str = "b", rounds: int = 60) -> DataFrame:
    """(node, component) for each node that has an edge; component is the smallest node reachable.

    Alternates the two star operations: neighbours above a node are hung on the smallest node
    around it, then those below. Joins read written tables on both sides, so that adaptive
    execution can split a node with very many edges. Fewer than FOREST edges are put together by one
    task. Edges with a null end and loops are ignored.
    """
    e = edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where(f"{a} is not null and {b} is not null and {a} <> {b}")
    e = materialize(e.mapInArrow(_forest, _EDGES).distinct(), "edges")
    before = None
    for _ in range(rounds):
        now = e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == before or not now[0]:
            break
        if now[0] < FOREST:
            # no more than a task holds at once: one tree of each component, and nothing is left to do
            old, e = e, materialize(e.coalesce(1).mapInArrow(_forest, _EDGES), "edges")
            drop(old)
            break
        before = now
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = materialize(both.groupBy("u").agg(F.min("v").alias("m")), "least")
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.least("u", "m").alias("v"))
        large = materialize(large.distinct(), "large")
        low = materialize(large.groupBy("u").agg(F.min("v").alias("m")), "low")
        small = large.join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        small = small.unionByName(low.select("u", F.col("m").alias("v"))).mapInArrow(_forest, _EDGES).distinct()
        old, e = e, materialize(small, "edges")
        for x in (old, least, large, low):
            drop(x)
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    leaves = e.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return leaves.unionByName(e.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())

"""Connected components of an edge table by repeated contraction, entirely in Spark."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, checked


#: Edges (16 bytes each) that one task contracts; more take rounds over all tasks.
FEW = 200_000


def _contracted(batches):
    """Union-find over all edges of one bounded partition."""
    root: dict[int, int] = {}

    def top(v):
        root.setdefault(v, v)
        while root[v] != v:
            root[v] = v = root[root[v]]
        return v

    for batch in batches:
        for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            x, y = top(a), top(b)
            root[max(x, y)] = min(x, y)
    ids = list(root)
    yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array([top(v) for v in ids], pa.int64())], names=["id", "component"])


def components(edges: DataFrame, scratch: Scratch, few: int = FEW) -> DataFrame:
    """(id, component) for every vertex of ``edges`` (a, b): component is its smallest reachable id.

    Up to ``few`` distinct edges are contracted in one task, with the same result as below.

    Each round hooks every vertex that has a smaller neighbour onto the smallest one, flattens the
    resulting trees by pointer jumping, and contracts the edges to roots. What is left shrinks at least
    by half each round, so the number of rounds is logarithmic. Every table is written to the shared
    folder: a lost executor costs a re-read.
    """
    a, b = F.least("a", "b"), F.greatest("a", "b")
    work = scratch.keep(edges.select(a.alias("a"), b.alias("b")).filter("a < b").distinct(), "edges")
    if work.count() <= few:
        labels = scratch.keep(work.select(F.col("a").cast("long"), F.col("b").cast("long")).coalesce(1).mapInArrow(_contracted, "id long, component long"), "labels")
        scratch.drop(work)
        return labels
    labels = scratch.keep(work.select(F.col("a").alias("id")).union(work.select("b")).distinct().select("id", F.col("id").alias("component")), "labels")
    while not work.isEmpty():
        hook = scratch.keep(work.groupBy(F.col("b").alias("id")).agg(F.min("a").alias("to")), "hook")
        while True:
            up = checked(hook.select(F.col("id").alias("to"), F.col("to").alias("up")))
            jumped = scratch.keep(hook.join(up, "to", "left").select("id", F.coalesce("up", "to").alias("to"), F.col("up").isNotNull().alias("moved")), "jump")
            scratch.drop(hook)
            hook = jumped.drop("moved")
            hook._scratch = jumped._scratch
            if jumped.filter("moved").isEmpty():
                break
        n = hook.count()
        to = lambda c: checked(hook.select(F.col("id").alias(c), F.col("to").alias(f"{c}_to")), n)
        new_labels = scratch.keep(labels.join(to("component"), "component", "left").select("id", F.coalesce("component_to", "component").alias("component")), "labels")
        moved = work.join(to("a"), "a", "left").join(to("b"), "b", "left").select(F.coalesce("a_to", "a").alias("x"), F.coalesce("b_to", "b").alias("y"))
        new_work = scratch.keep(moved.filter("x <> y").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct(), "edges")
        scratch.drop(work, labels, hook)
        work, labels = new_work, new_labels
    scratch.drop(work)
    return labels

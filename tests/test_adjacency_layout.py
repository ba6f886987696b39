"""The layout of edges by node: computed once, exchanged nowhere, read by frontier, ends tested where they are met."""

import random

from pyspark.sql import functions as F
from strataflow.operators import traverse
from strataflow.operators.adjacency import Adjacency, both_ways

from .test_segments import rows_read


def test_edges_are_computed_once_for_both_ways(spark):
    n = spark.range(50)
    edges = n.select(F.col("id").cast("string").alias("source_id"), (F.col("id") * 7 % 50).cast("string").alias("target_id"), F.lit("calls").alias("relation")).union(spark.createDataFrame([(None, "1", "calls"), ("1", None, "calls")], "source_id string, target_id string, relation string"))
    rows = both_ways(edges)
    assert rows._jdf.queryExecution().executedPlan().toString().count("Range (") == 1
    got = sorted(map(tuple, rows.collect()), key=str)
    want = []
    for s, t, r in edges.collect():
        want.append((s, "loop" if s is not None and s == t else "out", t, s, t, r))
        if None not in (s, t) and s != t:
            want.append((t, "in", s, s, t, r))
    assert got == sorted(want, key=str)


def test_built_tables_are_walked_as_the_scan_is(spark):
    r = random.Random(4)
    names = [f"n{i:02d}" for i in range(40)]
    nodes = spark.createDataFrame([(x,) for x in names], "node_id string")
    edges = spark.createDataFrame(sorted({(r.choice([*names, "gone"]), r.choice([*names, "absent"]), r.choice(["calls", "uses"])) for _ in range(120)}), "source_id string, target_id string, relation string")
    a = Adjacency.build(nodes, edges)
    assert a.rows.count() == 2 * edges.count() - edges.filter("source_id = target_id").count()
    for relations, most in ((None, 100), (["calls"], 9)):
        want = traverse.traverse(nodes, edges, ["n01"], "both", relations, 3, most)
        got = traverse.traverse_indexed(a, ["n01"], "both", relations, 3, most)
        assert (got.nodes, got.edges, got.truncated, got.levels) == (want.nodes, want.edges, want.truncated, want.levels)
        again = traverse.walk_from_each(a, ["n01", "n02"], "both", relations, 3, most)["n01"]
        assert (again.nodes, again.edges, sorted(again.truncated), again.levels) == (want.nodes, want.edges, sorted(want.truncated), want.levels)


def test_a_long_frontier_reads_its_rows_only(spark, tmp_path):
    n = 60_000
    ids = spark.range(n).select(F.format_string("n%06d", "id").alias("node_id"))
    edges = ids.select(F.col("node_id").alias("source_id"), F.reverse("node_id").alias("target_id"), F.lit("calls").alias("relation"))
    a = Adjacency.build(ids, edges, f"file://{tmp_path}/adj")
    frontier = [f"n{i:06d}" for i in (*range(6), *range(n - 6, n))]
    assert a.at(frontier, "outgoing").count() == 12
    assert rows_read(a.at(frontier, "outgoing")) < 2 * n * 0.7

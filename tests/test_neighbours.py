"""The k-nearest-vectors join, and traversals from many starts at once."""

import random

import numpy as np
import pytest
from strataflow.operators import traverse
from strataflow.operators.adjacency import Adjacency, both_ways
from strataflow.operators.neighbours import compared, knn_join


def brute(queries, rows, k):
    out = set()
    for q, v in queries:
        near = sorted((round(float(np.linalg.norm(np.array(v) - np.array(w))), 5), i) for i, w in rows if len(w) == len(v))[:k]
        out |= {(q, i, d) for d, i in near}
    return out


@pytest.mark.parametrize("cluster", [15, 60, 10_000])
def test_join_equals_brute_force(spark, cluster):
    r = np.random.default_rng(1)
    centres = r.normal(size=(6, 4)) * 5
    rows = [(i, np.round(centres[i % 6] + r.normal(size=4) * 0.3, 3).tolist()) for i in range(240)] + [(500 + i, [1.0, 1.0, 1.0, 1.0]) for i in range(12)] + [(600, [1.0, 2.0])]
    queries = [(i, v) for i, v in rows if i % 20 == 0] + [(9000, [0.0, 0.0])]
    frame = lambda some, name: spark.createDataFrame(some, f"{name} long, vector array<double>")
    got = {(x["query_id"], x["id"], x["distance"]) for x in knn_join(frame(queries, "query_id"), frame(rows, "id"), 5, cluster, 5).collect()}
    assert got == brute(queries, rows, 5)


def test_clusters_are_skipped(spark):
    r = np.random.default_rng(2)
    rows = [(i, (np.array([i % 8, 0, 0]) * 20 + r.normal(size=3)).tolist()) for i in range(800)]
    df = spark.createDataFrame(rows, "id long, vector array<double>")
    queries = df.filter("id % 100 = 0").selectExpr("id as query_id", "vector")
    assert compared(queries, df, 5, 40) < 0.5


@pytest.mark.parametrize("direction", ["outgoing", "incoming", "both"])
def test_walks_from_each_equal_single_walks(spark, direction):
    r = random.Random(3)
    names = [f"n{i:02d}" for i in range(40)]
    edges = spark.createDataFrame(sorted({(r.choice(names), r.choice(names), r.choice(["calls", "uses"])) for _ in range(110)}), "source_id string, target_id string, relation string")
    a = Adjacency(both_ways(edges).cache())
    starts = ["n01", "n02", "n07", "n30"]
    for relations, depth, most in ((None, 3, 100), (["calls"], 4, 9), (None, 1, 1), (None, 2, 5)):
        walks = traverse.walk_from_each(a, starts, direction, relations, depth, most)
        for s in starts:
            want, got = traverse.traverse_indexed(a, [s], direction, relations, depth, most), walks[s]
            assert (got.nodes, got.edges, sorted(got.truncated), got.levels) == (want.nodes, want.edges, sorted(want.truncated), want.levels)

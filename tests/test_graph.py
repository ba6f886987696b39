"""Graph operators against a sequential model and micro fixtures."""

import random

import pytest

from strataflow.operators import traverse as T


def frames(spark, ids, edges):
    n = spark.createDataFrame([(i,) for i in ids], "node_id string")
    return n, spark.createDataFrame([tuple(e) for e in edges] or [], "source_id string, target_id string, relation string")


def model(ids, edges, starts, direction, max_depth, max_nodes, scope=None):
    """The sequential algorithm: a queue, one frontier node and one sorted edge at a time."""
    nodes, truncated, boundary = [], set(), None
    starts = sorted(s for s in set(starts) if s in ids)
    if len(starts) > max_nodes:
        return starts[:max_nodes], set(), {"node_limit"}, None
    selected, out_edges, frontier = list(starts), set(), list(starts)
    neighbour = lambda cur, e: e[1] if direction != "incoming" and e[0] == cur else e[0] if direction != "outgoing" and e[1] == cur else None
    for _ in range(max_depth):
        following = []
        for cur in frontier:
            for e in sorted(edges):
                to = neighbour(cur, e)
                if to is None or to not in ids:
                    continue
                outside = scope is not None and to not in scope
                if outside:
                    boundary = boundary or to
                    if len(selected) >= max_nodes and (to not in selected or True):
                        if len(selected) >= max_nodes and to not in selected or len(selected) >= max_nodes:
                            truncated.add("node_limit")
                            continue
                if to not in selected:
                    if len(selected) >= max_nodes:
                        truncated.add("node_limit")
                        continue
                    selected.append(to)
                    if not outside:
                        following.append(to)
                out_edges.add(e)
        frontier = sorted(following)
        if not frontier:
            break
    if frontier and any((to := neighbour(cur, e)) is not None and to not in selected for cur in frontier for e in edges):
        truncated.add("depth_limit")
    return selected, out_edges, truncated, boundary


@pytest.mark.parametrize("seed", range(6))
def test_traverse_equals_sequential_model(spark, seed):
    rng = random.Random(seed)
    ids = [f"n{i}" for i in range(8)]
    edges = sorted({(rng.choice(ids + ["ghost"]), rng.choice(ids), rng.choice("rs")) for _ in range(14)})
    direction, depth, limit = rng.choice(["outgoing", "incoming", "both"]), rng.randint(1, 3), rng.randint(2, 6)
    n, e = frames(spark, ids, edges)
    got = T.traverse(n, e, ["n0"], direction, None, depth, limit)
    nodes, kept, why, _ = model(set(ids), edges, ["n0"], direction, depth, limit)
    assert sorted(got.nodes) == sorted(nodes)
    assert set(got.edges) == {x for x in kept if x[0] in nodes and x[1] in nodes}
    assert set(got.truncated) == why


def test_star_keeps_first_leaves(spark):
    n, e = frames(spark, ["c", *[f"l{i}" for i in range(5)]], [("c", f"l{i}", "r") for i in range(5)])
    t = T.traverse(n, e, ["c"], "outgoing", None, 2, 3)
    assert t.nodes == ["c", "l0", "l1"] and t.truncated == ["node_limit"]


def test_chain_depth_limit(spark):
    n, e = frames(spark, list("abcd"), [("a", "b", "r"), ("b", "c", "r"), ("c", "d", "r")])
    assert T.traverse(n, e, ["a"], "outgoing", None, 2).truncated == ["depth_limit"]
    n, e = frames(spark, list("abc"), [("a", "b", "r"), ("b", "c", "r")])
    assert T.traverse(n, e, ["a"], "outgoing", None, 2).truncated == []


def test_cycle_ends_and_dangling_edge_is_skipped(spark):
    n, e = frames(spark, list("abc"), [("a", "b", "r"), ("b", "c", "r"), ("c", "a", "r"), ("a", "zz", "r")])
    t = T.traverse(n, e, ["a"], "outgoing", None, 9)
    assert t.nodes == ["a", "b", "c"] and ("a", "zz", "r") not in t.edges


def test_scope_boundary_is_not_expanded(spark):
    n, e = frames(spark, list("abxy"), [("a", "b", "r"), ("a", "x", "r"), ("x", "y", "r")])
    scope = spark.createDataFrame([("a",), ("b",)], "node_id string")
    t = T.traverse(n, e, ["a"], "outgoing", None, 5, scope=scope)
    assert t.nodes == ["a", "b", "x"] and t.scope_boundary == "x"
    with pytest.raises(ValueError):
        T.traverse(n, e, ["y"], "outgoing", scope=scope)


def test_diamond_path_ties_by_edge_key(spark):
    n, e = frames(spark, list("abcd"), [("a", "c", "r"), ("c", "d", "r"), ("a", "b", "r"), ("b", "d", "r")])
    t = T.traverse(n, e, ["a"], "outgoing", None, 3)
    assert T.path_between(t, "a", "d") == [("a", "b", "r"), ("b", "d", "r")]
    rows = {r["node_id"]: r["path"] for r in T.shortest_paths(n, e, spark.createDataFrame([("a",)], "node_id string"), 3).collect()}
    assert rows["d"] == ["a|b|r", "b|d|r"]
    assert T.path_between(t, "d", "a") is None
    assert T.path_between(T.traverse(n, e, ["d"], "both", None, 3), "d", "a", True)[0] == ("b", "d", "r")

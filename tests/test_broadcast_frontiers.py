"""Few bindings and small frontiers are broadcast, so that uses, edges and nodes are not shuffled into one hot task."""

import pytest
from strataflow.operators import evidence, resolve, traverse

EDGES = [(f"n{i}", f"n{(i * 7 + j) % 50}", "calls") for i in range(50) for j in range(4)] + [("n1", "gone", "calls")]


@pytest.fixture
def measured_only(spark):
    """Only hints broadcast, as where statistics are unknown or too large."""
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield spark
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def graph(spark):
    nodes = spark.createDataFrame([(f"n{i % 50}",) for i in range(60)], "node_id string")  # ten ids twice
    return nodes, spark.createDataFrame(EDGES, "source_id string, target_id string, relation string")


def test_uses_of_one_binding(measured_only):
    spark = measured_only
    uses = spark.createDataFrame([(f"c{i}", f"ns.{i % 3}", "", "calls", "f") for i in range(30)], "source_id string, target string, receiver string, relation string, source_path string")
    bindings = spark.createDataFrame([("f", "ns", "*", "g")], "source_path string, local string, imported string, target_path string")
    shown = spark.createDataFrame([("g", str(i), f"class:{i}") for i in range(2)], "path string, name string, node_id string")
    found = resolve.bound_targets(uses, bindings, shown)
    assert "BroadcastHashJoin" in plan(found)
    assert {(r["source_id"], r["target_id"]) for r in found.collect()} == {(f"c{i}", f"class:{i % 3}") for i in range(30) if i % 3 < 2}


def test_hops_of_reach_and_traverse(measured_only, monkeypatch):
    spark, plans, cut = measured_only, [], traverse.cut
    nodes, edges = graph(spark)
    monkeypatch.setattr(traverse, "cut", lambda df: plans.append(plan(df)) or cut(df))
    starts = spark.createDataFrame([("n3",)], "node_id string")
    got = {r["node_id"]: r["distance"] for r in traverse.reach(nodes, edges, starts, "outgoing", None, 2).collect()}
    level, seen = {"n3"}, {"n3": 0}
    for d in (1, 2):
        level = {t for s, t, _ in EDGES if s in level and t != "gone"} - set(seen)
        seen |= dict.fromkeys(level, d)
    assert got == seen and len(got) == len(seen)
    hops = [p for p in plans if "source_id" in p]
    assert hops and all("BroadcastHashJoin" in p for p in hops)
    plans.clear()
    walk = traverse.traverse(nodes, edges, ["n1"], "outgoing", None, 1, 40)
    assert "gone" not in walk.nodes and set(walk.nodes) == {"n1", *(t for s, t, _ in EDGES if s == "n1" and t != "gone")}
    assert not any("SortMergeJoin" in p for p in plans) and plans  # the nodes are read, not shuffled


def test_impact_of_repeated_nodes(measured_only):
    nodes, edges = graph(measured_only)
    starts = measured_only.createDataFrame([("n3",)], "node_id string")
    found = [r["node_id"] for r in evidence.impact(nodes, edges, starts, 2, ["calls"]).collect()]
    assert found and len(found) == len(set(found))

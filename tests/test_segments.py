"""Segments of stored tables, the lexical and adjacency indexes on them, and safe commits."""

import random

import pytest
from pyspark.sql import functions as F
from strataflow.functions.text import bm25
from strataflow.operators import traverse
from strataflow.operators.adjacency import Adjacency, both_ways
from strataflow.plans.engine import WEIGHTS, search_fields
from strataflow.plans.lexical import POSTINGS, TOTALS, LexicalIndex, segment
from strataflow.sources.store import Store, StoreError

NODES = "source_path string, node_id string, kind string, label string, qualified_name string"
WORDS = ["alpha", "beta", "gammaRay", "delta", "blueSteel", "widget"]


def sources(spark, paths, deleted=()):
    return spark.createDataFrame([(p, False) for p in paths] + [(p, True) for p in deleted], "source_path string, deleted boolean")


def indexed(spark, store, rows, deleted=()):
    """Publish with a segment of the lexical index."""
    nodes = spark.createDataFrame(rows, NODES).coalesce(1)
    named = nodes.withColumn("span_path", F.col("source_path"))
    written = sources(spark, sorted({r[0] for r in rows}), deleted)
    return store.publish({"nodes": nodes}, written, segment(named, search_fields()), replaced_owners=written.select("source_path"))


def test_search_over_many_segments_equals_a_rebuild(spark, tmp_path):
    r = random.Random(2)
    store = Store(spark, f"file://{tmp_path}/s", retained=5, merge_after=6)
    def rows(p):
        return [(p, f"{p}#{k}", "typescript:class", r.choice(WORDS), f"{r.choice(WORDS)}.{r.choice(WORDS)}") for k in range(r.randint(1, 3))] + [(p, "shared", "file", "alpha", f"in {p}")]

    indexed(spark, store, [x for p in ("a", "b", "c", "d", "e") for x in rows(p)])
    for k in range(9):
        gone = ["e"] if k == 4 else []
        indexed(spark, store, rows(r.choice("abcd")), gone)
    v = store.manifest().latest()
    live = store.rows("nodes", v).withColumn("span_path", F.col("source_path"))
    assert live.filter("source_path = 'e'").isEmpty()
    groups = [["alph"], ["gamma", "ray"], ["beta"]]
    want = {(x["node_id"], round(x["score"], 9)) for x in bm25(live, "node_id", search_fields(), WEIGHTS, groups).groupBy("node_id").agg(F.max("score").alias("score")).collect()}
    got = {(x["node_id"], round(x["score"], 9)) for x in LexicalIndex.stored(store, v).search(WEIGHTS, groups).collect()}
    assert want == got and len(want) > 3
    parts = store.manifest().parts()
    assert any("merged" in x for x in store.manifest().versions) and len(parts) <= 14
    # a publish writes postings of its own sources only
    own = store.spark.read.parquet(f"{store.root}/parts/{store.manifest().versions[-1]['part']['folder']}/ws_{POSTINGS}")
    assert own.select("source_path").distinct().count() == 1


def test_versions_see_their_own_segments(spark, tmp_path):
    store = Store(spark, f"file://{tmp_path}/s", merge_after=1)
    indexed(spark, store, [("a", "a1", "file", "alpha", "x"), ("b", "b1", "file", "beta", "y")])
    indexed(spark, store, [("a", "a2", "file", "delta", "x")])
    indexed(spark, store, [("c", "c1", "file", "alpha", "z")], ["b"])
    found = lambda v, t: sorted(x["node_id"] for x in LexicalIndex.stored(store, v).search(WEIGHTS, [[t]]).collect())
    assert [found(v, "alpha") for v in (1, 2, 3)] == [["a1"], [], ["c1"]] and [found(v, "beta") for v in (1, 2, 3)] == [["b1"], ["b1"], []]
    assert store.workspace(TOTALS, 3).agg(F.sum("documents")).first()[0] == 2
    store.rollback(2)
    assert found(2, "delta") == ["a2"]


def test_reads_do_not_shuffle_facts(spark, tmp_path):
    """Masks are filters or broadcast: neither a version's nodes nor its postings are exchanged."""
    store = Store(spark, f"file://{tmp_path}/s")
    indexed(spark, store, [("a", "a1", "file", "alpha", "x"), ("b", "b1", "file", "beta", "y")])
    indexed(spark, store, [("a", "a2", "file", "delta", "x")])
    for rows in (store.rows("nodes", 2), store.workspace(POSTINGS, 2), store.contributions("nodes", 2)):
        plan = rows._jdf.queryExecution().executedPlan().toString()
        facts = [line for line in plan.splitlines() if "SortMergeJoin" in line or "ShuffledHashJoin" in line]
        assert not facts


@pytest.mark.parametrize("few, most", [(1000, 1000), (0, 1000), (0, 0)])
def test_masks_of_any_size_show_the_same(spark, tmp_path, monkeypatch, few, most):
    from strataflow.sources import store as module

    monkeypatch.setattr(module, "FEW_MASKED", few)
    monkeypatch.setattr(module, "MASK_ROWS", most)
    store = Store(spark, f"file://{tmp_path}/s")
    indexed(spark, store, [(p, f"{p}1", "file", "alpha", "x") for p in "abc"])
    indexed(spark, store, [("a", "a2", "file", "delta", "x")], ["c"])
    indexed(spark, store, [("a", "a3", "file", "delta", "x"), ("c", "c3", "file", "delta", "x")])
    shown = lambda v: sorted(x["node_id"] for x in store.rows("nodes", v).collect())
    assert [shown(v) for v in (1, 2, 3)] == [["a1", "b1", "c1"], ["a2", "b1"], ["a3", "b1", "c3"]]


def test_an_interrupt_after_the_commit_keeps_the_part(spark, tmp_path, monkeypatch):
    store = Store(spark, f"file://{tmp_path}/s")
    indexed(spark, store, [("a", "a1", "file", "alpha", "x")])
    commit = Store._commit

    def late(self, *a):
        commit(self, *a)
        raise KeyboardInterrupt

    with monkeypatch.context() as m:
        m.setattr(Store, "_commit", late)
        with pytest.raises(KeyboardInterrupt):
            indexed(spark, store, [("a", "a2", "file", "alpha", "x")])
    assert store.manifest().latest() == 2 and [x["node_id"] for x in store.rows("nodes", 2).collect()] == ["a2"]


def test_create_only_if_absent(spark, tmp_path):
    store = Store(spark, f"file://{tmp_path}/s")
    store.create("manifests/x.lock", b"one")
    with pytest.raises(StoreError, match="conflict"):
        store.create("manifests/x.lock", b"two")
    assert (tmp_path / "s/manifests/x.lock").read_bytes() == b"one"


def rows_read(df):
    """Rows that the scans of a plan without exchange put out."""
    df.collect()
    plan = df._jdf.queryExecution().executedPlan()
    leaves, n = plan.collectLeaves(), 0
    for i in range(leaves.size()):
        metric = leaves.apply(i).metrics().get("numOutputRows")
        n += metric.get().value() if metric.isDefined() else 0
    return n


def test_a_hop_reads_its_frontier_only(spark, tmp_path):
    n = 60_000
    ids = spark.range(n)
    nodes = ids.select(F.format_string("n%06d", "id").alias("node_id"))
    edges = ids.select(F.format_string("n%06d", "id").alias("source_id"), F.format_string("n%06d", (F.col("id") * 7 + 1) % n).alias("target_id"), F.lit("calls").alias("relation"))
    spark.conf.set("spark.sql.shuffle.partitions", "16")
    try:
        a = Adjacency.build(nodes, edges, f"file://{tmp_path}/adj")
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    hop = a.at(["n000005"], "outgoing")
    assert [x["to_id"] for x in hop.collect()] == ["n000036"]
    assert rows_read(a.at(["n000005"], "outgoing")) < 2 * n / 8
    assert a.rows.count() == 2 * n - edges.filter("source_id = target_id").count()


@pytest.mark.parametrize("direction", ["outgoing", "incoming", "both"])
def test_indexed_traversal_equals_the_scan(spark, direction):
    r = random.Random(9)
    names = [f"n{i:02d}" for i in range(40)]
    nodes = spark.createDataFrame([(x,) for x in names], "node_id string")
    edges = spark.createDataFrame(sorted({(r.choice(names), r.choice([*names, "absent"]), r.choice(["calls", "uses"])) for _ in range(110)}), "source_id string, target_id string, relation string")
    a = Adjacency(both_ways(edges.filter("target_id <> 'absent'")).cache())
    for starts, relations, depth, most in ((["n01"], None, 3, 100), (["n03", "n02"], ["calls"], 4, 12), (["n05"], None, 2, 5), (["n07"], ["uses"], 1, 1)):
        want = traverse.traverse(nodes, edges, starts, direction, relations, depth, most)
        got = traverse.traverse_indexed(a, starts, direction, relations, depth, most)
        assert (got.nodes, got.edges, got.truncated, got.levels) == (want.nodes, want.edges, want.truncated, want.levels)

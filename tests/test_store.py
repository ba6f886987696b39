import pytest

from strataflow.sources.store import Session, Store, StoreError

NODES = "source_path string, node_id string"
EDGES = "source_id string, target_id string, relation string, owner string"


def publish(spark, store, rows, deleted=(), **more):
    sources = sorted({r[0] for r in rows})
    written = spark.createDataFrame([(s, False) for s in sources] + [(d, True) for d in deleted], "source_path string, deleted boolean")
    return store.publish({"nodes": spark.createDataFrame(rows, NODES)}, written, **more)


def at(store, version):
    return sorted((r["source_path"], r["node_id"]) for r in store.contributions("nodes", version).collect())


def test_versions_rollback_and_full_index(spark, tmp_path):
    s = Store(spark, f"file://{tmp_path}")
    with pytest.raises(StoreError, match="workspace not found"):
        s.manifest().latest()
    assert publish(spark, s, [("a", "a1"), ("b", "b1")]) == 1
    assert publish(spark, s, [("a", "a2")]) == 2
    assert at(s, 1) == [("a", "a1"), ("b", "b1")] and at(s, 2) == [("a", "a2"), ("b", "b1")]
    publish(spark, s, [("a", "a3")], full=True)
    assert at(s, 3) == [("a", "a3")]
    s.rollback(2)
    assert at(s, 2) == [("a", "a2"), ("b", "b1")] and s.manifest().latest() == 2
    publish(spark, s, [("c", "c1")], deleted=["b"])
    assert at(s, 4) == [("a", "a2"), ("c", "c1")]
    with pytest.raises(StoreError, match="version not found"):
        at(s, 3)
    assert s.prune(4) == 2
    with pytest.raises(StoreError, match="pruned"):
        at(s, 1)
    assert at(s, 4) == [("a", "a2"), ("c", "c1")]


def test_retention_budget_and_retained_edges(spark, tmp_path):
    s = Store(spark, f"file://{tmp_path}/r", retained=2)
    edges = lambda *rows: spark.createDataFrame(list(rows) or [], EDGES)
    publish(spark, s, [("a", "a1")], workspace={"edges": edges(("x", "y", "r", "a"), ("p", "q", "r", "b"))})
    owners = spark.createDataFrame([("a",)], "source_path string")
    publish(spark, s, [("a", "a2")], workspace={"edges": edges(("x", "z", "r", "a"))}, replaced_owners=owners)
    assert sorted(r["target_id"] for r in s.workspace("edges", 2).collect()) == ["q", "z"]
    publish(spark, s, [("a", "a3")])
    assert [v["version"] for v in s.manifest().versions] == [2, 3]
    with pytest.raises(StoreError, match="budget"):
        publish(spark, Store(spark, f"file://{tmp_path}/b", byte_budget=10), [("a", "a1")])
    with pytest.raises(StoreError, match="twice"):
        s.publish({}, spark.createDataFrame([("a", False), ("a", False)], "source_path string, deleted boolean"))


def test_incremental_equals_full(spark, tmp_path):
    inc, full = Store(spark, f"file://{tmp_path}/i"), Store(spark, f"file://{tmp_path}/f")
    publish(spark, inc, [("a", "a1"), ("b", "b1"), ("c", "c1")])
    publish(spark, inc, [("b", "b2")], deleted=["c"])
    publish(spark, full, [("a", "a1"), ("b", "b2")], full=True)
    assert at(inc, 2) == at(full, 1)


def test_session_order(spark, tmp_path):
    s = Session(Store(spark, f"file://{tmp_path}"))
    with pytest.raises(StoreError):
        s.commit()
    s.stage(spark.createDataFrame([("a", False)], "source_path string, deleted boolean"), nodes=spark.createDataFrame([("a", "a1")], NODES))
    s.seal_contributions()
    with pytest.raises(StoreError):
        s.stage(None)
    s.seal_workspace()
    assert s.commit() == 1


def test_a_crash_before_the_commit_leaves_the_last_version(spark, tmp_path, monkeypatch):
    s = Store(spark, f"file://{tmp_path}")
    publish(spark, s, [("a", "a1")])

    def crash(*_):
        raise KeyboardInterrupt

    with monkeypatch.context() as m:
        m.setattr(Store, "_create", crash)
        with pytest.raises(KeyboardInterrupt):
            publish(spark, s, [("a", "a2")])
    assert at(s, 1) == [("a", "a1")] and s.manifest().latest() == 1
    assert publish(spark, s, [("a", "a3")]) == 2 and at(s, 2) == [("a", "a3")]


def test_of_two_publishers_one_gets_a_conflict(spark, tmp_path, monkeypatch):
    s, other = Store(spark, f"file://{tmp_path}"), Store(spark, f"file://{tmp_path}")
    publish(spark, s, [("a", "a1")])
    write, done = Store._write, []

    def interrupted(self, part, name, df):
        write(self, part, name, df)
        if self is s and name == "nodes" and not done:
            done.append(publish(spark, other, [("a", "theirs")]))

    monkeypatch.setattr(Store, "_write", interrupted)
    with pytest.raises(StoreError, match="conflict"):
        publish(spark, s, [("a", "mine")])
    assert done == [2] and at(s, 2) == [("a", "theirs")] and s.manifest().latest() == 2


def test_many_versions_stay_few_parts(spark, tmp_path):
    s = Store(spark, f"file://{tmp_path}", retained=2)
    publish(spark, s, [("keep", "k"), ("a", "a0")])
    for i in range(1, 9):
        publish(spark, s, [("a", f"a{i}")])
        assert at(s, i + 1) == [("a", f"a{i}"), ("keep", "k")]
        assert len(s.manifest().parts()) <= 5
    assert s.manifest().pruned_below == 8 and at(s, 8) == [("a", "a7"), ("keep", "k")]
    s.compact()
    assert len(s.manifest().parts()) == 3 and at(s, 9) == [("a", "a8"), ("keep", "k")]
    reader = s.contributions("nodes", 9)
    assert s.vacuum() == 0  # within the grace period nothing goes
    assert reader.count() == 2 and s.vacuum(0) > 0
    assert at(s, 8) == [("a", "a7"), ("keep", "k")] and at(s, 9) == [("a", "a8"), ("keep", "k")]
    s.rollback(8)
    assert publish(spark, s, [("a", "b")]) == 10 and at(s, 10) == [("a", "b"), ("keep", "k")]


def test_budget_counts_what_is_in_force(spark, tmp_path):
    rows = lambda k: [("a", f"{k}-{i}") for i in range(2000)]
    free = Store(spark, f"file://{tmp_path}", retained=1)
    publish(spark, free, rows(0))
    budget = int(3.5 * sum(p["bytes"] for p in free.manifest().parts()))
    s = Store(spark, f"file://{tmp_path}", retained=1, byte_budget=budget)
    for k in range(1, 7):  # older versions are compacted away, so the budget never ends publishing
        publish(spark, s, rows(k))
    with pytest.raises(StoreError, match="budget"):
        publish(spark, s, [("a", f"x{i * 7919 % 100003}{i}") for i in range(60_000)])
    assert len(at(s, 7)) == 2000


def test_staged_publication_resolves_before_the_commit(spark, tmp_path):
    s = Store(spark, f"file://{tmp_path}")
    publish(spark, s, [("a", "a1"), ("b", "b1"), ("c", "c1")])
    seen = []

    def resolve(staged):
        now = staged.contributions("nodes")
        seen.append(sorted((r["source_path"], r["node_id"]) for r in now.collect()))
        assert s.manifest().latest() == 1
        return {"edges": now.selectExpr("node_id as source_id", "'x' as target_id", "'r' as relation", "source_path as owner")}

    assert publish(spark, s, [("b", "b2")], deleted=["c"], workspace=resolve) == 2
    assert seen == [[("a", "a1"), ("b", "b2")]] and at(s, 2) == seen[0]
    assert sorted(r["source_id"] for r in s.workspace("edges", 2).collect()) == ["a1", "b2"]
    with pytest.raises(ZeroDivisionError):
        publish(spark, s, [("b", "b3")], workspace=lambda staged: 1 / 0)
    assert s.manifest().latest() == 2 and at(s, 2) == seen[0]

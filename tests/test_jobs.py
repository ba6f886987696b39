"""The catalog job, the spending ledger, validation of contributions and benchmarks, feed ownership."""

from datetime import datetime, timezone

import pandas as pd
import pytest

from strataflow.operators import usage, validate
from strataflow.plans import catalog_job as C
from strataflow.sources.ledger import Ledger
from strataflow.sources.store import StoreError
from strataflow.streaming import feed

NODES = "node_id string, label string, kind string, owner string, signature string, comments array<string>"


def test_catalog_job_reuses_stops_and_resumes(spark, tmp_path):
    rows = [(f"n{i}", f"doThing{i}", "go:function", "", f"func doThing{i} ( )", [f"About {i}."]) for i in range(6)] + [("v", "x", "go:variable", "", "", [])]
    nodes = spark.createDataFrame(rows, NODES)
    store = C.CatalogStore(spark, f"file://{tmp_path}")
    assert C.run(store, nodes, 1, batches=2) == "done"
    found = {r["node_id"]: r for r in store.entries().collect()}
    assert len(found) == 6 and found["n1"]["synopsis"] == "doThing1 (function). About 1. Signature: func doThing1 ( ). Identifiers: do thing1"
    first = store._log("entries", C.ENTRIES).count()
    changed = spark.createDataFrame([(*rows[0][:4], "func doThing0 ( x int )", rows[0][5]), *rows[1:]], NODES)
    embed = C.Providers(embed=lambda texts: pd.Series([[float(len(t)), 1.0] for t in texts]), workers=2)
    assert C.run(store, changed, 2, embed, batches=2) == "done"
    assert store._log("entries", C.ENTRIES).count() == first + 1 and store.vectors().count() == 6
    C.run(store, changed, 3, embed, batches=2)
    assert store._log("vectors", C.VECTORS).count() == 6  # nothing is embedded twice
    assert store.task("catalog")["state"] == "done" and store.task("catalog")["version"] == 3

    def stops(texts):
        raise AssertionError("a stopped task calls no model")

    store.stop("catalog")
    say = store.say
    store.say = lambda *a: None if a[2] == "running" else say(*a)  # the stop request comes before the first batch
    assert C.run(store, nodes, 3, C.Providers(synopsis=stops), batches=2) == "stopped" and store.task("catalog")["state"] == "stopped"


def test_ledger_reserves_within_windows_and_settles(spark, tmp_path, monkeypatch):
    ledger = Ledger(spark, f"file://{tmp_path}")
    now = datetime(2024, 1, 18, 9, 30, tzinfo=timezone.utc)
    assert ledger.reserve("p", "usd", 5.0, now=now) == (None, 5.0)
    one, amount = ledger.reserve("p", "usd", 5.0, limits={"day": 8.0}, now=now)
    assert amount == 5.0 and ledger.reserve("p", "usd", 5.0, limits={"day": 8.0, "month": 100.0}, now=now)[1] == 3.0
    with pytest.raises(StoreError, match="exceeded"):
        ledger.reserve("p", "usd", 5.0, limits={"day": 8.0}, now=now)
    assert ledger.reserve("q", "usd", 5.0, limits={"day": 8.0}, now=now)[1] == 5.0
    ledger.settle(one, 1.0)
    assert ledger.reserve("p", "usd", 0.0, limits={"day": 8.0}, now=now)[1] == 4.0
    for bad in ((one, 2.0), (99, 0.0), (one, -1.0)):
        with pytest.raises(StoreError, match="invalid"):
            ledger.settle(*bad)
    assert ledger.reserve("p", "usd", 6.0, limits={"day": 8.0}, now=datetime(2024, 1, 19, tzinfo=timezone.utc))[1] == 6.0
    assert usage.grant({"day": 3, "week": 3}, {"day": 10, "week": None}, 9, 1) == 7 and usage.grant({"day": 10}, {"day": 10}, 1, 0) is None


def test_contribution_violations(spark):
    nodes = spark.createDataFrame([("a", "n1"), ("b", "n2")], "source_path string, node_id string")
    tables = {
        "units": spark.createDataFrame([("a", "n1", "x", "k", "s", ["t"]), ("a", "n2", "x", "k", "s", [""]), ("a", "n1", "", "k", "s", [])], "source_path string, node_id string, name string, kind string, signature string, tokens array<string>"),
        "references": spark.createDataFrame([("a", "n1", "./x", "import", [("y", "z")]), ("a", "n1", "./x", "goto", [("", "z")])], "source_path string, source_id string, target string, kind string, bindings array<struct<imported:string,local:string>>"),
        "surfaces": spark.createDataFrame([("b", "n1", "x")], "source_path string, node_id string, name string"),
        "diagnostics": spark.createDataFrame([("a", "m", "fatal"), ("a", "", "info")], "source_path string, message string, severity string"),
    }
    got = sorted((r["part"], r["code"]) for r in validate.contribution_violations(nodes, tables).collect())
    assert got == [("diagnostics", "incomplete"), ("diagnostics", "unsupported"), ("references", "empty_binding"), ("references", "unsupported"), ("surfaces", "not_local"), ("units", "empty_token"), ("units", "incomplete"), ("units", "not_local")]
    assert validate.vocabulary_errors(["a", "a", ""], [("r", "a", "z")], ["r", "q", "q"]) == ["empty kind", "duplicate kind a", "duplicate relation q", "relation q has no endpoints", "relation q has no endpoints", "relation r has unknown endpoint z"]
    assert validate.vocabulary_errors(["a"], [("r", "a", "a")], ["r"]) == []


def test_benchmark_validation():
    runs = [{"index": i, "checksum": "c", "peak_bytes": 100 + i, "query": 0.1 * i} for i in range(3)]
    assert usage.benchmark_errors(runs, {"query": 0.1, "peak_bytes": 101}) == []
    assert len(usage.benchmark_errors([*runs[:2], runs[2] | {"checksum": "d", "index": 5, "peak_bytes": 999}], {"query": 0.05, "path": 1, "peak_bytes": 101})) == 5
    assert usage.benchmark_errors(runs[:1], {}) == ["1 runs instead of 3"]
    assert usage.growth_errors({"size": 1, "retained_bytes": 10}, {"size": 10, "retained_bytes": 30}) == [] and usage.growth_errors({"size": 1, "retained_bytes": 10}, {"size": 10, "retained_bytes": 60})


def test_question_baseline(spark):
    answers = spark.createDataFrame([("q", 1, "a", "n1", "calls"), ("q", 2, "a", "n2", "calls"), ("r", 11, "b", "n3", "path")], "question string, rank int, path string, node_id string, intent string")
    truth = spark.createDataFrame([("q", "n2", "calls"), ("r", "n3", "impact")], "question string, node_id string, intent string")
    assert tuple(usage.question_baseline(answers, truth).first()) == (0.5, 0.5, 0.75)


def test_one_owner_and_retries_without_end(spark, tmp_path):
    now = [0.0]
    a, b = (feed.Ownership(spark, f"file://{tmp_path}", n, 10, lambda: now[0]) for n in ("a", "b"))
    assert a.acquire() and a.acquire() and not b.acquire() and a.status() == {"running": True, "owner": "a"}
    now[0] = 11.0
    assert not a.status()["running"] and b.acquire() and not a.acquire()
    with pytest.raises(StoreError, match="belongs to b"):
        a.refresh()  # the lock went stale and was taken over
    b.refresh()
    b.release()
    assert not b.status()["running"] and a.acquire() and len(list((tmp_path / "lock").glob("*.json"))) <= 3
    # of two contenders for a stale lock the one that creates the next entry has it
    now[0] = 50.0
    number = b._last()[0]
    assert a._enter(number, "a") and not b._enter(number, "b") and a.status() == {"running": True, "owner": "a"}
    calls, waits = [], []

    def publish(paths):
        calls.append(list(paths))
        if len(calls) < 12:
            raise RuntimeError("busy")

    p = feed.Publisher(publish, waits.append, most=2)
    p(spark.createDataFrame([(i, f"f{i}.ts") for i in range(3)], "ts int, path string"), 0)
    assert calls[-2:] == [["f0.ts", "f1.ts"], ["f2.ts"]] and waits[:7] == [1, 2, 4, 8, 16, 32, 60] and len(waits) == 11

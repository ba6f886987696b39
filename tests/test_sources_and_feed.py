import pytest
from pyspark.sql import functions as F

from strataflow.plans.engine import Engine
from strataflow.sources.discovery import IgnoreRules, discover, glob_regex
from strataflow.sources.extract import extract
from strataflow.sources.parse import parse
from strataflow.streaming import feed


def test_ignore_rules():
    r = IgnoreRules({"": "*.log\n!keep.log\nbuild/\n/top.txt\n", "sub": "x*\n!xy\n"})
    got = {p: r.ignores(p) for p in ("a.log", "keep.log", "build/keep.log", "top.txt", "d/top.txt", "sub/xa", "sub/xy", "xa")}
    assert got == {"a.log": True, "keep.log": False, "build/keep.log": True, "top.txt": True, "d/top.txt": False, "sub/xa": True, "sub/xy": False, "xa": False}
    import re

    assert re.fullmatch(glob_regex("src/**/*.{ts,go}"), "src/a/b.go") and not re.fullmatch(glob_regex("src/*.ts"), "src/a/b.ts")


def test_discover_and_extract(spark, tmp_path):
    files = {"package.json": "{}", "a.ts": 'import { B } from "./lib/b"\nexport class A {}\n', "lib/go.mod": "module x", "lib/b.ts": "export interface B {}\nfunction c() {}\n", "node_modules/z.ts": "class Z {}", "README.md": "x"}
    for name, body in files.items():
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text(body)
    found = discover(spark, f"file://{tmp_path}")
    assert {(r["path"], r["project_id"]) for r in found.collect()} == {("a.ts", "project:."), ("lib/b.ts", "project:lib")}
    nodes = {(r["kind"], r["label"], r["exported"]) for r in extract(found).collect()}
    assert ("typescript:class", "A", True) in nodes and ("typescript:interface", "B", True) in nodes and ("typescript:function", "c", False) in nodes
    assert [r["specifier"] for r in extract(found, "references").collect()] == ["./lib/b"]
    assert parse("x.go", "go", 'import (\n\t"fmt"\n)\nfunc (s T) Do() {}\n').references == [("fmt", "import", 2, False, [])]


def test_feed_retries_and_keeps_order(spark):
    calls, waits = [], []

    def publish(paths):
        calls.append(paths)
        if len(calls) < 3:
            raise RuntimeError("busy")

    p = feed.Publisher(publish, waits.append)
    batch = spark.createDataFrame([(3, "b/../c.ts"), (1, "z.ts"), (2, "z.ts"), (4, "../out.ts"), (5, "/abs.ts")], "ts int, path string")
    p(batch, 0)
    assert calls == [["z.ts", "c.ts"]] * 3 and waits == [1.0, 2.0] and not p.pending


def test_stream_publishes_coalesced_batches(spark, tmp_path):
    src = tmp_path / "in"
    spark.createDataFrame([(1, "a.ts"), (2, "a.ts"), (3, "b.ts")], "ts int, path string").coalesce(1).write.parquet(str(src))
    seen = []
    q = feed.start(spark.readStream.schema("ts int, path string").parquet(str(src)), seen.append, str(tmp_path / "cp"), "50 milliseconds")
    try:
        q.processAllAvailable()
    finally:
        q.stop()
    assert seen == [["a.ts", "b.ts"]]


@pytest.fixture(scope="module")
def engine(spark):
    nodes = [("go:function:main", "go:function", "main", "app.main", "cmd/main.go"), ("go:function:run", "go:function", "run", "app.run", "cmd/run.go"), ("go:function:stop", "go:function", "stopServer", "app.stopServer", "cmd/stop.go"), ("go:type:s", "go:type", "Server", "app.Server", "srv/server.go"), ("i", "typescript:interface", "Store", "db.Store", "db/store.ts"), ("p", "typescript:class", "PgStore", "pg.PgStore", "pg/a.ts"), ("q", "typescript:class", "LiteStore", "lite.LiteStore", "lite/b.ts")]
    edges = [("go:function:main", "go:function:run", "go:calls"), ("go:function:run", "go:function:stop", "go:calls"), ("p", "i", "typescript:implements"), ("q", "i", "typescript:implements")]
    return Engine(spark.createDataFrame(nodes, "node_id string, kind string, label string, qualified_name string, span_path string"), spark.createDataFrame(edges, "source_id string, target_id string, relation string"))


def test_ask(engine):
    assert [e["edges"][0][0] for e in engine.ask("who calls app.run?").evidence if e["distance"] == 1] == ["go:function:main"]
    assert engine.ask("how does app.main reach app.stopServer?").edges == [("go:function:main", "go:function:run", "go:calls"), ("go:function:run", "go:function:stop", "go:calls")]
    shared = engine.ask("what do pg.PgStore and lite.LiteStore have in common").evidence[0]
    assert shared["shared"] == ["i", "p", "q"] == shared["nodes"] and shared["edges"] == [("p", "i", "typescript:implements"), ("q", "i", "typescript:implements")]
    assert engine.ask("what is affected if app.stopServer changes").evidence[0]["node_id"] == "go:function:run"
    assert engine.ask("who calls Nobody?").warnings[0]["code"] == "entity_not_found"
    assert engine.ask("where is stop server?").evidence[0]["label"] == "stopServer"


def test_terms_path_inspect(engine):
    assert engine.path("app.main", "app.stopServer")["path"][1][1] == "go:function:stop"
    assert engine.path("app.stopServer", "app.main")["path"] is None and engine.path("app.stopServer", "app.main", undirected=True)["path"]
    assert engine.inspect("app.run")["edges"].count() == 2
    assert engine.terms(["app.main"]).nodes[0] == "go:function:main"
    assert engine.nodes.filter(F.col("kind") == "go:type").count() == 1

"""Scopes, plans, warnings, planners, the catalog and the lexical index behind the engine."""

import json

import pytest
from pyspark.sql import functions as F

from strataflow.functions.text import bm25
from strataflow.operators import catalog
from strataflow.plans.engine import WEIGHTS, Answer, Catalog, Engine, search_fields
from strataflow.plans.lexical import LexicalIndex
from strataflow.plans.question import planner_response

NODES = "node_id string, kind string, label string, qualified_name string, span_path string"
EDGES = "source_id string, target_id string, relation string"


@pytest.fixture(scope="module")
def graph(spark):
    """Two projects, each with a file and a class of the same label."""
    nodes, edges = [], []
    for p in ("one", "two"):
        nodes += [(f"project:{p}", "project", p, p, p), (f"file:{p}/s.ts", "file", "s.ts", f"{p}/s.ts", f"{p}/s.ts"), (f"{p}:Store", "typescript:class", "ItemStore", f"{p}/s.ts::ItemStore", f"{p}/s.ts"), (f"{p}:save", "typescript:method", "saveItem", f"{p}/s.ts::saveItem", f"{p}/s.ts")]
        edges += [(f"project:{p}", f"file:{p}/s.ts", "contains"), (f"file:{p}/s.ts", f"{p}:Store", "contains"), (f"{p}:Store", f"{p}:save", "contains"), (f"{p}:Store", f"{p}:save", "typescript:calls")]
    edges += [("one:save", "two:Store", "typescript:calls"), ("one:save", "gone", "typescript:calls")]
    return spark.createDataFrame(nodes, NODES), spark.createDataFrame(edges, EDGES)


@pytest.fixture(scope="module")
def engine(graph):
    return Engine(*graph)


def codes(a: Answer):
    return [w["code"] for w in a.warnings]


def test_scope_limits_seeds_search_terms_and_traversal(engine, graph):
    assert sorted(r["node_id"] for r in engine.search("item store", [["item", "store"]]).collect()) == ["one:Store", "two:Store"]
    assert [r["node_id"] for r in engine.search("item store", [["item", "store"]], projects=["project:two"]).collect()] == ["two:Store"]
    both = engine.ask("where is item store?")
    assert codes(both) == ["ambiguous_entity"] and both.warnings[0]["suggestions"] == ["Look up one:Store.", "Look up two:Store."] and [e["rank"] for e in both.evidence] == [1, 2]
    one = engine.ask("where is item store?", projects=["project:one"])
    assert codes(one) == [] and [e["node_id"] for e in one.evidence] == ["one:Store"]
    scoped = Engine(*graph, projects=["project:one"])
    t = scoped.terms(["one:Store"], max_depth=3)
    assert t.scope_boundary == "two:Store" and "two:save" not in t.nodes
    assert scoped.path("one:Store", "one:save")["path"] and scoped.path("one:Store", "two:Store")["path"] is None
    assert [r["node_id"] for r in scoped.retrieve("item").collect()] != [] and {r["node_id"][:3] for r in scoped.retrieve("item").collect()} == {"one"}


def test_plans_warn_instead_of_guessing(engine):
    assert codes(engine.ask("explain save")) == ["ambiguous_entity"]
    weak = engine.ask("explain item archive", projects=["project:one"])
    assert codes(weak)[0] in ("weak_entity_match", "entity_not_found", "ambiguous_entity") and not weak.edges
    nothing = engine.ask("who calls Nobody?")
    assert codes(nothing) == ["entity_not_found"] and nothing.limits[0]["stage"] == "retrieval" and nothing.exit_code() == 1
    explained = engine.ask("explain one:Store")
    assert explained.limits[-1] == {"stage": "traversal", "role": "", "maxDepth": 1, "maxNodes": 100, "truncated": explained.truncated} and explained.exit_code() == 0
    path = engine.ask("how does one:Store reach two:Store?")
    assert path.evidence[0]["distance"] == 2 and path.edges[-1] == ("one:save", "two:Store", "typescript:calls")
    back = engine.ask("how does two:Store reach one:Store?")
    assert codes(back) == ["no_directed_path"] and back.warnings[0]["suggestions"] == ["Run path from two:Store to one:Store in either direction."]
    many = engine.ask("how does one/s.ts reach two:Store?")
    assert codes(many) in (["no_directed_path"], [])
    assert engine.ask("how does one:Store reach two:Store?", max_depth=1).evidence == []


def test_exact_endpoints_that_are_ambiguous(spark):
    nodes = spark.createDataFrame([("a1", "go:function", "run", "run", "a.go"), ("a2", "go:function", "run", "run", "b.go"), ("b", "go:function", "stop", "stop", "c.go")], NODES)
    asked = Engine(nodes, spark.createDataFrame([("a1", "b", "go:calls")], EDGES)).ask("how does run reach stop?")
    assert codes(asked) == ["ambiguous_path_endpoints"] and asked.warnings[0]["suggestions"] == ["Run path from a1 to b.", "Run path from a2 to b."]
    same = Engine(nodes, spark.createDataFrame([], EDGES)).path("run", "stop")
    assert same["path"] is None and same["candidates"]["source"] == ["a1", "a2"] and same["more"]["source"] == 0


def test_planners_are_asked_in_order_and_only_when_needed(graph):
    asked = []

    def broken(q):
        asked.append(q)
        return '{"schemaVersion": 1} trailing'

    def good(q):
        return json.dumps({"schemaVersion": 1, "intent": "called_by", "entities": ["two:Store"]})

    e = Engine(*graph, planners=[broken, good])
    a = e.ask("tell me everything")
    assert a.plan.intent == "called_by" and codes(a) == ["planner_failed"] and a.evidence[0]["edges"] == [("one:save", "two:Store", "typescript:calls")]
    e.ask("who calls two:Store?")
    assert asked == ["tell me everything"]
    with pytest.raises(ValueError):
        planner_response("q", '[1]')
    with pytest.raises(ValueError):
        planner_response("q", {"schemaVersion": 1, "intent": "calls", "entities": ["x"], "confidence": "low"})


def test_capability_and_unknown_questions_ask_the_catalog(spark, graph):
    entries = spark.createDataFrame([("one:Store", "ItemStore", "Keeps items on disk.", "saves things"), ("one:save", "saveItem", "Writes one item.", "")], "node_id string, name string, synopsis string, synopsis_local string")
    vectors = spark.createDataFrame([("one:Store", [1.0, 0.0]), ("one:save", [0.0, 1.0])], "node_id string, vector array<float>")
    e = Engine(*graph, catalog=Catalog(entries, vectors, lambda text: [0.0, 1.0]))
    a = e.ask("Can the workspace keep items?")
    assert a.seeds == {} and [m["node_id"] for m in a.catalog["matches"]] == ["one:Store"] and a.catalog["method"] == "lexical_and_embeddings"
    unknown = e.ask("items please")
    assert "unknown_intent" in codes(unknown) and unknown.catalog["matches"]
    assert catalog.ranked(entries, vectors, "zebra", lambda t: [1.0, 0.1])["method"] == "embeddings"
    none = catalog.ranked(entries, vectors, "zebra")
    assert none["matches"] == [] and none["warnings"] and none["skipped"]
    assert catalog.ranked(entries, vectors, "things")["matches"][0]["node_id"] == "one:Store"  # a provider's synopsis is a field

    def fails(text):
        raise OSError("down")

    assert catalog.ranked(entries, vectors, "items", fails)["skipped"].endswith("down")
    assert Engine(*graph).ask("Can the workspace fly?").catalog["warnings"]


def test_lexical_index_scores_like_a_scan(spark, graph, tmp_path):
    nodes = graph[0].unionByName(spark.createDataFrame([("x", "file", "the item saver of items", "save the item", "p/save the item.ts"), ("y", "file", None, "", "item save")], NODES))
    built = LexicalIndex.build(nodes, search_fields())
    built.rows.write.parquet(f"{tmp_path}/r")
    built.totals.write.parquet(f"{tmp_path}/t")
    index = LexicalIndex(spark.read.parquet(f"{tmp_path}/r"), spark.read.parquet(f"{tmp_path}/t"))
    for groups, phrases in ([["item"]], []), ([["item", "sav"], ["one"]], []), ([], ["save item"]), ([["ite"]], ["the item", "nothing here"]), ([["zzz"]], []):
        rows = lambda df: {r["node_id"]: round(r["score"], 9) for r in df.collect()}
        assert rows(index.search(WEIGHTS, groups, phrases)) == rows(bm25(nodes, "node_id", search_fields(), WEIGHTS, groups, phrases))
    plan = index.search(WEIGHTS, [["item"]])._jdf.queryExecution().toString()
    assert "GreaterThanOrEqual(token,item)" in plan  # the range reaches the scan


def test_envelope(engine):
    a = engine.ask("where is one:Store?")
    whole = json.loads(a.to_json(7, "2024-01-01T00:00:00+00:00"))
    assert whole["graphVersion"] == 7 and whole["publishedAt"].startswith("2024") and whole["result"]["intent"] == "lookup" and "one:Store" in a.to_text()
    assert engine.nodes.filter(F.col("kind") == "project").count() == 2

"""Command line: index, query, path, inspect and export over a store. ``python -m strataflow --help``."""

from __future__ import annotations

import argparse
import json
import sys

from pyspark.sql import DataFrame, SparkSession

from .operators import export
from .plans.engine import Engine
from .plans.indexing import full_index, publish_batch
from .plans.question import is_question
from .sources.store import Store, StoreError

NODE = ("node_id", "kind", "label", "qualified_name", "source_path as span_path")


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="strataflow")
    top.add_argument("--store", required=True, help="root of the version store")
    top.add_argument("--version", type=int, help="a version other than the last")
    top.add_argument("--text", action="store_true", help="lines for people in place of JSON")
    sub = top.add_subparsers(dest="command", required=True)
    index = sub.add_parser("index", help="index a directory tree, or only some of its paths")
    index.add_argument("workspace")
    index.add_argument("changed", nargs="*")
    for name, arguments in (("query", ["words"]), ("path", ["source", "target"]), ("inspect", ["term"])):
        p = sub.add_parser(name)
        for a in arguments:
            p.add_argument(a, **({"nargs": "+"} if a == "words" else {}))
        p.add_argument("--project", action="append", default=[])
        p.add_argument("--relation", action="append", default=[])
        p.add_argument("--depth", type=int)
        p.add_argument("--nodes", type=int)
    sub.choices["path"].add_argument("--undirected", action="store_true")
    out = sub.add_parser("export", help="write nodes and edges as Parquet")
    out.add_argument("to")
    out.add_argument("--kind", action="append", default=[])
    out.add_argument("--relation", action="append", default=[])
    return top


def snapshot(store: Store, version: int | None) -> tuple[DataFrame, DataFrame, dict]:
    """Nodes and edges of a version, and its entry in the manifest."""
    m = store.manifest()
    v = m.check(version) if version else m.latest()
    nodes = store.rows("nodes", v).selectExpr(*NODE)
    return nodes, store.workspace("edges", v).select("source_id", "target_id", "relation"), next(x for x in m.versions if x["version"] == v)


def run(spark: SparkSession, arguments: list[str], out=sys.stdout) -> int:
    """0 with a result, 1 without one or for a bad request, 2 where nothing is indexed."""
    a = parser().parse_args(arguments)
    store = Store(spark, a.store)
    try:
        if a.command == "index":
            version = publish_batch(spark, store, a.workspace, a.changed) if a.changed else full_index(spark, store, a.workspace)
            print(json.dumps({"graphVersion": version}), file=out)
            return 0
        nodes, edges, entry = snapshot(store, a.version)
    except StoreError as e:
        print(json.dumps({"error": str(e)}), file=out)
        return 2
    envelope = lambda result: json.dumps({"graphVersion": entry["version"], "publishedAt": entry["published_at"], "result": result}, default=str)
    if a.command == "export":
        kept, between = export.filtered(nodes, edges, a.kind or [r[0] for r in nodes.select("kind").distinct().collect()], a.relation or [r[0] for r in edges.select("relation").distinct().collect()])
        kept.write.parquet(f"{a.to}/nodes")
        between.write.parquet(f"{a.to}/edges")
        print(envelope({"nodes": f"{a.to}/nodes", "edges": f"{a.to}/edges"}), file=out)
        return 0
    engine = Engine.open(store, entry["version"], a.project)
    bounds = {k: v for k, v in (("max_depth", a.depth), ("max_nodes", a.nodes)) if v is not None}
    if a.command == "query" and is_question(a.words):
        answer = engine.ask(a.words[0], **bounds)
        print(answer.to_text() if a.text else answer.to_json(entry["version"], entry["published_at"]), file=out)
        return answer.exit_code()
    if a.command == "query":
        t = engine.terms(a.words, a.relation or None, **bounds)
        result, found = {"nodes": t.nodes, "edges": t.edges, "truncated": t.truncated, "scopeBoundary": t.scope_boundary}, bool(t.nodes)
    elif a.command == "path":
        result = engine.path(a.source, a.target, a.relation or None, a.undirected, **bounds)
        found = result["path"] is not None
    else:
        result = engine.inspect(a.term)
        found = "nodes" in result
        result = {k: [r.asDict() for r in v.collect()] if isinstance(v, DataFrame) else v for k, v in result.items()}  # one node's neighbours
    print("\n".join(f"{k}: {v}" for k, v in result.items()) if a.text else envelope(result), file=out)
    return 0 if found else 1


if __name__ == "__main__":
    sys.exit(run(SparkSession.builder.appName("strataflow").getOrCreate(), sys.argv[1:]))

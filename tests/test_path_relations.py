"""A path along some relations lays out the edges of these only."""

from strataflow.operators.adjacency import Adjacency
from strataflow.plans.engine import Engine


def test_other_relations_are_not_laid_out(spark, monkeypatch):
    nodes = spark.createDataFrame([(n, "file", n, n, n) for n in ("a", "b", "c")], "node_id string, kind string, label string, qualified_name string, span_path string")
    edges = spark.createDataFrame([("a", "b", "contains"), ("b", "c", "defines"), ("a", "c", "calls")], "source_id string, target_id string, relation string")
    built, build = [], Adjacency.build.__func__
    monkeypatch.setattr(Adjacency, "build", classmethod(lambda cls, n, e, path=None: built.append({r[0] for r in e.select("relation").distinct().collect()}) or build(cls, n, e, path)))
    engine = Engine(nodes, edges)
    assert engine.path("a", "c", ["contains", "defines"])["path"] == [("a", "b", "contains"), ("b", "c", "defines")]
    assert engine.path("a", "c", ["defines", "contains"])["path"] and built == [{"contains", "defines"}]
    assert engine.path("a", "c")["path"] == [("a", "c", "calls")] and len(built) == 2
    assert engine.path("a", "c", ["contains"])["path"] is None and len(built) == 2  # the whole table serves it

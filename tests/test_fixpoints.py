"""Closures run to their fixpoint, however deep."""

from strataflow.operators import resolve, traverse


def test_project_scope_reaches_every_depth_and_ends_in_a_cycle(spark):
    edges = spark.createDataFrame([(f"n{i}", f"n{i + 1}", "contains") for i in range(11)] + [("n11", "n3", "contains"), ("n2", "x", "calls")], "source_id string, target_id string, relation string")
    found = traverse.project_scope(edges, spark.createDataFrame([("n0",)], "node_id string"))
    assert sorted(r[0] for r in found.collect()) == sorted(f"n{i}" for i in range(12))


def test_names_pass_through_any_number_of_re_exports(spark):
    hops = spark.createDataFrame([(f"f{i + 1}", f"f{i}", "*", "*") for i in range(35)] + [("f0", "f35", "*", "*")], "path string, target_path string, imported string, exported string")
    found = resolve.re_export_closure(spark.createDataFrame([("f0", "a", "n")], "path string, name string, node_id string"), hops)
    assert sorted(r[0] for r in found.collect()) == sorted(f"f{i}" for i in range(36))

"""Postings of a segment are made where its nodes are: nothing is exchanged to group a row's places."""

from pyspark.sql import functions as F
from strataflow.plans.lexical import POSTINGS, by_token, segment


def test_a_segment_exchanges_no_postings(spark):
    nodes = spark.range(8).select(F.format_string("n%d", "id").alias("node_id"), F.format_string("s%d", F.col("id") % 3).alias("source_path"), F.lit("a b a").alias("label"))
    rows = segment(nodes, {"label": F.split("label", " ")})[POSTINGS]
    assert "Exchange" not in rows._jdf.queryExecution().executedPlan().toString()
    got = sorted((r["token"], r["node_id"], r["size"], tuple((h["field"], h["pos"]) for h in r["hits"])) for r in rows.collect())
    want = [(t, f"n{i}", 3, h) for t, h in (("a", (("label", 0), ("label", 2))), ("b", (("label", 1),))) for i in range(8)]
    assert got == sorted(want)


def test_places_are_grouped_by_token(spark):
    texts = [(1, ["x", "y", "x"], ["y"]), (2, [], None), (3, None, ["z", "", "z", "Z"]), (4, ["same"] * 300, [f"w{i % 70}" for i in range(500)]), (5, [], [])]
    rows = by_token(spark.createDataFrame(texts, "id long, a array<string>, b array<string>"), ["id"], ["a", "b"])
    got = {(r["id"], r["token"]): sorted((h["field"], h["pos"]) for h in r["hits"]) for r in rows.collect()}
    want: dict = {}
    for i, a, b in texts:
        for field, tokens in (("a", a), ("b", b)):
            for at, token in enumerate(tokens or ()):
                want.setdefault((i, token), []).append((field, at))
    assert got == want and rows.count() == len(want)

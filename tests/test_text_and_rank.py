from pyspark.sql import functions as F

from strataflow.functions import text as X
from strataflow.functions.ids import node_id
from strataflow.functions.vectors import cosine, l2
from strataflow.operators import rank


def tokens(spark, boundary, lower):
    names = ["HTTPServer", "fooBar2Baz", "snake_case", "a.b::c", "ÜnïcodeName"]
    df = spark.createDataFrame([(n,) for n in names], "n string")
    return [r[0] for r in df.select(X.identifier_tokens(F.col("n"), boundary, lower)).collect()]


def test_three_tokenisers(spark):
    assert tokens(spark, X.STORE, True) == [["httpserver"], ["foo", "bar2", "baz"], ["snake", "case"], ["a", "b", "c"], ["ünïcode", "name"]]
    assert tokens(spark, X.QUESTION, False)[0] == ["HTTP", "Server"]
    assert tokens(spark, X.CATALOG, True)[0] == ["http", "server"]


def test_failed_group_adds_no_hits(spark):
    docs = spark.createDataFrame([(1, ["alpha", "beta"]), (2, ["alpha"]), (3, ["gamma"]), (4, ["delta"]), (5, ["x"])], "id int, t array<string>")
    got = {r["id"] for r in X.bm25(docs, "id", {"t": F.col("t")}, {"t": 1.0}, [["alpha", "be"]], ["gamma"]).collect()}
    assert got == {1, 3}


def test_fusion_ties_share_ranks_and_zero_has_none(spark):
    rows = [(f"n{i}", v) for i, v in enumerate([2.0, 2.0, 1.0, 0.0])]
    df = spark.createDataFrame(rows, "node_id string, lexical double")
    for c in rank.COMPONENTS:
        if c != "lexical":
            df = df.withColumn(c, F.lit(0.0))
    got = {r["node_id"]: r["fused"] for r in rank.fuse(df).collect()}
    assert got["n0"] == got["n1"] == 1 / 61 and abs(got["n2"] - 1 / 63) < 1e-12 and got["n3"] == 0


def test_vectors_and_ids(spark):
    row = spark.sql("select array(cast(3 as float), cast(4 as float)) a, array(cast(3 as float), cast(0 as float)) b, cast(array() as array<float>) e")
    r = row.select(l2(F.col("a"), F.col("b")).alias("d"), cosine(F.col("a"), F.col("b")).alias("c"), cosine(F.col("a"), F.col("e")).alias("n")).first()
    assert r["d"] == 4 and abs(r["c"] - 0.6) < 1e-9 and r["n"] is None
    import hashlib
    import struct

    raw = b"".join(struct.pack(">I", len(s)) + s for s in (b"go:type", "é/a.go".encode())) + struct.pack(">4Q", 1, 2, 3, 4)
    got = spark.sql("select 'go:type' k, 'é/a.go' p").select(node_id(F.col("k"), F.col("p"), *[F.lit(i) for i in (1, 2, 3, 4)])).first()[0]
    assert got == "go:type:" + hashlib.sha256(raw).hexdigest()

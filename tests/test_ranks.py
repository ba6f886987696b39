"""Distributed positions, prefix sums, value ranks, exact selection, fusion and division by classes."""

import random

from pyspark.sql import Window
from pyspark.sql import functions as F
from strataflow.functions.ranks import numbered, prefix_sums, value_ranks
from strataflow.functions.text import folded, plain_tokens
from strataflow.operators import rank, resolve, usage


def test_numbered_and_prefix_sums(spark):
    r = random.Random(1)
    rows = [(r.randint(0, 30), r.random()) for _ in range(700)]
    df = spark.createDataFrame(rows, "a int, b double")
    got = [(x["a"], x["b"], x["at"]) for x in numbered(df, [F.desc("a"), F.col("b")], "at").orderBy("at").collect()]
    want = sorted(rows, key=lambda x: (-x[0], x[1]))
    assert [g[:2] for g in got] == want and [g[2] for g in got] == list(range(700))
    sums = {x["at"]: x["a_sum"] for x in prefix_sums(numbered(df, [F.desc("a"), F.col("b")], "at").select("at", "a"), "at", ["a"], 700, bits=3).collect()}
    assert [sums[i] for i in range(700)] == [sum(w[0] for w in want[: i + 1]) for i in range(700)]


def test_value_ranks_with_hot_keys_values_and_nulls(spark):
    rows = [("hot", 1.0)] * 300 + [("hot", None)] * 20 + [(None, 2.0), (None, None), ("b", 3.0), ("b", 3.0), ("b", 1.0)]
    got = {(x["k"], x["_value"]): (x["_n"], x["before"], x["_total"]) for x in value_ranks(spark.createDataFrame(rows, "k string, v double"), ["k"], F.col("v"), "before").collect()}
    assert got == {("hot", None): (20, 0, 320), ("hot", 1.0): (300, 20, 320), (None, None): (1, 0, 2), (None, 2.0): (1, 1, 2), ("b", 1.0): (1, 0, 3), ("b", 3.0): (2, 1, 3)}
    assert value_ranks(spark.createDataFrame([], "k string, v double"), ["k"], F.col("v"), "before").count() == 0


def test_selection_equals_a_sort(spark):
    r = random.Random(4)
    rows = [(k, float(r.randint(0, 20))) for k, n in (("a", 301), ("b", 2), ("c", 1), ("d", 100)) for _ in range(n)]
    df = spark.createDataFrame(rows, "k string, v double")
    of = {k: sorted(v for x, v in rows if x == k) for k in "abcd"}
    assert {x["k"]: x["median"] for x in usage.upper_median(df, ["k"], "v").collect()} == {k: v[len(v) // 2] for k, v in of.items()}
    assert {x["k"]: x["percentile"] for x in usage.nearest_rank(df, ["k"], "v", 0.95).collect()} == {k: v[-(-95 * len(v) // 100) - 1] for k, v in of.items()}


def test_fusion_for_many_and_for_few(spark):
    r = random.Random(8)
    rows = [(f"n{i}", *[float(r.choice([0, 0, 1, 2]) if c != "lexical" else r.random()) for c in rank.COMPONENTS]) for i in range(120)]
    df = spark.createDataFrame(rows, "node_id string, " + ", ".join(f"{c} double" for c in rank.COMPONENTS))
    total = F.lit(0.0)
    for c in rank.COMPONENTS:
        total = total + F.when(F.col(c) > 0, 1 / (60 + F.rank().over(Window.partitionBy().orderBy(F.desc(c))))).otherwise(0.0)
    want = {x["node_id"]: round(x["f"], 12) for x in df.select("node_id", (F.col("exact") + total).alias("f")).collect()}
    for fuse in (rank.fuse, rank.fuse_few):
        out = fuse(df)
        assert {x["node_id"]: round(x["fused"], 12) for x in out.collect()} == want
        assert set(out.columns) == {*df.columns, "reciprocal_rank", "fused"}
    assert rank.fuse_few(df.limit(0)).count() == 0


def test_division_by_classes_equals_counting(spark):
    r = random.Random(6)
    have = [(p, f"t{i}", n) for p in ("x", "y") for i in range(40) for n in r.sample("abcdef", r.randint(1, 4))]
    need = [(p, f"i{i}", n) for p in ("x", "z", "y") for i in range(25) for n in r.sample("abcdefg", r.randint(1, 3))]
    methods, required = spark.createDataFrame(have + have[:5], "package string, type_id string, name string"), spark.createDataFrame(need, "package string, interface_id string, name string")
    sets = lambda rows, p: {i: {n for q, j, n in rows if (q, j) == (p, i)} for q, i, _ in rows if q == p}
    want = sorted((t, i) for p in "xyz" for t, a in sets(have, p).items() for i, b in sets(need, p).items() if b <= a)
    assert sorted(tuple(x) for x in resolve.implements(methods, required).collect()) == want
    pairs, types, interfaces = resolve.implement_classes(methods, required)
    assert pairs.count() < len(want) and types.count() == 80 and interfaces.count() == 75


def test_diacritics(spark):
    texts = ["naïve Zoë", "naïve", "ÀÉÎõü Ǆ ẗ", "x²½ ⅷ", "привет й", "", None, "İstanbul"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    got = [x[0] for x in df.orderBy("i").select(plain_tokens(F.col("t"))).collect()]
    assert got[0] == ["naive", "zoe"] and got[1] == ["naive"] and got[2][0] == "aeiou" and got[4] == ["привет", "й"] and got[5] == got[6] == [] and got[7] == ["istanbul"]
    assert got[3] == ["x²½", "ⅷ"] and folded("Naïve") == folded("naïve") == "naive"

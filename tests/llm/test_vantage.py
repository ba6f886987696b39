"""Vantage-point trees against brute force."""

import numpy as np
import pytest
from strataflow.llm import vantage as V

SCHEMA = "vec_id long, embedding array<float>, rank int, dim string"


def table(spark, rows):
    return spark.createDataFrame([(i, None if x is None else [None if y is None else float(y) for y in x], 1, "d") for i, x in rows], SCHEMA)


def brute(rows, asked, k):
    good = [(i, np.array(x, np.float32).astype(float)) for i, x in rows if i is not None and x is not None and len(x) and all(y is not None and np.isfinite(y) for y in x) and np.any(np.array(x))]
    out = []
    for n, (q, a) in enumerate(good):
        if asked(q):
            near = sorted((-round(float(a @ b / (np.sqrt(a @ a) * np.sqrt(b @ b))), 9), i) for m, (i, b) in enumerate(good) if m != n and len(a) == len(b))[:k]
            out += [(q, r + 1, i, -s) for r, (s, i) in enumerate(near)]
    return sorted(out)


def found(spark, rows, p, every=5):
    df = table(spark, rows)
    out = V.nearest(df.filter(df.vec_id % every == 0), V.build(df, p=p)).collect()
    return sorted((r["query_id"], r["rank"], r["vec_id"], round(r["score"], 9)) for r in out)


def clustered(n, dim, seed=3):
    r = np.random.default_rng(seed)
    centres = r.normal(size=(12, dim))
    return [(i, (centres[r.integers(12)] + 0.3 * r.normal(size=dim)).astype(np.float32).tolist()) for i in range(n)]


@pytest.mark.parametrize("shape", [{}, {"shard": 60, "leaf": 4}, {"shard": 150, "leaf": 10, "pivots": 2, "batch": 7}])
def test_exact_with_factor_one(spark, shape):
    rows = clustered(500, 8)
    assert found(spark, rows, V.Params(**shape)) == brute(rows, lambda i: i % 5 == 0, 5)


def test_recall_and_work_with_a_larger_factor(spark):
    rows = clustered(1200, 8)
    want = {(q, i) for q, _, i, _ in brute(rows, lambda i: i % 5 == 0, 5)}
    got = {(q, i) for q, _, i, _ in found(spark, rows, V.Params(factor=1.5, shard=400, leaf=16))}
    assert len(want & got) / len(want) >= 0.9


def test_a_larger_factor_reads_less():
    x = np.array([v for _, v in clustered(4000, 8)])
    tree = V.Tree.load(V.Tree.build(x, [[i] for i in range(len(x))], 32).dump())
    read = {}
    for factor in (1.0, 2.0):
        s = V.Search(tree, x[:64], np.full(64, -2.0), V.Params(factor=factor))
        s.run()
        read[factor] = s.read / 64 / len(x)
    assert read[2.0] < read[1.0] < 0.7


def test_copies_ties_and_unusable_vectors(spark):
    same = [1.0, 2.0, 3.0]
    rows = [(i, same) for i in range(0, 60, 3)] + [(i, [1.0, 0.0, 0.0]) for i in (1, 2, 4)] + [
        (5, None), (10, []), (15, [0.0, 0.0, 0.0]), (20, [1.0, None, 2.0]), (25, [float("nan"), 1.0, 1.0]), (35, [float("inf"), 1.0, 1.0]), (None, same), (40, [-0.0, 1.0, 0.0]), (50, [0.0, 1.0, 0.0]),
        (55, [1.0, 2.0]), (65, [2.0, 4.0, 6.0]), (70, [-1.0, -2.0, -3.0]),
    ]
    got = found(spark, rows, V.Params(shard=8, leaf=2))
    assert got == brute(rows, lambda i: i % 5 == 0, 5)
    assert not [r for r in got if r[0] == 55]  # no other vector of its length


def test_repeated_rows_are_rows(spark):
    rows = [(5, [1.0, 0.0]), (5, [1.0, 0.0]), (6, [0.0, 1.0])]
    assert found(spark, rows, V.Params()) == [(5, 1, 5, 1.0), (5, 1, 5, 1.0), (5, 2, 6, 0.0), (5, 2, 6, 0.0)]


def test_few_and_none(spark):
    assert found(spark, [(5, [1.0, 1.0]), (6, [1.0, 0.0])], V.Params()) == [(5, 1, 6, round(2**-0.5, 9))]
    assert found(spark, [(5, [1.0, 1.0])], V.Params()) == [] and found(spark, [], V.Params()) == []

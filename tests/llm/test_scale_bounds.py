"""Bounds that hold at any size."""

import time

import pytest
from strataflow.llm import decontaminate as D
from strataflow.llm import exact_dedup as X


def brute(doc, item, window=13, match=0.8):
    """Best window of the best alignment, by the rule and nothing else."""
    w = min(len(item), window)
    best = None
    for g in range(-len(item) + 1, len(doc)):
        agree = [0 <= g + j < len(doc) and doc[g + j] == t for j, t in enumerate(item)]
        top = max(sum(agree[s : s + w]) for s in range(len(item) - w + 1))
        if top >= -(-w * 8 // 10) and (best is None or (top, sum(agree), -g) > best):
            best = (top, sum(agree), -g)
    return best and (-best[2], len(item), best[1], round(best[0] / w, 6))


@pytest.mark.parametrize("n", [13, 40, 300])
def test_repeated_tokens_equal_brute_force(spark, docs, n):
    text = "x " * 5 + "0 " * n + "y 0 0 z"
    items = [(1, "0 " * 13), (2, "0 " * 20), (3, "x x 0 0 0 0"), (4, "0 z q q q"), (5, "")]
    out = D.leaks(docs([(7, text), (8, "0 0"), (None, text)]), spark.createDataFrame(items, "item_id long, text string"))
    got = {r["item_id"]: (r["doc_offset"], r["item_tokens"], r["matched_tokens"], r["best_window"]) for r in out.collect()}
    want = {i: brute(text.split(), t.split()) for i, t in items if len(t.split()) >= 5}
    assert got == {i: v for i, v in want.items() if v}


def test_repeated_tokens_grow_in_proportion(spark, docs):
    item = spark.createDataFrame([(1, "0 " * 13)], "item_id long, text string")
    took = {}
    for n in (10_000, 40_000):
        began = time.time()
        out = D.leaks(docs([(1, "0 " * n)]), item)
        assert [tuple(r) for r in out.collect()] == [(1, 1, 0, 13, 13, 1.0)]
        took[n] = time.time() - began
    assert took[40_000] < 60
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert not any(x in plan for x in ("Arrow", "Python", "Pandas"))


@pytest.mark.parametrize("total", [10**6, 10**9, 10**12, 10**14])
def test_owners_follow_the_bytes(total):
    p = X.Params()
    capacity, bits = p.shape(total)
    assert total / capacity <= 2**bits <= 2**p.max_depth
    buckets = min(2**bits, max(1, 2 * total // capacity))
    owners = p.owners(total, buckets, 200)
    assert owners <= buckets and total / owners <= max(4 * capacity, p.owner_bytes, total / 200)
    assert total / owners < 4 << 30

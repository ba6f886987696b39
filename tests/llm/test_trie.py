"""The conversation trie against a plain one."""

import hashlib
import random
import re
import zlib

import pytest
from pyspark.sql import functions as F
from strataflow.llm import trie as T

SCHEMA = "conv_id long, turn long, role string, text string"


def brute(rows, rebuild):
    convs: dict = {}
    for c, turn, role, text in rows:
        if c is not None:
            convs.setdefault(c, []).append((turn is not None, turn or 0, role or "", text or ""))
    convs = {c: [(r, t) for *_, r, t in sorted(v)] for c, v in convs.items()}
    if rebuild:
        h = {c: zlib.crc32(str(c).encode()) % 4 for c in convs}
        base = {c: c - int(c / 20) * 0 - (abs(c) % 20) * (1 if c >= 0 else -1) for c in convs}
        convs = {c: convs.get(base[c], [])[: h[c]] + v[h[c] :] for c, v in convs.items()}
    nodes: dict = {}
    for c, v in convs.items():
        for d in range(len(v) + 1):
            nodes.setdefault(tuple(v[:d]), []).append(c)
    out = []
    for path, members in nodes.items():
        sub = [q for q in nodes if q[: len(path)] == path]
        leaves = sum(not any(len(z) == len(q) + 1 and z[: len(q)] == q for z in nodes) for q in sub)
        saved = sum((len(nodes[q]) - 1) * len(re.findall(r"[^\x20\x09-\x0D]+", q[-1][1])) for q in sub if q)
        ends = ",".join(map(str, sorted(c for c in members if len(convs[c]) == len(path))))
        children = sum(len(q) == len(path) + 1 for q in sub)
        out.append((min(members), len(path), min(nodes[path[:-1]]) if path else None, len(members), children, leaves, saved, hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=repr)


def found(spark, rows, rebuild, params=T.Params()):
    df = spark.createDataFrame(rows, SCHEMA).withColumns({"pos": F.lit("x"), "depth": F.lit(None), "symbol": F.lit(1)})
    c = F.col("conv_id")
    nodes = T.trie(df, *((c - c % 20, F.crc32(c.cast("string").cast("binary")) % 4, 3) if rebuild else ()), params=params)
    return nodes, sorted((tuple(r) for r in nodes.drop("pos", "stop").collect()), key=repr)


EDGES = [
    (1, 0, "user", "hi there"), (1, 1, "assistant", "hello you  two"), (2, 0, "user", "hi there"), (2, None, "system", ""), (3, 5, None, None), (3, 5, None, None), (None, 1, "user", "lost"),
    (4, 0, "user", "hi there"), (4, 1, "assistant", "hello you  two"), (20, 0, "user", "b"), (20, 0, "user", "a"), (20, 1, "x", "y" * 10_000), (21, 0, "user", "own"), (22, 9, "user", "w"),
    (-3, 0, "user", "minus"), (-3, 1, "user", "minus"), (-3, 2, "user", "minus one"), (-3, 3, "user", "minus"), (0, 0, "user", "\tspaced \n out "),
]


@pytest.mark.parametrize("rebuild", [False, True])
def test_edge_cases(spark, rebuild):
    assert found(spark, EDGES, rebuild)[1] == brute(EDGES, rebuild)


def test_long_conversations_in_short_blocks(spark):
    """Blocks of two turns: five rounds of ranks give the order that one would, and intervals nest."""
    r = random.Random(5)
    rows = []
    for c in range(40):
        of = [("user", r.choice("abc") * r.randint(1, 2)) for _ in range(r.randint(1, 24))] if r.random() < 0.4 else [("user", "a")] * r.randint(1, 30)
        rows += [(c, i, role, text) for i, (role, text) in enumerate(of)]
    nodes, got = found(spark, rows, False, T.Params(block_bits=1, piece=2))
    assert got == brute(rows, False)
    spans = sorted((n["pos"], n["stop"], n["depth"]) for n in nodes.collect())
    assert [s[0] for s in spans] == list(range(len(spans)))
    for pos, stop, depth in spans:
        below = [s for s in spans if pos < s[0] <= stop]
        assert all(s[2] > depth and s[1] <= stop for s in below) and (stop + 1 == len(spans) or spans[stop + 1][2] <= depth)


def test_empty(spark):
    assert found(spark, [], True)[1] == [] and found(spark, [(None, 1, "a", "b")], False)[1] == []


def test_turnless_conversations_end_at_the_root(spark):
    rows = [(c, 0, "user", "only") for c in range(21, 40)]  # their base, 20, is absent
    assert found(spark, rows, True)[1] == brute(rows, True)

"""Importance resampling against a plain count of n-grams."""

import hashlib
import math
import re
import zlib
from collections import Counter

import pytest
from strataflow.llm import resampling as R

WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def lower(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")


def brute(docs, target, p):
    def features(text):
        w = WORD.findall(lower(text))
        return len(w), [zlib.crc32(" ".join(w[i : i + n]).encode()) % p.buckets for n in range(p.shortest, p.longest + 1) for i in range(len(w) - n + 1)]

    found = [(i, *features(t)) for i, t in docs]
    s, t = Counter(b for *_, f in found for b in f), Counter(b for x in target for b in features(x)[1])
    total, wanted = sum(s.values()), sum(t.values())
    gain = {b: math.floor(1000 * math.log((t[b] + 1) * (total + p.buckets) / ((s[b] + 1) * (wanted + p.buckets)))) for b in s}
    rows = []
    for i, words, f in found:
        weight = sum(gain[b] for b in f) // len(f) if f else 0
        h = int(hashlib.sha256(f"{p.seed}:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        rows.append((i, words, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))))
    able = sorted((r for r in rows if r[1] >= p.min_words), key=lambda r: (-r[4], r[0] is None, r[0] or 0))
    drawn = {id(r): k + 1 for k, r in enumerate(able[: len(able) * p.percent // 100])}
    return sorted(((i, n, w, s, drawn.get(id(r))) for r in rows for i, _, n, w, s in [r]), key=repr)


TEXTS = [
    "The cat sat on the mat", "the CAT sat; the cat sat. the cat", "", None, "ünïcode Wörter 42 und 42", "a b a b a b a b", "x" * 5000, " \t\n ", "…—…", "word " * 3000,
    "the cat sat on the mat and the dog sat on the log", "naïve Ä ä", "1 2 3 4 5 6 7 8 9 10",
]


@pytest.mark.parametrize("shape", [{}, {"shortest": 1, "longest": 3}, {"shortest": 2, "longest": 2, "block_words": 7}, {"longest": 3, "block_words": 5, "buckets": 70_000}])
def test_equals_plain_counts(spark, docs, shape):
    p = R.Params(**{"min_words": 3, "percent": 50} | shape)
    rows = [*enumerate(TEXTS), (None, "the cat is nobody's cat"), (3, "the cat sat"), (3, "the cat sat")]
    target = ["the cat sat", None, "dog log", "a b a"]
    out = R.resample(docs(rows, extra=("item_id", "score", "rank", "place")), spark.createDataFrame([(i, t) for i, t in enumerate(target)], "item_id long, text string"), p)
    assert sorted((tuple(r) for r in out.collect()), key=repr) == brute(rows, target, p)


def test_empty_tables(spark, docs):
    nothing = spark.createDataFrame([], "item_id long, text string")
    assert R.resample(docs([]), nothing).count() == 0
    rows = [(i, "one two three " * 10) for i in range(20)]
    out = R.resample(docs(rows), nothing).collect()
    assert sorted((tuple(r) for r in out), key=repr) == brute(rows, [], R.Params())
    assert R.survivors(docs(rows), nothing).count() == 2


def test_runs_are_hashed_once(monkeypatch):
    """An n-gram's occurrences in a block share one hash."""
    calls = []
    monkeypatch.setattr(R.zlib, "crc32", lambda b, f=zlib.crc32: calls.append(b) or f(b))
    block = R.Block(R.Params(longest=2))
    words = [b"a", b"b", b"a", b"b", b"a"]
    block.add(words, 5)
    block.add([b"b", b"a"], 2)
    found = block.buckets()
    assert sorted(calls) == [b"a", b"a b", b"b", b"b a"] and [len(f) for f in found] == [9, 3]

"""Exact and near duplicates against brute force, with edge cases."""

import random
from collections import Counter

import numpy as np
from strataflow.llm import exact_dedup as E
from strataflow.llm import near_dedup as N

EDGE = [(1, "a b"), (2, "a b"), (3, None), (4, ""), (2, "a b"), (None, "a b"), (7, "x" * 50_000), (8, "A b"), (9, " ")]


def test_groups_and_edge_cases(docs):
    rows = {(r["doc_id"], r["kept"]): r for r in E.groups(docs(EDGE, extra=("keep_id", "line", "row"))).collect()}
    got = E.groups(docs(EDGE)).collect()
    assert len(got) == len(EDGE)
    assert {r["doc_id"]: (r["keep_id"], r["group_size"]) for r in got} == {1: (2, 4), 2: (2, 4), 3: (4, 2), 4: (4, 2), None: (2, 4), 7: (7, 1), 8: (8, 1), 9: (9, 1)}
    assert Counter(r["doc_id"] for r in got if r["kept"]) == Counter({2: 1, 4: 1, 7: 1, 8: 1, 9: 1})
    assert (2, True) in rows


def test_chains_on_colliding_keys_and_flushes(docs):
    rng = random.Random(3)
    rows = [(i, f"text {rng.randrange(40)}") for i in range(400)]
    p = E.Params(key_bits=3, flush_bytes=2000, bucket_bytes=200)
    want = {}
    for i, t in rows:
        want[t] = max(want.get(t, -1), i)
    got = E.groups(docs(rows).repartition(3), p).collect()
    assert {r["doc_id"]: r["keep_id"] for r in got} == {i: want[t] for i, t in rows}
    kept = E.survivors(docs(rows), p)
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted(want.values()) and kept.columns == docs(rows).columns


def test_directory_doubles_until_buckets_fit():
    depth, slots = E.directory({0: 90, 1: 5, 8: 5, 15: 10}, 4, 20)
    assert depth == 4 and len(slots) == 16 and slots[0] != slots[1] and len(set(slots[8:])) == 1
    assert E.directory({}, 4, 20) == (0, [0])


def test_owners_hold_key_ranges_of_a_stored_directory(docs):
    rng = random.Random(4)
    rows = [(i, " ".join(str(rng.random()) for _ in range(8))) for i in range(300)]
    index = E.build(docs(rows), E.Params(bucket_bytes=2000))
    table = sorted((r["slot"], r["bucket"], r["owner"]) for r in index.directory.collect())
    assert [s for s, _, _ in table] == list(range(1 << index.depth)) and len({b for _, b, _ in table}) == index.buckets > 4
    assert [o for _, _, o in table] == sorted(o for _, _, o in table)
    from pyspark.sql import functions as F

    ranges = sorted((r["low"], r["high"]) for r in index.entries.groupBy(F.spark_partition_id()).agg(F.min(F.hex("key")).alias("low"), F.max(F.hex("key")).alias("high")).collect())
    assert len(ranges) > 1 and all(a[1] < b[0] for a, b in zip(ranges, ranges[1:], strict=False))


def test_empty_tables(docs):
    assert E.groups(docs([])).count() == 0 and E.survivors(docs([])).count() == 0 and N.classify(docs([])).count() == 0


def shingles(text, k):
    w = (text or "").encode().lower().split()
    return frozenset(tuple(w[j : j + k]) for j in range(max(1, len(w) - k + 1))) if w else frozenset()


def brute(rows, k, percent):
    sets = {i: shingles(t, k) for i, t in rows}
    root = {i: i for i in sets}

    def top(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for a in ids:
        for b in ids:
            if a < b and sets[a] and sets[b]:
                both = len(sets[a] & sets[b])
                if 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
                    x, y = top(a), top(b)
                    root[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), top(i)) for i in ids}


def corpus(seed):
    """Copies, mutated copies around a base (a ring whose members are not all alike), chains, passages."""
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(3))
    text = lambda n: [word() for _ in range(n)]
    rows, shared = [], text(60)
    for _ in range(25):
        rows.append(text(rng.randint(3, 90)))
    base = text(120)
    for _ in range(40):
        w = list(base)
        for j in rng.sample(range(120), rng.randint(1, 6)):
            w[j] = word()
        rows.append(w)
    chain = text(80)
    for _ in range(8):
        chain = list(chain)
        for j in rng.sample(range(80), 2):
            chain[j] = word()
        rows.append(chain)
    rows += [shared + text(rng.randint(5, 40)) for _ in range(20)] + [rows[3], rows[30], [w.upper() for w in rows[31]]]
    rng.shuffle(rows)
    return [(i, " ".join(w)) for i, w in enumerate(rows)]


def test_near_dedup_equals_brute_force(docs):
    for seed in (1, 2):
        rows = corpus(seed) + [(900, None), (901, ""), (902, "one two"), (903, "ONE  two"), (904, " \t ")]
        want = brute(rows, 4, 80)
        got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in N.classify(docs(rows, extra=("id", "key", "component"))).collect()}
        assert got == want


def test_blocks_change_nothing(docs):
    rows = corpus(5)
    want = brute(rows, 5, 80)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in N.classify(docs(rows), N.Params(words=5, star=3, block_shingles=600)).collect()}
    assert got == want


def test_a_shared_passage_makes_no_quadratic_work(docs, monkeypatch):
    """Documents that have a passage in common, but too little of it, share no prefix shingle."""
    rng = random.Random(9)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(5))
    passage = [word() for _ in range(70)]
    rows = [(i, " ".join(passage + [word() for _ in range(25)])) for i in range(300)]
    seen = []
    lists = N.prefix_lists
    monkeypatch.setattr(N, "prefix_lists", lambda *a: seen.append(lists(*a)) or seen[0])
    monkeypatch.setattr(N, "cluster_links", None)
    drop = N.Scratch.drop
    monkeypatch.setattr(N.Scratch, "drop", lambda self, *t: drop(self, *[x for x in t if not seen or x is not seen[0]]))
    got = N.classify(docs(rows)).collect()
    assert all(r["component_id"] == r["doc_id"] for r in got) and len(got) == 300
    assert seen and seen[0].count() < 300


def test_links_that_no_star_finds(docs):
    """Vertices that are like one another but not like their bucket's hub, in lists that stay apart."""
    rng = random.Random(11)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(4))
    base = [word() for _ in range(100)]
    rows = []
    for _ in range(6):
        some = list(base)
        for j in rng.sample(range(100), 4):
            some[j] = word()
        for _ in range(7):
            other = list(some)
            for j in rng.sample(range(100), rng.randint(1, 4)):
                other[j] = word()
            rows.append(other)
    rng.shuffle(rows)
    rows = [(i, " ".join(w)) for i, w in enumerate(rows)]
    want = brute(rows, 4, 80)
    for p in (N.Params(), N.Params(star=2, block_shingles=150)):
        assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in N.classify(docs(rows), p).collect()} == want


def test_long_texts_and_clashing_columns(docs):
    rng = random.Random(12)
    long = [str(rng.random()) for _ in range(60_000)]
    rows = [(1, " ".join(long)), (2, " ".join(long[:55_000])), (3, " ".join(long[::-1])), (4, "a b c")]
    extra = ("gone_id", "hit_id", "id", "key", "a", "b", "block", "f1", "shingles", "size")
    df = docs(rows, extra=extra)
    assert {r["doc_id"]: r["component_id"] for r in N.classify(df).collect()} == {1: 1, 2: 1, 3: 3, 4: 4}
    kept = N.survivors(df)
    assert kept.columns == df.columns and sorted(r["doc_id"] for r in kept.collect()) == [1, 3, 4]


def test_components_of_paths_rings_and_copies(spark):
    from strataflow.llm.common import Scratch
    from strataflow.llm.components import components

    rng = random.Random(13)
    edges = [(i, i + 1) for i in range(40)] + [(100, 101), (101, 102), (102, 100), (200, 200), (300, 301), (301, 300)] + [(rng.randrange(500, 560), rng.randrange(500, 560)) for _ in range(45)]
    root = {}

    def top(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in edges:
        x, y = top(a), top(b)
        root[max(x, y)] = min(x, y)
    for few in (0, 10_000):  # in rounds over all tasks, and in one task
        got = {r["id"]: r["component"] for r in components(spark.createDataFrame(edges, "a long, b long"), Scratch(spark, "test"), few).collect()}
        assert got == {v: top(v) for a, b in edges if a != b for v in (a, b)}
        assert components(spark.createDataFrame([], "a long, b long"), Scratch(spark, "test"), few).count() == 0


def test_null_and_repeated_ids(docs):
    rows = [(1, "a b c d e"), (1, "a b c d e"), (None, "a b c d e"), (2, "q w e r t")]
    got = sorted(((r["doc_id"], r["component_id"], r["kept"]) for r in N.classify(docs(rows)).collect()), key=str)
    assert got == sorted([(1, 1, True), (1, 1, True), (None, None, True), (2, 2, True)], key=str)
    assert N.survivors(docs(rows)).count() == 4
    rows = [(3, "a b c d e"), (5, "a b c d e"), (5, "q w e r t y"), (9, "q w e r t y"), (7, "q w e r"), (7, "z y x w v")]
    got = sorted((r["doc_id"], r["component_id"]) for r in N.classify(docs(rows)).collect())
    assert got == [(3, 3), (5, 3), (5, 3), (7, 7), (7, 7), (9, 3)]


def test_densified_bins_agree_like_jaccard():
    rng = np.random.default_rng(0)
    sk = N.Sketcher(200)
    for size in (3, 30, 3000):
        agree = []
        for _ in range(40):
            u = np.unique(rng.integers(0, 1 << 63, size * 5 // 4 + 1, dtype=np.uint64))
            a, b = u[: len(u) - len(u) // 10], u[len(u) // 10 :]
            j = np.intersect1d(a, b).size / len(u)
            agree.append((sk(np.sort(a)) == sk(np.sort(b))).mean() - j)
        assert abs(np.mean(agree)) < 0.05

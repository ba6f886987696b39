"""Every overlap that decontamination accepts has a seed."""

from itertools import combinations

from strataflow.llm import decontaminate as D


def test_every_allowed_substitution_pattern_leaks(spark, docs):
    items, rows, want = [], [], set()
    for n in range(5, 14):
        item = [f"i{n}w{j}" for j in range(n)]
        items.append((n, " ".join(item)))
        for lost in combinations(range(n), n // 5):
            want.add((len(rows), n))
            rows.append((len(rows), " ".join("zzz" if j in lost else x for j, x in enumerate(item))))
    assert {(r["doc_id"], r["item_id"]) for r in D.leaks(docs(rows), spark.createDataFrame(items, "item_id long, text string")).collect()} == want


def test_a_lone_window_of_a_long_item_leaks_whatever_it_lost(spark, docs):
    item = [f"w{j}" for j in range(40)]
    bench = spark.createDataFrame([(0, " ".join(item))], "item_id long, text string")
    rows = [["x", *["zzz" if j in lost else w for j, w in enumerate(item[20:33])], "y"] for lost in combinations(range(13), 2)]
    clean = [["zzz" if j in (2, 6, 9) else w for j, w in enumerate(item[20:33])]]
    found = D.leaks(docs([(i, " ".join(r)) for i, r in enumerate(rows + clean)]), bench)
    assert {r["doc_id"] for r in found.collect()} == set(range(len(rows)))

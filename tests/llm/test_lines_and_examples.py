"""Line labels of the quality field, and examples of repeated ids."""

from itertools import product

import numpy as np
from strataflow.llm import quality as Q
from strataflow.llm import toxicity as T

GOOD, BAD = "A calm sentence about rivers and mills.", "$$$ ||| !!! 99 99 99 99"


def fitted(spark, docs, p=Q.Params(steps=60)):
    rows = [(i, "\n".join([GOOD + f" {i}"] * 3) if i % 2 else "\n".join([BAD] * 3)) for i in range(60)]
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(60)], "doc_id long, quality int, toxic int")
    return Q.fit(docs(rows), labels, p)


def test_line_labels_equal_all_labellings(spark, docs):
    m = fitted(spark, docs)
    texts = {1: "\n".join([GOOD, BAD, BAD, GOOD, ""]), 2: GOOD, 3: None, 4: "", None: BAD}
    out = Q.line_labels(docs(list(texts.items()), extra=("line", "good")), m).collect()
    for doc, text in texts.items():
        mine = sorted((r for r in out if r["doc_id"] == doc), key=lambda r: r["line"])
        x, w = Q.features(text)
        s = ((x - m.mean) / m.scale) @ m.weights
        total, good = 0.0, np.zeros(len(s))
        for path in product((0, 1), repeat=len(s)):
            e = np.exp(sum(s[i] for i, y in enumerate(path) if y) + sum(m.trans[a, b] for a, b in zip(path, path[1:])))
            total += e
            good += e * np.array(path)
        assert np.allclose([r["good"] for r in mine], good / total) and [r["weight"] for r in mine] == w.tolist()
        assert [r["label"] for r in mine] == [int(g >= 0.5) for g in good / total] and [r["line"] for r in mine] == list(range(len(s)))
        derived = float(m.calibrate(np.array(np.dot([r["good"] for r in mine], w) / w.sum())))
        scored = Q.score(docs([(doc, text)]), m, "q").first()["q"]
        assert np.isclose(derived, scored)
    assert Q.line_labels(docs([]), m).count() == 0
    assert {r["good"] for r in Q.line_labels(docs([(1, BAD)]), Q.fit(docs([]), spark.createDataFrame([], "doc_id long, quality int, toxic int"))).collect()} == {1.0}


def test_examples_keep_to_their_bounds(spark, docs, monkeypatch):
    """Rows that repeat a labelled id are one example; of long documents whole ones up to the bound of lines."""
    seen = []
    monkeypatch.setattr(Q, "train", lambda examples, labels, p: seen.append(examples) or "model")
    rows = [(1, "b"), (1, "a"), (1, "c")] + [(i, "x\n" * 9 + "x") for i in range(2, 40)]
    labels = spark.createDataFrame([(i, 1, 0) for i in range(40)], "doc_id long, quality int, toxic int")
    assert Q.fit(docs(rows), labels, Q.Params(example_lines=55)) == "model"
    assert sum(len(w) for _, w in seen[0]) <= 55 and len(seen[0]) in (5, 6)


def test_repeated_labelled_ids_are_one_toxic_example(spark, docs):
    rows = [(i, f"kind words here {i}" if i % 2 else f"vile rant there {i}") for i in range(40)]
    labels = spark.createDataFrame([(i, 1, 1 - i % 2) for i in range(40)], "doc_id long, quality int, toxic int")
    once, twice = T.fit(docs(rows), labels), T.fit(docs(rows + [(1, "kind words zz")] * 5), labels)
    assert sorted(once.index.ids) == sorted(twice.index.ids) and len(set(twice.index.ids)) == len(twice.index.ids)

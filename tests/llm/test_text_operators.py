"""Encoding, decontamination, toxicity and quality."""

import itertools
import math
import random
import re
import zlib

import numpy as np
import pytest
from strataflow.llm import decontaminate as D
from strataflow.llm import pieces as P
from strataflow.llm import quality as Q
from strataflow.llm import registry
from strataflow.llm import toxicity as T


@pytest.fixture(scope="module")
def vocabulary():
    return P.load()


def all_segmentations(v, s):
    """Every way to cut a string into pieces of the vocabulary, or bytes of characters without a piece."""
    if not s:
        return [(0.0, ())]
    out = []
    for k in range(1, len(s) + 1):
        if s[:k] in v.scores:
            i, score = v.scores[s[:k]]
            out += [(score + a, (i, *b)) for a, b in all_segmentations(v, s[k:])]
    if s[0] not in v.scores:
        out += [(v.penalty + a, (*[v.pieces.index(f"<0x{x:02X}>") for x in s[0].encode()], *b)) for a, b in all_segmentations(v, s[1:])]
    return sorted(out, key=lambda x: -x[0])


def test_lock_step_equals_one_by_one(vocabulary):
    rng = random.Random(5)
    lattice = P.Lattice(vocabulary)
    some = ["▁", "x" * 60, "\n", "☃☃"] + ["".join(rng.choice("▁abcdehint日é☃") for _ in range(rng.randint(1, 14))) for _ in range(400)]
    for n in (1, 2, 5):
        string, score, starts, ids = P.ManyLattices(lattice)(some, n)
        got = [(int(string[k]), float(score[k]), ids[starts[k] : starts[k + 1]].tolist()) for k in range(len(string))]
        assert got == [(i, s, list(x)) for i, w in enumerate(some) for s, x in lattice.nbest(w, n)]


def test_a_full_memo_changes_nothing(vocabulary):
    rng = random.Random(6)
    texts = [" ".join(rng.choice(["the", "of", "".join(rng.choice("abcdef") for _ in range(6)), "y" * 90]) for _ in range(80)).encode() for _ in range(40)]
    small, large = P.Encoder(vocabulary, 3, memo_bytes=30_000), P.Encoder(vocabulary, 3)
    for at in range(0, 40, 5):
        for a, b in zip(small.batch(texts[at : at + 5]), large.batch(texts[at : at + 5]), strict=True):
            assert [(s, i.tolist()) for s, i in a] == [(s, i.tolist()) for s, i in b]
    assert len(small.memo) < len(large.memo)


def test_words_are_the_texts_parts(vocabulary):
    enc = P.Encoder(vocabulary, 1)
    enc.STEP = 7
    for text in ("", " ", "a  b", "\n", " \n\n x\n y ", "a▁b ▁", "a" * 40, "é 日本  \n"):
        s = "▁" * bool(text) + text.replace(" ", "▁")
        got = [w.decode() for some in enc.divided(text.encode()) for w in some]
        assert "".join(got) == s and got == re.findall("▁+[^▁\n]*|[^▁\n]+|\n", s)


def test_nbest_equals_enumeration(vocabulary):
    lattice = P.Lattice(vocabulary)
    for s in ("▁thing", "▁a▁b", "▁éê\n☃", "▁▁x"):
        every = all_segmentations(vocabulary, s)
        want = [x for x, _ in every]
        for n in (1, 2, 5):
            found = lattice.nbest(s, n)
            assert [x for x, _ in found] == want[:n] and all((x, tuple(i)) in every for x, i in found)
        text = s[1:].replace("▁", " ")
        got, same = P.Encoder(vocabulary, 4)(text)
        assert [x for x, _ in got] == want[:4] and same
        assert all(P.decode(vocabulary, np.frombuffer(ids, np.int32)) == text for _, ids in got)


def test_encode_round_trip(spark, docs, vocabulary):
    texts = ["", None, "  two  spaces ", "naïve 日本 🙂\n\ttab", "x" * 20_000, " lead", "the the"]
    rows = list(enumerate(texts)) + [(6, "the the")]
    out = P.encode(docs(rows, extra=("ids", "score")), vocabulary, n=3)
    back = out.select("doc_id", "n_tokens", "round_trip", "nbest_scores", P.decode_column(spark, vocabulary)("ids").alias("text")).collect()
    assert len(back) == len(rows)
    for r in back:
        assert r["text"] == (texts[r["doc_id"]] or "") and r["round_trip"] and r["nbest_scores"] == sorted(r["nbest_scores"], reverse=True)
    assert next(r for r in back if r["doc_id"] == 1)["n_tokens"] == 0
    assert P.encode(docs([]), vocabulary).count() == 0


def words(rng, n):
    return ["".join(rng.choice("abcdefghij") for _ in range(5)) for _ in range(n)]


def test_leaks_tolerate_substitutions_and_leave_clean_documents(spark, docs):
    rng = random.Random(1)
    items = [words(rng, 30), words(rng, 14), words(rng, 7)]
    bench = spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate(items)] + [(3, None), (4, "too short"), (None, "x")], "item_id long, text string")

    def every(w, k):
        return [x if j % k else "zzz" for j, x in enumerate(w)]

    rows = [
        (0, words(rng, 9) + items[0] + words(rng, 4)), (1, every(items[0], 5)), (2, every(items[0], 6) + words(rng, 50)), (3, [w.upper() + "," for w in items[1]]), (4, words(rng, 3) + items[2]),
        (5, items[0][:9] + words(rng, 20)), (6, every(items[0], 3)), (7, words(rng, 300)), (8, words(rng, 500) * 20 + items[1] + words(rng, 9)), (9, items[0][::-1]), (10, items[0][5:19]),
    ]
    df = docs([(i, " ".join(w)) for i, w in rows] + [(20, None), (21, ""), (None, " ".join(items[0]))], extra=("item_id", "tokens", "hash"))
    found = {(r["doc_id"], r["item_id"]): r for r in D.leaks(df, bench).collect()}
    assert set(found) == {(0, 0), (1, 0), (2, 0), (3, 1), (4, 2), (8, 1), (10, 0)}
    assert found[0, 0]["doc_offset"] == 9 and found[0, 0]["matched_tokens"] == 30 and found[1, 0]["matched_tokens"] == 24
    assert {r["doc_id"] for r in D.survivors(df, bench).collect()} == {5, 6, 7, 9, 20, 21, None}
    assert D.survivors(df, bench.limit(0)).count() == df.count() and D.leaks(df.limit(0), bench).count() == 0


def brute_leaks(docs, items, window=13, match=0.8, least=5):
    """All (doc, item) pairs with a window of equal tokens, over every alignment."""
    cut = lambda t: [x for x in re.split(r"[^\w]+|_", (t or "").lower()) if x]
    found = set()
    for i, t in items:
        item = cut(t)
        n = len(item)
        w = min(n, window)
        if n < least:
            continue
        for d, text in docs:
            doc = cut(text)
            for diagonal in range(-n, len(doc) + 1):
                agree = [0 <= diagonal + j < len(doc) and doc[diagonal + j] == item[j] for j in range(n)]
                if any(sum(agree[k : k + w]) >= math.ceil(w * match) for k in range(n - w + 1)):
                    found.add((d, i))
                    break
    return found


def test_leaks_equal_brute_force(spark, docs):
    rng = random.Random(8)
    pool = words(rng, 40)  # few words: many accidental hits to tell from leaks
    items = [(i, " ".join(rng.choices(pool, k=rng.randint(3, 30)))) for i in range(25)]
    rows = []
    for d in range(120):
        w = rng.choices(pool, k=rng.randint(0, 40))
        if d % 2:
            some = items[rng.randrange(25)][1].split()
            at = rng.randrange(len(some))
            some = some[at:] if rng.random() < 0.3 else some
            some = [x if rng.random() > rng.choice([0.05, 0.15, 0.25]) else "zz" for x in some]
            k = rng.randint(0, len(w))
            w = w[:k] + some + w[k:]
        rows.append((d, rng.choice([" ", ", ", "\n"]).join(w)))
    want = brute_leaks(rows, items)
    assert len(want) > 30
    df = docs(rows, extra=("hit_id", "leak_id", "diagonal", "doc", "hash"))
    bench = spark.createDataFrame(items, "item_id long, text string")
    assert {(r["doc_id"], r["item_id"]) for r in D.leaks(df, bench).collect()} == want
    kept = D.survivors(df, bench)
    assert kept.columns == df.columns and {r["doc_id"] for r in kept.collect()} == {d for d, _ in rows} - {d for d, _ in want}


def test_masks_survive_regular_substitutions():
    p = D.Params()
    for period, phase in itertools.product((4, 5, 6, 7), range(7)):
        assert any(all((start + o) % period != phase % period for o in m) for m in p.masks for start in range(21))


def toxic_rows(n, seed=0):
    rng = random.Random(seed)
    plain, bad = words(rng, 60), ["idiot", "scummy", "scumbag", "trashy"]
    rows, labels = [], []
    for i in range(n):
        y = i % 4 == 0
        w = rng.choices(plain, k=rng.randint(5, 40))
        if y:
            for _ in range(rng.randint(1, 3)):
                w.insert(rng.randrange(len(w)), rng.choice(bad))
        rows.append((i, " ".join(w)))
        labels.append((i, 1, int(y)))
    return rows, labels


def test_toxicity_is_accurate_on_held_out_rows(spark, docs):
    rows, labels = toxic_rows(400)
    lab = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    df = docs(rows + [(900, None), (901, "")], extra=("toxicity", "label", "term"))
    model = T.fit(df, lab)
    long = " ".join(["plain"] * 200_000 + ["idiot"])
    scored = T.score(docs(rows + [(900, None), (901, ""), (902, long), (1, rows[1][1])], extra=("toxicity", "score")), model)
    assert scored.count() == len(rows) + 4 and scored.columns == docs([]).columns + ["toxicity", "score"]
    got = {r["doc_id"]: r["toxicity"] for r in scored.collect()}
    held = [(i, y) for i, _, y in labels if zlib.crc32(str(i).encode()) % 5 == 0]
    assert len(held) > 50 and sum((got[i]["score"] >= 0.5) != bool(y) for i, y in held) <= 2
    wrong = sum((got[i]["score"] >= 0.5) != bool(y) for i, _, y in labels)
    assert wrong <= 8 and all(0 <= s["score"] <= 1 for s in got.values()) and got[900]["score"] == got[901]["score"] < 0.5
    assert got[0]["evidence"] and got[0]["evidence"][0]["similarity"] > 0
    assert T.reject(df, lab.limit(0)).count() == df.count()


def test_ids_decide_no_score(spark, docs):
    rows, labels = toxic_rows(200)
    rows += [(1000 + i, rows[i][1]) for i in range(60)]
    labels += [(1000 + i, 1, 1 - labels[i][2]) for i in range(60)]  # equal texts, opposite labels
    model = T.fit(docs(rows), spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    ix = model.index
    one = {i: model.score(v)[0] for i, v in enumerate(((t, 1),) for t in range(len(model.terms)))}
    ix.ids = ix.ids[::-1].copy()
    assert one == {i: model.score(v)[0] for i, v in enumerate(((t, 1),) for t in range(len(model.terms)))}


@pytest.mark.parametrize("name, least", [("op9_toxicity", (0.94, 0.9, 0.8)), ("op10_quality_crf", (0.98, 0.95, 0.95))])
def test_held_out_accuracy_on_the_tables(spark, name, least):
    """Area under the curve, precision and recall of the held-out labelled rows."""
    sf = "/root/testdata/sf0.1"
    column = "toxic" if name == "op9_toxicity" else "quality"
    labels = spark.read.parquet(f"{sf}/labels.parquet").groupBy("doc_id").agg({column: "max"}).toDF("doc_id", "y")
    got = registry.queries()[name](spark, sf).filter("held_out").join(labels, "doc_id").select("score", "predicted", "y").toPandas()
    y, s, p = got["y"].to_numpy() > 0, got["score"].to_numpy(), got["predicted"].to_numpy() > 0
    pos, neg = s[y], np.sort(s[~y])
    auc = np.mean((np.searchsorted(neg, pos, "left") + np.searchsorted(neg, pos, "right")) / 2 / len(neg))
    figures = (auc, (p & y).sum() / p.sum(), (p & y).sum() / y.sum())
    print(name, figures)
    assert len(got) > 500 and all(a >= b for a, b in zip(figures, least, strict=True)), figures


def test_block_max_search_equals_full_scan():
    rng = random.Random(4)
    vectors = [tuple(sorted({rng.randrange(30): rng.randint(1, 4) for _ in range(rng.randint(1, 6))}.items())) for _ in range(300)]
    ix = T.BlockMaxIndex(vectors, list(range(300)), [rng.randrange(2) for _ in range(300)], np.array([1 + rng.random() for _ in range(30)]), 16)
    dense = np.zeros((300, 30))
    for p, (t, w) in enumerate(ix.vectors):
        dense[p, t] = w
    for q in vectors[:60]:
        t, w = ix.weigh(q)
        s = np.round(dense[:, t] @ w, 12)
        order = sorted((-s[p], p) for p in range(300) if s[p] > 0)[:10]
        assert [p for _, p in ix.search(t, w, 10)] == [p for _, p in order]


def test_quality_orders_good_and_bad(spark, docs):
    rng = random.Random(2)
    rows, labels = [], []
    for i in range(240):
        lines = [" ".join(words(rng, 9)).capitalize() + "." for _ in range(rng.randint(1, 8))]
        good = i % 5 != 0
        if not good:
            lines = [w.upper().replace(" ", "!! ") for w in lines] if i % 2 else [" ".join(x + "***" for x in w.split()) for w in lines]
        rows.append((i, "\n".join(lines)))
        labels.append((i, int(good), 0))
    lab = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    model = Q.fit(docs(rows), lab)
    got = {r["doc_id"]: r["score"] for r in Q.score(docs(rows + [(900, None), (901, ""), (902, "\n" * 3000)]), model, "score").collect()}
    assert sum((got[i] >= 0.3) != bool(y) for i, y, _ in labels) <= 3 and all(0 <= s <= 1 for s in got.values()) and got[900] == got[901]
    assert Q.fit(docs(rows), lab.limit(0)).score("x") == 1.0
    again = Q.score(docs([(1, rows[1][1]), (1, rows[1][1]), (2, "A good line.\n" * 50_000)], extra=("score", "quality", "label")), model)
    assert again.columns == docs([]).columns + ["score", "quality", "label"] and again.count() == 3
    assert Q.score(docs([]), model).count() == 0


def test_marginals_equal_enumeration():
    rng = np.random.default_rng(1)
    s, trans = rng.normal(size=5), rng.normal(size=(2, 2))
    total, good = 0.0, np.zeros(5)
    for path in itertools.product((0, 1), repeat=5):
        w = np.exp(sum(s[i] * y for i, y in enumerate(path)) + sum(trans[a, b] for a, b in itertools.pairwise(path)))
        total += w
        good += w * np.array(path)
    assert np.allclose(Q.good_share(s, np.exp(trans).ravel().tolist()), good / total)
    marginals, _, log_z = Q.forward_backward(np.c_[np.zeros(5), s], trans)
    assert np.allclose(marginals[:, 1], good / total) and np.isclose(log_z, np.log(total))


def test_gradient_is_the_likelihoods():
    rng = np.random.default_rng(2)
    data = Q.batches_by_length([(rng.normal(size=(n, 3)), y) for n, y in ((1, 1), (4, 0), (3, 1))], 1000)[0]
    w, t, e = rng.normal(size=3), rng.normal(size=(2, 2)), 1e-6
    _, gw, gt = Q.gradient(w, t, data)
    for j in range(3):
        d = np.eye(3)[j] * e
        assert np.isclose((Q.gradient(w + d, t, data)[0] - Q.gradient(w - d, t, data)[0]) / (2 * e), gw[j], atol=1e-4)
    for j in itertools.product(range(2), repeat=2):
        d = np.zeros((2, 2))
        d[j] = e
        assert np.isclose((Q.gradient(w, t + d, data)[0] - Q.gradient(w, t - d, data)[0]) / (2 * e), gt[j], atol=1e-4)

"""Toxicity by exact nearest labelled examples under TF-IDF cosine.

A bounded sample of labelled rows is the example set. Terms are whole words and word beginnings. The
dimensions of the cosine are *all* terms of the examples whose association with the label is significant
(log-likelihood ratio, ``Params.significance``); there is no limit on their number. Over all words alone the
neighbours are those of the same subject and language, whatever the label (see the README for figures).
Inverse document frequencies are counted over *all* documents. The examples are kept in an inverted index
whose postings are cut into blocks with the largest weight of each term per block: a query visits
blocks in falling order of their upper bound and stops when no block can still beat the k-th
neighbour, so the neighbours are exactly those of a full scan. Similarity-weighted votes are mapped
to probabilities by isotonic regression over leave-one-out votes.

Edge cases: null and empty texts have no terms and take the calibrated rate of examples without
terms; with no labelled example at all every score is 0. Very long texts are scored whole. Equal
similarities prefer the example whose terms sort first; ids decide nothing. A document that is labelled
twice counts as toxic if either label says so; of rows that repeat a labelled doc_id the text that sorts
first is the example. A labelled row that is scored itself has its own example among its neighbours. Repeated rows get equal scores. Extra columns pass through untouched; one that has
the added column's name is replaced.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Scratch, held_out, ship

WORD = re.compile(r"\w+")


@dataclass(frozen=True)
class Params:
    """``examples`` bounds the labelled sample, ``k`` the neighbours; ``significance`` is the least
    log-likelihood ratio of a term (15.1 is the 0.0001 point of chi-square with one degree of freedom);
    ``memo_bytes`` bounds what a task remembers of words, and of vectors, to save time."""

    examples: int = 8000
    significance: float = 15.1
    memo_bytes: int = 24 << 20
    k: int = 25
    block: int = 32
    prefix: tuple[int, int] = (3, 8)
    seed: int = 17
    evidence: int = 5


def word_terms(word: str, prefix: tuple[int, int]) -> list[str]:
    """The word itself and its beginnings, marked with a trailing star."""
    out = [word]
    for n in range(prefix[0], min(prefix[1], len(word) - 1) + 1):
        out.append(word[:n] + "*")
    return out


class Vectoriser:
    """Text to sorted (term index, count) pairs over a fixed vocabulary, with a word memo bounded in bytes."""

    def __init__(self, terms: list[str], prefix: tuple[int, int], memo_bytes: int):
        self.index = {t: i for i, t in enumerate(terms)}
        self.prefix = prefix
        self.memo: dict[str, tuple] = {}
        self.held, self.memo_bytes = 0, memo_bytes

    def __call__(self, text: str | None) -> tuple[tuple[int, int], ...]:
        if not text:
            return ()
        memo, counts = self.memo, Counter()
        for word, n in Counter(WORD.findall(text.lower())).items():
            ids = memo.get(word)
            if ids is None:
                if self.held > self.memo_bytes:
                    memo.clear()
                    self.held = 0
                ids = memo[word] = tuple([self.index[t] for t in word_terms(word, self.prefix) if t in self.index])
                self.held += 4 * len(word) + 160 + 8 * len(ids)
            for i in ids:
                counts[i] += n
        return tuple(sorted(counts.items()))


class BlockMaxIndex:
    """Examples as unit TF-IDF vectors in an inverted index with per-block maxima."""

    def __init__(self, vectors: list[tuple], ids: list[int], labels: list[int], idf: np.ndarray, block: int):
        # like examples next to one another make the bounds of a block tight
        order = sorted(range(len(ids)), key=lambda e: (vectors[e][:1], labels[e], vectors[e], ids[e]))
        self.ids = np.array([ids[e] for e in order], np.int64)
        self.labels = np.array([labels[e] for e in order], np.float64)
        self.idf, self.block = idf, block
        self.vectors = [self.weigh(vectors[e]) for e in order]
        self.blocks = -(-len(order) // block) if order else 0
        self.bound = np.zeros((len(idf), self.blocks))
        self.postings: list[list] = [[] for _ in range(self.blocks)]
        for b in range(self.blocks):
            rows = np.zeros((len(idf), min(block, len(order) - b * block)))
            for j, (terms, weights) in enumerate(self.vectors[b * block : (b + 1) * block]):
                rows[terms, j] = weights
            used = np.flatnonzero(rows.any(axis=1))
            at = np.full(len(idf), -1, np.int32)
            at[used] = np.arange(len(used))
            self.postings[b] = [at, rows[used]]
            self.bound[:, b] = rows.max(axis=1) if rows.size else 0

    def weigh(self, vector: tuple) -> tuple[np.ndarray, np.ndarray]:
        if not vector:
            return np.zeros(0, np.int64), np.zeros(0)
        terms = np.array([t for t, _ in vector])
        weights = (1 + np.log(np.array([n for _, n in vector], float))) * self.idf[terms]
        return terms, weights / math.sqrt(float(weights @ weights))

    def search(self, terms: np.ndarray, weights: np.ndarray, k: int, skip: int = -1) -> list[tuple[float, int]]:
        """The k best (similarity, position), ties by position; positive similarities only."""
        if not len(terms) or not self.blocks:
            return []
        upper = weights @ self.bound[terms]
        best: list[tuple[float, int]] = []
        kth = 0.0
        for b in np.argsort(-upper, kind="stable"):
            if upper[b] <= 0 or len(best) == k and upper[b] < kth - 1e-12:
                break
            at, rows = self.postings[b]
            rank = at[terms]
            have = rank >= 0
            scores = weights[have] @ rows[rank[have]]
            near = np.flatnonzero((scores > 0) & (scores >= (kth - 1e-12 if len(best) == k else 0)))
            base = b * self.block
            best += [(-round(float(scores[j]), 12), int(base + j)) for j in near if base + j != skip]
            best.sort()
            del best[k:]
            kth = -best[-1][0] if best else 0.0
        return [(-s, p) for s, p in best]


def isotonic(votes: np.ndarray, labels: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pool-adjacent-violators fit: knots and a non-decreasing probability at each."""
    order = np.argsort(votes, kind="stable")
    groups: list[list[float]] = []
    for v, y in zip(votes[order], labels[order], strict=True):
        if groups and groups[-1][3] == v:
            groups[-1][0] += y
            groups[-1][1] += 1
        else:
            groups.append([y, 1, v, v])
        while len(groups) > 1 and groups[-2][0] * groups[-1][1] >= groups[-1][0] * groups[-2][1]:
            y2, n2, _, hi = groups.pop()
            groups[-1][0] += y2
            groups[-1][1] += n2
            groups[-1][3] = hi
    xs, ps = [], []
    for y, n, lo, hi in groups:
        xs += [lo, hi]
        ps += [(y + 0.5) / (n + 1)] * 2
    return np.array(xs), np.maximum.accumulate(np.array(ps))


@dataclass
class Model:
    """A fitted index: bounded by ``Params``, so it is shipped whole to every task."""

    params: Params
    terms: list[str]
    index: BlockMaxIndex
    knots: tuple[np.ndarray, np.ndarray]
    base: float

    def votes(self, vector: tuple, skip: int = -1) -> tuple[float | None, list]:
        near = self.index.search(*self.index.weigh(vector), self.params.k, skip)
        if not near:
            return None, []
        w = np.array([s for s, _ in near]) ** 2
        return float(w @ self.index.labels[[p for _, p in near]] / w.sum()), near

    def score(self, vector: tuple) -> tuple[float, list]:
        vote, near = self.votes(vector)
        if vote is None:
            return self.base, []
        return float(np.interp(vote, *self.knots)), near


def fit(docs: DataFrame, labels: DataFrame, params: Params = Params()) -> Model:
    """Fit on labelled rows that are not held out. Only the example sample is bounded; document
    frequencies cover every row of ``docs``."""
    spark = docs.sparkSession
    scratch = Scratch(spark, "toxicity")
    sample = (
        labels.filter(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
        .groupBy("doc_id")
        .agg(F.max("toxic").cast("int").alias("label"))
        .orderBy(F.xxhash64(F.lit(params.seed), "doc_id"), "doc_id")
        .limit(params.examples)
    )
    texts = docs.select(F.col("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    few = max(1, min(16, params.examples // 500))
    # one row a labelled document, also where rows repeat its id: the text that sorts first
    once = texts.join(F.broadcast(sample), "doc_id").groupBy("doc_id").agg(F.min("text").alias("text"), F.first("label").alias("label"))
    examples = scratch.keep(once.repartition(few, "doc_id"), "examples")

    prefix = params.prefix

    def counts(batches):
        seen: Counter = Counter()
        for pdf in batches:
            for text, label in zip(pdf["text"], pdf["label"], strict=True):
                words = set(WORD.findall(text.lower()))
                for t in {t for w in words for t in word_terms(w, prefix)}:
                    seen[t, label > 0] += 1
        if seen:
            yield pd.DataFrame({"term": [t for t, _ in seen], "pos": [n if y else 0 for (_, y), n in seen.items()], "neg": [0 if y else n for (_, y), n in seen.items()]})

    by_label = examples.groupBy().agg(F.count("*").alias("n"), F.coalesce(F.sum((F.col("label") > 0).cast("int")), F.lit(0)).alias("pos")).first()
    n, pos = by_label["n"], by_label["pos"]
    if not n:
        return Model(params, [], BlockMaxIndex([], [], [], np.ones(0), params.block), (np.zeros(1), np.zeros(1)), 0.0)
    table = examples.mapInPandas(counts, "term string, pos long, neg long").groupBy("term").agg(F.sum("pos").alias("a"), F.sum("neg").alias("b"))
    a, b = F.col("a").cast("double"), F.col("b").cast("double")
    df = a + b
    part = lambda x, e: F.when(x > 0, x * F.log(x / e)).otherwise(0.0)
    g2 = 2 * (
        part(a, df * (pos / n)) + part(b, df * ((n - pos) / n))
        + part(F.lit(float(pos)) - a, (F.lit(float(n)) - df) * (pos / n)) + part(F.lit(float(n - pos)) - b, (F.lit(float(n)) - df) * ((n - pos) / n))
    )
    # only terms of the bounded examples, and of these only what tells the labels apart
    terms = sorted(r["term"] for r in table.filter(F.round(g2, 6) > params.significance).select("term").collect())

    frequency = document_frequencies(docs, terms, params)
    total = docs.count()
    idf = np.array([math.log((total + 1) / (frequency.get(i, 0) + 1)) + 1 for i in range(len(terms))])

    def vectors(batches):
        vec = Vectoriser(terms, prefix, params.memo_bytes)
        for pdf in batches:
            found = [vec(t) for t in pdf["text"]]
            yield pd.DataFrame({"doc_id": pdf["doc_id"], "label": pdf["label"], "i": [[t for t, _ in v] for v in found], "n": [[c for _, c in v] for v in found]})

    rows = examples.mapInPandas(vectors, "doc_id long, label int, i array<int>, n array<int>").collect()  # at most params.examples rows
    scratch.drop(examples)
    rows.sort(key=lambda r: (r["doc_id"], r["i"]))
    vecs = [tuple(zip(r["i"], r["n"], strict=True)) for r in rows]
    labels_of = [int(r["label"] > 0) for r in rows]
    none = [y for v, y in zip(vecs, labels_of, strict=True) if not v]
    kept = [e for e in range(len(rows)) if vecs[e]]
    model = Model(params, terms, BlockMaxIndex([vecs[e] for e in kept], [rows[e]["doc_id"] for e in kept], [labels_of[e] for e in kept], idf, params.block), (np.zeros(1), np.zeros(1)), (sum(none) + 0.5 * pos / n) / (len(none) + 0.5))
    ix = model.index
    votes, ys = [], []
    for p, (t, w) in enumerate(ix.vectors):
        near = ix.search(t, w, params.k, skip=p)
        if near:
            s = np.array([x for x, _ in near]) ** 2
            votes.append(float(s @ ix.labels[[q for _, q in near]] / s.sum()))
            ys.append(ix.labels[p])
    if votes:
        model.knots = isotonic(np.array(votes), np.array(ys))
    return model


def document_frequencies(docs: DataFrame, terms: list[str], params: Params) -> dict[int, int]:
    """In how many of all documents each vocabulary term occurs; tasks emit one count per term."""

    def count(batches):
        vec, seen = Vectoriser(terms, params.prefix, params.memo_bytes), np.zeros(len(terms), np.int64)
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                for text in batch.column(0).slice(at, 256).to_pylist():
                    for i, _ in vec(text):
                        seen[i] += 1
        used = np.flatnonzero(seen)
        import pyarrow as pa

        yield pa.RecordBatch.from_pydict({"i": pa.array(used, pa.int32()), "n": pa.array(seen[used], pa.int64())})

    counts = docs.select(F.col("text").cast("string")).mapInArrow(count, "i int, n long").groupBy("i").agg(F.sum("n").alias("n"))
    return {r["i"]: r["n"] for r in counts.collect()}  # at most one row per vocabulary term


SCORE = T.StructType(
    [
        T.StructField("score", T.DoubleType()),
        T.StructField("evidence", T.ArrayType(T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("similarity", T.DoubleType()), T.StructField("label", T.IntegerType())]))),
    ]
)


def scorer(spark, model: Model):
    """A column function text -> (score, evidence)."""
    shipped = ship(spark, model)  # bounded by Params
    state: dict = {}

    @F.pandas_udf(SCORE)
    def score(text: pd.Series) -> pd.DataFrame:
        m: Model = shipped.value
        if "vec" not in state:
            state["vec"], state["memo"], state["held"] = Vectoriser(m.terms, m.params.prefix, m.params.memo_bytes), {}, 0
        vec, memo = state["vec"], state["memo"]
        scores, evidence = [], []
        for t in text:
            v = vec(t)
            got = memo.get(v)
            if got is None:
                if state["held"] > m.params.memo_bytes:
                    memo.clear()
                    state["held"] = 0
                state["held"] += 120 * len(v) + 300 * m.params.evidence
                s, near = m.score(v)
                got = memo[v] = (s, [{"doc_id": int(m.index.ids[p]), "similarity": x, "label": int(m.index.labels[p])} for x, p in near[: m.params.evidence]])
            scores.append(got[0])
            evidence.append(got[1])
        return pd.DataFrame({"score": scores, "evidence": evidence})

    return score


def score(docs: DataFrame, model: Model, name: str = "toxicity") -> DataFrame:
    """``docs`` with a struct column ``name``: score in 0..1 and the nearest labelled examples."""
    return docs.withColumn(name, scorer(docs.sparkSession, model)(F.col("text").cast("string")))


def reject(docs: DataFrame, labels: DataFrame, params: Params = Params(), threshold: float = 0.5) -> DataFrame:
    """The rows of ``docs`` whose score is below ``threshold``, columns unchanged."""
    model = fit(docs, labels, params)
    return docs.filter(scorer(docs.sparkSession, model)(F.col("text"))["score"] < threshold)

"""Document quality by a linear-chain conditional random field over lines.

A document is a chain of its lines. Each line has features of its own (length, shares of letters,
upper case, digits and symbols, repeated and frequent words) and of its neighbours (the same values of
the line before and after, whether it repeats an earlier line, how much the two differ). The field has
two states, good and bad; state scores are linear in the features and a transition matrix ties
neighbouring lines together. Forward-backward gives each line's probability of being good, and the
length-weighted mean over the lines is the document's score, passed through a calibration that was
fitted on training documents only.

Training needs line labels but documents are labelled as wholes, so every line of a labelled document
takes its label; the transitions and the length-weighted mean then settle what single lines cannot.
The weights are fitted by gradient descent on the regularised conditional likelihood over a bounded
sample of labelled rows: at most ``Params.examples`` documents, taken in hash order, and of these as many whole ones as
have ``Params.example_lines`` lines together. Tasks make their features; the driver sees numbers only.

``line_labels`` gives every line's label and marginal; a document's score is derived from the same marginals.

Edge cases: null and empty texts are one empty line. Of rows that repeat a labelled doc_id, the text that sorts first is
its example. Very long texts are scored whole, in memory in
proportion to their number of lines. Without any labelled row every score is the neutral 1.0 (nothing is
judged bad). A document labelled twice takes its smaller quality. Repeated rows get equal scores. Extra
columns pass through; one that has the added column's name is replaced. An empty table gives an empty result.
"""

from __future__ import annotations

import re
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, held_out, ship


@dataclass(frozen=True)
class Params:
    examples: int = 4000
    example_lines: int = 400_000
    batch_lines: int = 30_000
    steps: int = 300
    rate: float = 0.05
    l2: float = 1e-3
    seed: int = 29


LETTERS = re.compile(r"[^\W\d_]+")
DIGITS = re.compile(r"\d+")
SYMBOLS = re.compile(r"[^\w\s]")
OWN = 12


def line_values(line: str) -> list[float]:
    """A line's own values, each roughly in 0..1."""
    n = len(line)
    if not n:
        return [1.0] + [0.0] * (OWN - 1)
    words = line.split()
    m = max(1, len(words))
    runs = LETTERS.findall(line)
    letters = sum(map(len, runs))
    upper = sum([len(r) for r in runs if r.isupper() and len(r) > 1])
    symbols = len(SYMBOLS.findall(line))
    distinct = len(set(words))
    top = max(Counter(words).values()) if words else 0
    stop = line[-1] in ".!?:"
    return [
        0.0, min(1.0, n / 400), letters / n, upper / max(1, letters), sum(map(len, DIGITS.findall(line))) / n, min(1.0, symbols / n * 4), distinct / m, top / m, float(stop),
        min(1.0, letters / max(1, len(runs)) / 12), min(1.0, m / 60), min(1.0, (line.count("|") + line.count("!") + line.count("/")) / m),
    ]


def features(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """(lines x features, line weights). Columns: bias, own values, before, after, and contrasts."""
    lines = (text or "").split("\n")
    own = np.array([line_values(line) for line in lines])
    seen: set[int] = set()
    repeats = np.zeros((len(lines), 2))
    for i, line in enumerate(lines):
        h = hash(line)
        repeats[i, 0] = h in seen
        repeats[i, 1] = i > 0 and line == lines[i - 1]
        seen.add(h)
    before = np.vstack([np.zeros((1, OWN)), own[:-1]])
    after = np.vstack([own[1:], np.zeros((1, OWN))])
    edge = np.zeros((len(lines), 2))
    edge[0, 0] = edge[-1, 1] = 1
    squares = own[:, 2:8] ** 2
    x = np.hstack([np.ones((len(lines), 1)), own, squares, before, after, np.abs(own - before)[:, 1:8], repeats, edge])
    return x, np.array([len(line) + 1.0 for line in lines])


def forward_backward(scores: np.ndarray, trans: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
    """Marginals (n x 2), summed pair marginals (2 x 2) and log partition of one chain."""
    n = len(scores)
    top = scores.max(axis=1, keepdims=True)
    e, t = np.exp(scores - top), np.exp(trans)
    a, b, c = np.empty((n, 2)), np.ones((n, 2)), np.empty(n)
    cur = e[0]
    for i in range(n):
        if i:
            cur = (cur @ t) * e[i]
        c[i] = cur[0] + cur[1]
        cur = cur / c[i]
        a[i] = cur
    for i in range(n - 2, -1, -1):
        b[i] = t @ (e[i + 1] * b[i + 1]) / c[i + 1]
    pairs = np.zeros((2, 2))
    if n > 1:
        pairs = t * np.einsum("ni,nj->ij", a[:-1], e[1:] * b[1:] / c[1:, None])
    return a * b, pairs, float(np.log(c).sum() + top.sum())


def good_share(scores: np.ndarray, t: list[float]) -> list[float]:
    """Marginal probability of state 1 (good) per line; plain floats, as most chains are short."""
    t00, t01, t10, t11 = t
    fwd, x, y = [], 0.5, 0.5
    ratio = np.exp(np.clip(scores, -30, 30)).tolist()
    for i, r in enumerate(ratio):
        if i:
            x, y = x * t00 + y * t10, (x * t01 + y * t11) * r
        else:
            x, y = 1.0, r
        z = x + y
        x, y = x / z, y / z
        fwd.append((x, y))
    out, p, q = [0.0] * len(ratio), 1.0, 1.0
    for i in range(len(ratio) - 1, -1, -1):
        x, y = fwd[i]
        g, b = y * q, x * p
        out[i] = g / (g + b)
        r = ratio[i]
        p, q = t00 * p + t01 * r * q, t10 * p + t11 * r * q
        z = p + q
        p, q = p / z, q / z
    return out


@dataclass
class Model:
    """State weights of good against bad, transition scores, and the calibration's slope and offset."""

    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    trans: np.ndarray
    slope: float = 1.0
    offset: float = 0.0
    fitted: bool = True

    def marginals(self, x: np.ndarray) -> np.ndarray:
        """Each line's probability of being good, from the features of a document's lines."""
        s = ((x - self.mean) / self.scale) @ self.weights
        return np.array(good_share(s, np.exp(self.trans).ravel().tolist()))

    def lines(self, text: str | None) -> tuple[np.ndarray, np.ndarray]:
        """Marginals and weights of a document's lines."""
        x, w = features(text)
        return self.marginals(x) if self.fitted else np.ones(len(x)), w

    def raw(self, text: str | None) -> float:
        p, w = self.lines(text)
        return float(p @ w / w.sum())

    def calibrate(self, raw):
        z = np.log(np.clip(raw, 1e-6, 1 - 1e-6) / (1 - np.clip(raw, 1e-6, 1 - 1e-6)))
        return 1 / (1 + np.exp(-np.clip(self.slope * z + self.offset, -40, 40)))

    def score(self, text: str | None) -> float:
        return float(self.calibrate(np.array(self.raw(text)))) if self.fitted else 1.0


def batches_by_length(chains: list, lines: int) -> list[tuple]:
    """Chains padded to similar lengths, at most ``lines`` padded lines (or one chain) together:
    (features, mask, labels)."""
    groups: list[list] = [[]]
    for chain in sorted(chains, key=lambda c: len(c[0])):
        if groups[-1] and (len(groups[-1]) == 256 or (len(groups[-1]) + 1) * len(chain[0]) > lines):
            groups.append([])
        groups[-1].append(chain)
    out = []
    for some in groups:
        n = max(len(x) for x, _ in some)
        x = np.zeros((len(some), n, some[0][0].shape[1]))
        mask = np.zeros((len(some), n))
        for j, (f, _) in enumerate(some):
            x[j, : len(f)], mask[j, : len(f)] = f, 1
        out.append((x, mask, np.array([y for _, y in some], float)))
    return out


def gradient(weights: np.ndarray, trans: np.ndarray, batch: tuple) -> tuple[float, np.ndarray, np.ndarray]:
    """Log likelihood of all-good or all-bad label chains and its gradient, for one padded batch.

    Each chain counts by 1/length, so long documents don't outweigh the others.
    """
    x, mask, y = batch
    m, n, _ = x.shape
    lengths = mask.sum(axis=1)
    s = x @ weights
    e = np.stack([np.ones_like(s), np.exp(np.clip(s, -30, 30))], axis=2)
    t = np.exp(trans)
    a, b, c = np.zeros((m, n, 2)), np.ones((m, n, 2)), np.ones((m, n))
    cur = e[:, 0]
    for i in range(n):
        if i:
            cur = np.where(mask[:, i, None] > 0, (cur @ t) * e[:, i], cur)
        z = cur.sum(axis=1)
        c[:, i] = np.where(mask[:, i] > 0, z, 1)
        cur = cur / z[:, None]
        a[:, i] = cur
    for i in range(n - 2, -1, -1):
        b[:, i] = np.where(mask[:, i + 1, None] > 0, (e[:, i + 1] * b[:, i + 1]) @ t.T / c[:, i + 1, None], 1.0)
    good = a[:, :, 1] * b[:, :, 1] * mask
    per = 1 / lengths
    pair_mask = mask[:, 1:] * per[:, None]
    pairs = t * np.einsum("mni,mnj,mn->ij", a[:, :-1], e[:, 1:] * b[:, 1:] / c[:, 1:, None], pair_mask)
    seen = np.zeros((2, 2))
    inner = ((lengths - 1) * per)
    seen[1, 1], seen[0, 0] = (inner * y).sum(), (inner * (1 - y)).sum()
    ll = float(((y * (s * mask).sum(axis=1) + (lengths - 1) * np.where(y > 0, trans[1, 1], trans[0, 0])) * per - np.log(c).sum(axis=1) * per).sum())
    gw = np.einsum("mnf,mn->f", x, (y[:, None] * mask - good) * per[:, None])
    return ll, gw, seen - pairs


def train(examples: list[tuple[np.ndarray, np.ndarray]], labels: list[int], p: Params) -> Model:
    """Fit weights, transitions and calibration on the features and line weights of the given (bounded) examples."""
    chains = [x for x, _ in examples]
    rows = np.concatenate(chains)
    mean, scale = rows.mean(axis=0), rows.std(axis=0) + 1e-6
    mean[0], scale[0] = 0, 1
    data = batches_by_length([((x - mean) / scale, y) for x, y in zip(chains, labels, strict=True)], p.batch_lines)
    share = np.array([len(b[2]) for b in data]) / len(chains)
    w, t = np.zeros(rows.shape[1]), np.array([[0.3, 0.0], [0.0, 0.3]])
    m = [np.zeros_like(w), np.zeros_like(t)]
    v = [np.zeros_like(w), np.zeros_like(t)]
    rng = np.random.default_rng(p.seed)
    for step in range(1, p.steps + 1):
        batch = data[rng.choice(len(data), p=share)]
        _, gw, gt = gradient(w, t, batch)
        k = len(batch[2])
        for i, (value, g) in enumerate(((w, gw / k - p.l2 * w), (t, gt / k - p.l2 * t))):
            m[i] = 0.9 * m[i] + 0.1 * g
            v[i] = 0.999 * v[i] + 0.001 * g * g
            value += p.rate * (m[i] / (1 - 0.9**step)) / (np.sqrt(v[i] / (1 - 0.999**step)) + 1e-8)
    model = Model(mean, scale, w, t)
    raw = np.array([float(model.marginals(x) @ w / w.sum()) for x, w in examples])
    y = np.array(labels, float)
    z = np.log(np.clip(raw, 1e-6, 1 - 1e-6) / (1 - np.clip(raw, 1e-6, 1 - 1e-6)))
    slope, offset = 1.0, 0.0
    for _ in range(50):  # Newton steps of a one-variable logistic fit
        q = 1 / (1 + np.exp(-np.clip(slope * z + offset, -40, 40)))
        g = np.array([((y - q) * z).sum() - 1e-2 * slope, (y - q).sum()])
        r = q * (1 - q) + 1e-6
        h = np.array([[(r * z * z).sum() + 1e-2, (r * z).sum()], [(r * z).sum(), r.sum()]])
        d = np.linalg.solve(h, g)
        slope, offset = slope + float(np.clip(d[0], -1, 1)), offset + float(np.clip(d[1], -1, 1))
    model.slope, model.offset = max(slope, 1e-3), offset
    return model


def fit(docs: DataFrame, labels: DataFrame, p: Params = Params()) -> Model:
    """Fit on a bounded sample of labelled rows that are not held out, taken in hash order."""
    spark = docs.sparkSession
    scratch = Scratch(spark, "quality")
    usable = labels.filter(F.col("quality").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.min("quality").cast("int").alias("label"))
    sample = usable.orderBy(F.xxhash64(F.lit(p.seed), "doc_id"), "doc_id").limit(p.examples)
    texts = docs.select("doc_id", F.coalesce(F.col("text"), F.lit("")).alias("text")).join(F.broadcast(sample), "doc_id")
    once = texts.groupBy("doc_id").agg(F.min("text").alias("text"), F.first("label").alias("label"))
    found = scratch.keep(once.mapInArrow(_example_features, "doc_id long, label int, lines long, x binary, w binary"), "examples")
    # at most Params.examples small rows tell which whole documents fit the lines
    sizes = sorted((r["h"], r["doc_id"], r["lines"]) for r in found.select(F.xxhash64(F.lit(p.seed), "doc_id").alias("h"), "doc_id", "lines").collect())
    kept, total = [], 0
    for _, doc, lines in sizes:
        if total + lines <= p.example_lines:
            kept.append(doc)
            total += lines
    rows = found.filter(F.col("doc_id").isin(kept)).select("doc_id", "label", "lines", "x", "w").collect() if kept else []
    scratch.drop(found)
    rows.sort(key=lambda r: r["doc_id"])
    if not rows:
        z = np.zeros(1)
        return Model(z, z + 1, z, np.zeros((2, 2)), fitted=False)
    examples = [(np.frombuffer(r["x"], np.float64).reshape(r["lines"], -1), np.frombuffer(r["w"], np.float64)) for r in rows]
    return train(examples, [int(r["label"] > 0) for r in rows], p)


def _example_features(batches):
    for batch in batches:
        ids, labels = batch.column(0).to_pylist(), batch.column(2).to_pylist()
        for at in range(0, len(ids), 64):
            found = [features(t) for t in batch.column(1).slice(at, 64).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids[at : at + 64], pa.int64()), pa.array(labels[at : at + 64], pa.int32()), pa.array([len(w) for _, w in found], pa.int64()), pa.array([x.tobytes() for x, _ in found]), pa.array([w.tobytes() for _, w in found])],
                names=["doc_id", "label", "lines", "x", "w"],
            )


def line_labels(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, line, weight, good, label) of every line: its number from 0, its length and one more, its probability of
    being good, and whether that is at least a half."""
    shipped = ship(docs.sparkSession, model)
    schema = pa.schema([("doc_id", pa.int64()), ("line", pa.int64()), ("weight", pa.int64()), ("good", pa.float64()), ("label", pa.int32())])

    def run(batches):
        m = shipped.value
        for batch in batches:
            ids = batch.column(0).to_pylist()
            for at in range(0, len(ids), 64):
                for doc, text in zip(ids[at : at + 64], batch.column(1).slice(at, 64).to_pylist(), strict=True):
                    p, w = m.lines(text)
                    for first in range(0, len(p), 8192):
                        some = p[first : first + 8192]
                        n = len(some)
                        yield pa.RecordBatch.from_arrays([pa.array([doc] * n, pa.int64()), pa.array(np.arange(first, first + n)), pa.array(w[first : first + n].astype(np.int64)), pa.array(some), pa.array((some >= 0.5).astype(np.int32))], schema=schema)

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, line long, weight long, good double, label int")


def scorer(spark, model: Model):
    """A column function text -> score in 0..1."""
    shipped = ship(spark, model)  # a few hundred numbers

    @F.pandas_udf("double")
    def score(text: pd.Series) -> pd.Series:
        m = shipped.value
        return pd.Series([m.score(t) for t in text])

    return score


def score(docs: DataFrame, model: Model, name: str = "quality") -> DataFrame:
    return docs.withColumn(name, scorer(docs.sparkSession, model)(F.col("text")))

"""Importance resampling towards a target distribution over hashed n-grams.

*Features.* A task collects texts into blocks, numbers the block's distinct words and sorts the block's positions
by the word ids that follow them (a suffix array to the depth of the longest n-gram). Neighbours' common prefix
lengths split the array into runs of equal n-grams; each run is hashed once, and its bucket is scattered back to
the run's occurrences. A text longer than a block goes through several, with the overlap that its n-grams need.
*Weights.* Bucket counts of the corpus and of the target give each bucket a gain, the log of the ratio of its
smoothed shares; a document's weight is the mean gain of its features. The buckets of each occurrence are
written once, so texts are read and tokenised once.
*Draw.* Weight plus a keyed Gumbel number ranks the documents; the highest are a sample without replacement.
Ranks come from a range sort of narrow rows.

Edge cases: a null or empty text has no features and weight 0, and is drawn like any other document only if
``min_words`` is 0. A null doc_id counts as the empty text in the key and comes last in ties; rows that repeat a
doc_id are scored and ranked one by one. Very long texts are used whole. An empty corpus gives no rows; an empty
target gives the gains of its zero counts. Extra columns, whatever their names, are ignored.
"""

from __future__ import annotations

import re
import zlib
from dataclasses import dataclass
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.ranks import numbered
from .common import Scratch

#: Words in UTF-8 after lower-casing A-Z: runs of anything but ASCII characters that are neither digits nor letters.
WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


@dataclass(frozen=True)
class Params:
    """n-gram lengths, buckets, words a drawable document has, percent drawn, key of the draw, words of a block."""

    shortest: int = 1
    longest: int = 1
    buckets: int = 10_000
    min_words: int = 20
    percent: int = 10
    seed: str = "2024"
    block_words: int = 400_000


def suffix_array(ids: np.ndarray, left: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions ordered by the ``depth`` ids from each on, and the common prefix length of each with the one before it.

    ``left`` is how many words a position's document has from there on: sequences end with their document.
    """
    n = len(ids)
    columns = []
    for j in range(depth):
        c = np.zeros(n, np.int64)
        c[: max(0, n - j)] = ids[j:] + 1
        c[left <= j] = 0
        columns.append(c)
    order = np.lexsort(columns[::-1]) if depth > 1 else np.argsort(columns[0], kind="stable")
    common, same = np.zeros(n, np.int64), np.ones(max(0, n - 1), bool)
    for c in columns:
        s = c[order]
        same &= (s[1:] == s[:-1]) & (s[1:] > 0)
        common[1:] += same
    return order, common


class Block:
    """Pieces of documents whose n-grams are bucketed together."""

    def __init__(self, p: Params):
        self.p, self.words, self.lengths, self.counted = p, [], [], []

    def add(self, words: list[bytes], counted: int) -> None:
        """A piece: its words, and how many of them may begin an n-gram."""
        self.words += words
        self.lengths.append(len(words))
        self.counted.append(counted)

    def buckets(self) -> list[np.ndarray]:
        """Per piece, the bucket of every n-gram occurrence."""
        p, seen = self.p, {}
        ids = np.array([seen.setdefault(w, len(seen)) for w in self.words], np.int64)
        lengths = np.array(self.lengths, np.int64)
        starts = np.cumsum(lengths) - lengths
        at = np.arange(len(ids)) - np.repeat(starts, lengths)
        left = np.repeat(lengths, lengths) - at
        counts = at < np.repeat(np.array(self.counted, np.int64), lengths)
        order, common = suffix_array(ids, left, p.longest)
        per: list[list[np.ndarray]] = [[] for _ in self.lengths]
        for n in range(p.shortest, p.longest + 1):
            found = np.full(len(ids), -1, np.int64)
            bounds = np.flatnonzero(common < n)  # where an n-gram differs from the one before
            valid = left[order] >= n
            hashed = np.zeros(len(bounds), np.int64)
            for k, b in enumerate(bounds.tolist()):
                if valid[b]:
                    first = order[b]
                    hashed[k] = zlib.crc32(b" ".join(self.words[first : first + n])) % p.buckets
            sizes = np.diff(np.append(bounds, len(order)))
            found[order] = np.where(valid, np.repeat(hashed, sizes), -1)
            found[~counts] = -1
            for i, (s, m) in enumerate(zip(starts.tolist(), self.lengths, strict=True)):
                some = found[s : s + m]
                per[i].append(some[some >= 0])
        return [np.concatenate(x) for x in per]


def pieces(data: bytes, p: Params):
    """A text's words in pieces of at most a block, each with the words its last n-grams reach into."""
    overlap, words, more = p.longest - 1, [], WORD.finditer(data)
    while True:
        words += [m.group() for m in islice(more, p.block_words + overlap - len(words))]
        if len(words) < p.block_words + overlap:
            yield words, len(words)
            return
        yield words, p.block_words
        words = words[p.block_words :]


SCHEMA = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_features", pa.int64()), ("occurrences", pa.binary())])
SCHEMA_DDL = "doc_id long, n_words long, n_features long, occurrences binary"


def _features(p: Params):
    kind = np.uint16 if p.buckets <= 1 << 16 else np.uint32

    def run(batches):
        block, waiting = Block(p), []  # documents with the number of their pieces in the block

        def rows(done):
            return pa.RecordBatch.from_arrays([pa.array([d[i] for d in done], f.type) for i, f in enumerate(SCHEMA)], schema=SCHEMA)

        def flush(complete: bool):
            """Rows of the documents in the block; the last one stays if it has more pieces to come."""
            nonlocal block, waiting
            found, at, done = block.buckets(), 0, []
            for doc in waiting:
                doc["out"] += [b.astype(kind).tobytes() for b in found[at : at + doc["pieces"]]]
                at += doc["pieces"]
                doc["pieces"] = 0
            block, rest = Block(p), [] if complete else waiting[-1:]
            for doc in waiting[: len(waiting) - len(rest)]:
                data = b"".join(doc["out"])
                done.append((doc["id"], doc["words"], len(data) // kind().itemsize, data))
            waiting = rest
            return rows(done)

        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                waiting.append({"id": doc_id, "words": 0, "pieces": 0, "out": []})
                for words, counted in pieces((text or "").encode("utf-8", "surrogatepass").lower(), p):
                    if len(block.words) + len(words) > p.block_words and block.words:
                        yield flush(False)
                    block.add(words, counted)
                    waiting[-1]["pieces"] += 1
                    waiting[-1]["words"] += counted
                if len(waiting) >= 8192:
                    yield flush(True)
        if waiting:
            yield flush(True)

    return run


def features(rows: DataFrame, p: Params = Params(), id_column: str = "doc_id") -> DataFrame:
    """Per row: doc_id, n_words, n_features, and the bucket of every n-gram occurrence as packed little-endian integers."""
    return rows.select(F.col(id_column).cast("long"), F.col("text").cast("string")).mapInArrow(_features(p), SCHEMA_DDL)


def _counts(p: Params):
    kind = np.uint16 if p.buckets <= 1 << 16 else np.uint32

    def run(batches):
        total = np.zeros(p.buckets, np.int64)
        for batch in batches:
            for data in batch.column(0):
                total += np.bincount(np.frombuffer(data.as_py(), kind), minlength=p.buckets)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int64()), pa.array(total[some])], names=["bucket", "n"])

    return run


def counts(found: DataFrame, p: Params = Params()) -> DataFrame:
    """bucket, n over all occurrences of ``features`` rows."""
    return found.select("occurrences").mapInArrow(_counts(p), "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n"))


def gains(corpus: DataFrame, target: DataFrame, p: Params = Params()) -> DataFrame:
    """bucket, gain for every bucket: 1000 times the log ratio of the smoothed shares, floored."""
    spark = corpus.sparkSession
    s, t = corpus.select("bucket", F.col("n").alias("s")), target.select("bucket", F.col("n").alias("t"))
    both = spark.range(p.buckets).withColumnRenamed("id", "bucket").join(s, "bucket", "left").join(t, "bucket", "left").fillna(0)
    sums = both.agg(F.sum("s").cast("double").alias("all_s"), F.sum("t").cast("double").alias("all_t"))  # one row
    d = lambda c: F.col(c).cast("double")
    ratio = (d("t") + 1) * (F.col("all_s") + p.buckets) / ((d("s") + 1) * (F.col("all_t") + p.buckets))
    return both.crossJoin(F.broadcast(sums)).select("bucket", F.floor(1000 * F.ln(ratio)).alias("gain"))


def _weights(values: np.ndarray, p: Params):
    kind = np.uint16 if p.buckets <= 1 << 16 else np.uint32
    schema = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_features", pa.int64()), ("weight", pa.int64())])

    def run(batches):
        for batch in batches:
            sums = [int(values[np.frombuffer(x.as_py(), kind)].sum()) for x in batch.column(3)]
            ns = batch.column(2).to_pylist()
            mean = [s // n if n else 0 for s, n in zip(sums, ns, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(2), pa.array(mean, pa.int64())], schema=schema)

    return run


def resample(docs: DataFrame, target: DataFrame, p: Params = Params(), target_id: str = "item_id", scratch: Scratch | None = None) -> DataFrame:
    """Every row of ``docs``: doc_id, n_features, weight, score, and rank among the drawn (null if not drawn)."""
    scratch = scratch or Scratch(docs.sparkSession, "resampling")
    found = scratch.keep(features(docs, p), "occurrences")
    table = gains(counts(found, p), counts(features(target, p, target_id), p), p).collect()  # one row a bucket
    values = np.zeros(p.buckets, np.int64)
    for r in table:
        values[r["bucket"]] = r["gain"]
    weighed = found.mapInArrow(_weights(values, p), "doc_id long, n_words long, n_features long, weight long")
    key = F.concat(F.lit(f"{p.seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(key, 256), 1, 8), 16, 10).cast("double")
    noise = F.floor(-1000 * F.ln(-F.ln((h + 0.5) / F.lit(4294967296.0))))
    scored = scratch.keep(weighed.withColumn("score", F.col("weight") + noise), "scores")
    able = F.col("n_words") >= p.min_words
    drawn = scored.filter(able).count() * p.percent // 100
    ranked = numbered(scored.filter(able), [F.desc("score"), F.asc_nulls_last("doc_id"), F.col("n_features"), F.col("weight")], "place", lambda d: scratch.keep(d, "ranked"))
    out = ranked.withColumn("rank", F.when(F.col("place") < drawn, F.col("place") + 1)).drop("place").unionByName(scored.filter(~able).withColumn("rank", F.lit(None).cast("long")))
    return out.select("doc_id", "n_features", "weight", "score", "rank")


def survivors(docs: DataFrame, target: DataFrame, p: Params = Params(), target_id: str = "item_id") -> DataFrame:
    """The rows of ``docs`` whose doc_id was drawn, columns unchanged."""
    ids = resample(docs, target, p, target_id).filter("rank is not null").select(F.col("doc_id").alias("_drawn")).distinct()
    return docs.join(ids, F.col("doc_id").eqNullSafe(F.col("_drawn")), "left_semi")

"""Near duplicates: one-permutation MinHash with optimal densification, banded buckets, star edges.

*Sketch.* A document's distinct word shingles are hashed once; the hash space is cut into ``bins``
equal ranges and the smallest hash of each range is kept. An empty range takes the value of the first
non-empty range in its own fixed pseudo-random probe order (optimal densification), so two sets agree
in each bin with the probability of their Jaccard similarity.

*Classes.* Documents with one and the same shingle set are one vertex (its smallest doc_id); copies
are never expanded into pairs.

*Candidates.* ``bins / rows`` bands of ``rows`` bins make bucket keys. With 200 bins in 40 bands of 5,
a pair at similarity 0.8 shares no bucket with probability 1.3e-7. Each bucket proposes a star: its
smallest vertex against every other, so a bucket of m vertices makes m - 1 edges.

*Confirmation.* Edges are confirmed on the full shingle sets: members of a star stream past its hub, and a
hub with many members is dealt in blocks, with one copy of its text each.

*The rest.* A star misses links between two vertices that are not like its hub. Vertices of buckets that are
still in more than one component are joined on *prefixes*: in one order of all their shingles, from rare to
frequent, two sets that reach the threshold share a shingle among the first ``size - ceil(percent * size / 100)
+ 1`` of each. A passage that many documents share is frequent, so it is in nobody's prefix, and documents
that have only that in common meet nowhere: the work grows with their number, not with its square. Lists of
vertices with one prefix shingle propose stars again; lists that stay apart after that are joined into
clusters, inside which all vertices outside the largest component are compared exactly with every other
one through an inverted index of full shingle sets, and only a spanning forest of the links found is
emitted. This search is exact, so a link is lost only if its two sets share no bucket at all, and no group
emits its pairs.

Edge cases: words are ``[^\\x20\\x09-\\x0D]+`` after lower-casing A-Z; fewer words than a shingle make the
whole sequence one shingle; null, empty and blank texts have an empty set and link with nothing. Very long
texts are used whole. Rows that repeat a doc_id share its vertex, also with different texts: what one of them
is linked with, all are. A null doc_id is its own unlinked row with a null component. Extra columns,
whatever their names, are ignored (or, in ``survivors``, passed through). An empty table gives an empty result.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import BROADCAST_IDS, Scratch, checked
from .components import components


@dataclass(frozen=True)
class Params:
    """Words per shingle, threshold in percent, sketch shape, members of a star that share a copy of
    their hub, and shingles of a block of the exact search."""

    words: int = 4
    percent: int = 80
    bins: int = 200
    rows: int = 5
    star: int = 256
    block_shingles: int = 1_000_000

    @property
    def bands(self) -> int:
        return self.bins // self.rows


#: A shingle of more sets than this is joined by broadcast, not by its key.
HOT = 20_000

MIX1, MIX2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


def mix(h: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser."""
    h = (h ^ (h >> np.uint64(32))) * MIX1
    h = (h ^ (h >> np.uint64(29))) * MIX2
    return h ^ (h >> np.uint64(32))


#: Multipliers of the positions in a shingle or band: unrelated, so no swap of words cancels out.
ODD = mix(np.arange(1, 65, dtype=np.uint64)) | np.uint64(1)


class Shingler:
    """Text to its sorted distinct 64-bit shingle hashes; word hashes are memoised within ``memo_bytes``."""

    def __init__(self, words: int, memo_bytes: int = 16 << 20):
        self.words, self.memo, self.held, self.memo_bytes = words, {}, 0, memo_bytes

    def __call__(self, text: str | None) -> np.ndarray:
        tokens = text.encode("utf-8", "surrogatepass").lower().split() if text else []
        if not tokens:
            return np.zeros(0, np.uint64)
        memo = self.memo
        try:
            hashed = [memo[w] for w in tokens]
        except KeyError:
            if self.held > self.memo_bytes:
                memo.clear()
                self.held = 0
            for w in tokens:
                if w not in memo:
                    memo[w] = xxhash.xxh3_64_intdigest(w)
                    self.held += len(w) + 170  # the word, its hash, and their place
            hashed = [memo[w] for w in tokens]
        h = np.array(hashed, np.uint64)
        k = min(self.words, len(h))
        out = h[: len(h) - k + 1] * ODD[0]
        for j in range(1, k):
            out = out + h[j : len(h) - k + 1 + j] * ODD[j]
        return np.unique(mix(out + np.uint64(k)))


class Sketcher:
    """One-permutation MinHash with optimal densification."""

    PROBES = 1024

    def __init__(self, bins: int):
        self.bins = bins
        at = np.arange(bins, dtype=np.uint64)[:, None] * np.uint64(1 << 20) + np.arange(self.PROBES, dtype=np.uint64)[None, :]
        self.probe = ((mix(at + np.uint64(77)) >> np.uint64(32)) * np.uint64(bins) >> np.uint64(32)).astype(np.int32)

    def __call__(self, hashes: np.ndarray) -> np.ndarray:
        """``hashes`` sorted and not empty; the value of each bin as 64 bits."""
        bins = ((hashes >> np.uint64(32)) * np.uint64(self.bins) >> np.uint64(32)).astype(np.int64)
        first = np.flatnonzero(np.r_[True, bins[1:] != bins[:-1]])
        out = np.zeros(self.bins, np.uint64)
        full = np.zeros(self.bins, bool)
        out[bins[first]], full[bins[first]] = hashes[first], True
        empty = np.flatnonzero(~full)
        todo, width, start = empty, 32, 0
        source = np.arange(self.bins)
        while len(todo) and start < self.PROBES:
            tries = self.probe[todo, start : start + width]
            hit = full[tries]
            found = hit.any(axis=1)
            source[todo[found]] = tries[found, hit[found].argmax(axis=1)]
            todo, start, width = todo[~found], start + width, width * 2
        if len(todo):
            # no probe hit: the next filled bin, going round
            filled = np.flatnonzero(full)
            source[todo] = filled[np.searchsorted(filled, todo) % len(filled)]
        return out[source]


SKETCH = "doc_id long, n_shingles long, f1 long, f2 long, bands array<long>"


def fingerprint(shingles: np.ndarray) -> list[int]:
    """128 bits of a sorted set, as two signed numbers."""
    f = xxhash.xxh3_128_intdigest(shingles.tobytes())
    return np.array([f >> 64, f & (1 << 64) - 1], np.uint64).astype(np.int64).tolist()


def sketches(docs: DataFrame, p: Params) -> DataFrame:
    """Per row: set size, a 128-bit fingerprint of the set, and band keys."""
    schema = pa.schema([("doc_id", pa.int64()), ("n_shingles", pa.int64()), ("f1", pa.int64()), ("f2", pa.int64()), ("bands", pa.list_(pa.int64()))])

    def run(batches):
        shingle, sketch = Shingler(p.words), Sketcher(p.bins)
        band_no = np.arange(p.bands, dtype=np.uint64)
        for batch in batches:
            ids, texts = batch.column(0).to_pylist(), batch.column(1)
            for at in range(0, len(ids), 256):
                rows = []
                for doc, text in zip(ids[at : at + 256], texts[at : at + 256].to_pylist(), strict=True):
                    s = shingle(text)
                    if not len(s):
                        rows.append((doc, 0, None, None, None))
                        continue
                    values = sketch(s)
                    keys = mix((values[: p.bands * p.rows].reshape(p.bands, p.rows) * ODD[: p.rows]).sum(axis=1, dtype=np.uint64) + band_no)
                    rows.append((doc, len(s), *fingerprint(s), keys.astype(np.int64)))
                yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], f.type) for i, f in enumerate(schema)], schema=schema)

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, SKETCH)


def confirm(pairs: DataFrame, texts: DataFrame, p: Params) -> DataFrame:
    """The pairs (a, b) whose full shingle sets reach the threshold.

    A hub ``a`` of many pairs is dealt in blocks of about ``p.star`` members, so neither its members nor
    copies of its text gather in one task.
    """
    many = pairs.groupBy("a").agg(F.ceil(F.count("*") / p.star).cast("int").alias("blocks")).filter("blocks > 1")
    placed = pairs.join(checked(many), "a", "left").select("a", "b", F.pmod(F.xxhash64("b"), F.coalesce("blocks", F.lit(1))).cast("int").alias("block"))
    members = placed.join(texts, placed["b"] == texts["doc_id"]).select("a", "block", "b", "text")
    hubs = placed.select("a", "block").distinct().join(texts, F.col("a") == texts["doc_id"]).select("a", "block", F.lit(None).cast("long").alias("b"), "text")

    def run(batches):
        shingle, at, hub = Shingler(p.words), None, []
        for batch in batches:
            found = []
            for first in range(0, batch.num_rows, 128):
                for a, block, b, text in zip(*[batch.column(i).slice(first, 128).to_pylist() for i in range(4)], strict=True):
                    if (a, block) != at:
                        at, hub = (a, block), []
                    y = shingle(text)
                    if b is None:
                        hub.append(y)  # more than one only where rows repeat the doc_id
                        continue
                    for x in hub:
                        both = np.intersect1d(x, y, assume_unique=True).size
                        if both and 100 * both >= p.percent * (len(x) + len(y) - both):
                            found.append((a, b))
                            break
            yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in found], pa.int64()), pa.array([y for _, y in found], pa.int64())], names=["a", "b"])

    stream = hubs.union(members).repartition("a", "block").sortWithinPartitions("a", "block", F.col("b").asc_nulls_first())
    return stream.mapInArrow(run, "a long, b long").distinct()


class Forest:
    """Union-find over component ids."""

    def __init__(self):
        self.root: dict = {}

    def top(self, c):
        root = self.root
        root.setdefault(c, c)
        while root[c] != c:
            root[c] = c = root[root[c]]
        return c

    def join(self, a, b) -> bool:
        """True if the two were apart."""
        x, y = self.top(a), self.top(b)
        self.root[max(x, y)] = min(x, y)
        return x != y


def linked_forest(p: Params, ids, comp, own, probe, sets) -> list[tuple[int, int]]:
    """A spanning forest of the exact cross-component links of a block, by an inverted index of the
    block's own shingle sets."""
    here = np.flatnonzero(own)
    if not len(here):
        return []
    sizes = np.array([len(sets[i]) for i in here])
    every, owner = np.concatenate([sets[i] for i in here]), np.repeat(np.arange(len(here)), sizes)
    order = np.argsort(every, kind="stable")
    every, owner = every[order], owner[order]
    comp_here, forest, out = comp[here], Forest(), []
    for i in np.flatnonzero(probe):
        s = sets[i]
        lo, hi = np.searchsorted(every, s, "left"), np.searchsorted(every, s, "right")
        n = hi - lo
        if not (total := int(n.sum())):
            continue
        at = np.arange(total) - np.repeat(np.cumsum(n) - n, n) + np.repeat(lo, n)
        both = np.bincount(owner[at], minlength=len(here))
        for j in np.flatnonzero((100 * both >= p.percent * (sizes + len(s) - both)) & (both > 0) & (comp_here != comp[i])):
            if forest.join(comp[i], comp_here[j]):
                a, b = ids[i], ids[here[j]]
                out.append((min(a, b), max(a, b)))
    return out


def _blocks(work):
    """Run ``work`` on each (key, block) of a stream that is sorted by them; pairs (a, b) come out.

    Columns: key, block, id, component, own, probe, payload."""

    def pack(pairs):
        return pa.RecordBatch.from_arrays([pa.array([x for x, _ in pairs], pa.int64()), pa.array([y for _, y in pairs], pa.int64())], names=["a", "b"])

    def run(batches):
        held, at = [], None

        def end():
            if len(held) < 2:
                return []
            ids, comp, own, probe, payload = zip(*held, strict=True)
            return work(ids, np.array(comp), np.array(own), np.array(probe), payload)

        for batch in batches:
            out = []
            for key, block, *row in zip(*[batch.column(i).to_pylist() for i in range(7)], strict=True):
                if (key, block) != at:
                    out += end()
                    held, at = [], (key, block)
                held.append(row)
            yield pack(out)
        yield pack(end())

    return run


def _dealt(rows: DataFrame, groups: DataFrame, payload: DataFrame, column: str) -> DataFrame:
    """Deal the members of each group (key, blocks, most) to blocks; those outside the group's largest
    component also visit every other block. ``payload`` (id, column) joins what the search needs."""
    placed = rows.join(checked(groups), "key")
    home = F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int")
    probe = F.col("component") != F.col("most")
    dealt = placed.select("key", "id", "component", home.alias("home"), F.when(probe, F.sequence(F.lit(0), F.col("blocks") - 1)).otherwise(F.array(home)).alias("at"), probe.alias("probe")).withColumn("block", F.explode("at"))
    full = dealt.join(payload, "id").select("key", "block", "id", "component", (F.col("block") == F.col("home")).alias("own"), "probe", column)
    return full.repartition("key", "block").sortWithinPartitions("key", "block")


def _mixed(rows: DataFrame, size: str, per_block: int) -> DataFrame:
    """Groups with more than one component, their number of blocks and their largest component."""
    per = rows.groupBy("key", "component").agg(F.count("*").alias("m"), F.sum(size).alias("size"))
    return (
        per.groupBy("key").agg(F.count("*").alias("k"), F.sum("m").alias("m"), F.sum("size").alias("size"), F.max(F.struct("m", "component")).alias("top")).filter("k > 1")
        .select("key", "m", F.ceil(F.col("size") / per_block).cast("int").alias("blocks"), F.col("top.component").alias("most"))
    )


def prefix_lists(texts: DataFrame, p: Params, scratch: Scratch) -> DataFrame:
    """(key, id): for each vertex, those shingles of its prefix that another one has too."""

    def run(batches):
        shingle = Shingler(p.words)
        for batch in batches:
            for at in range(0, batch.num_rows, 128):
                rows = []
                for doc, text in zip(batch.column(0).slice(at, 128).to_pylist(), batch.column(1).slice(at, 128).to_pylist(), strict=True):
                    s = shingle(text)
                    rows.append((doc, fingerprint(s)[0], len(s), s.astype(np.int64)))
                yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int64())))], names=["id", "f", "size", "shingles"])

    sets = scratch.keep(texts.select("doc_id", "text").mapInArrow(run, "id long, f long, size long, shingles array<long>"), "sets", "lz4")
    every = sets.select("id", "f", "size", F.explode("shingles").alias("key"))
    common = scratch.keep(every.groupBy("key").agg(F.count("*").alias("n")).filter("n > 1"), "common", "lz4")
    # the few shingles of very many sets would each be one task's: they are joined where their rows are
    n_common = common.count()
    hot = scratch.keep(common.filter(F.col("n") > HOT), "hot") if n_common > BROADCAST_IDS else None
    if hot is None:
        counted = every.join(checked(common, n_common), "key")
    else:
        counted = every.join(checked(hot.select("key")), "key", "left_anti").join(common.filter(F.col("n") <= HOT), "key").unionByName(every.join(checked(hot), "key"))
    whole = Window.partitionBy("id", "f")
    # shingles that no other set has come first in the order; they are counted, not listed
    room = F.col("size") - F.ceil(F.col("size") * p.percent / 100) + 1 - (F.col("size") - F.count("*").over(whole))
    ranked = counted.select("id", "f", "size", "key", "n", room.alias("room")).filter("room > 0").withColumn("rank", F.row_number().over(whole.orderBy("n", "key")))
    lists = scratch.keep(ranked.filter("rank <= room").select("key", "id").distinct(), "lists")
    scratch.drop(sets, common, *([hot] if hot is not None else []))
    return lists


def apart(lists: DataFrame, labels: DataFrame, at_least: int) -> DataFrame:
    """(key, id, component, hub) of lists in more than one component, with at least so many members."""
    rows = lists.join(checked(labels), "id", "left").select("key", "id", F.coalesce("component", "id").alias("component"))
    keys = rows.groupBy("key").agg(F.min("component").alias("low"), F.max("component").alias("high"), F.count("*").alias("m"), F.min("id").alias("hub"))
    return rows.join(checked(keys.filter((F.col("low") < F.col("high")) & (F.col("m") >= at_least)).select("key", "hub")), "key")


def cluster_links(rows: DataFrame, links: DataFrame, labels: DataFrame, texts: DataFrame, p: Params, scratch: Scratch) -> DataFrame:
    """Exact links between vertices of lists that are still apart (``rows``)."""
    rows = scratch.keep(rows, "apart")
    clusters = components(links.select("a", "b").union(rows.filter("id <> hub").select("hub", "id").distinct()), scratch)
    members = clusters.join(checked(rows.select("id").distinct()), "id", "left_semi").select("id", F.col("component").alias("key"))
    sized = texts.select(F.col("doc_id").alias("id"), "text", (F.octet_length(F.coalesce("text", F.lit(""))) / 5 + 1).alias("size"))
    placed = members.join(checked(labels), "id", "left").select("key", "id", F.coalesce("component", "id").alias("component")).join(sized.select("id", "size"), "id")
    groups = scratch.keep(_mixed(placed, "size", p.block_shingles).drop("m"), "clusters")

    def work(ids, comp, own, probe, payload):
        shingle = Shingler(p.words)
        return linked_forest(p, ids, comp, own, probe, [shingle(t) for t in payload])

    return _dealt(placed.drop("size"), groups, sized.select("id", "text"), "text").mapInArrow(_blocks(work), "a long, b long").distinct()


def same_ids(rows: DataFrame, classes: DataFrame, scratch: Scratch) -> DataFrame | None:
    """Edges between the vertices of rows that repeat a doc_id with different sets."""
    repeated = scratch.keep(rows.filter("n_shingles > 0 and doc_id is not null").groupBy("doc_id").agg(F.min("f1").alias("low"), F.max("f1").alias("high")).filter("low < high").select("doc_id"), "repeated")
    if repeated.isEmpty():
        return None
    vertices = rows.join(checked(repeated), "doc_id", "left_semi").join(classes, ["f1", "f2"]).select("doc_id", "id").distinct()
    hubs = vertices.groupBy("doc_id").agg(F.min("id").alias("a"))
    return scratch.keep(vertices.join(hubs, "doc_id").filter("id <> a").select("a", F.col("id").alias("b")).distinct(), "same")


def classify(docs: DataFrame, p: Params = Params()) -> DataFrame:
    """Per row of ``docs``: doc_id, n_shingles, component_id, kept."""
    spark = docs.sparkSession
    scratch = Scratch(spark, "near-dedup")
    rows = scratch.keep(sketches(docs, p), "sketches")
    some = rows.filter("n_shingles > 0 and doc_id is not null")
    classes = scratch.keep(some.groupBy("f1", "f2").agg(F.min("doc_id").alias("id")), "classes")
    keyed = some.join(classes, [some["f1"] == classes["f1"], some["f2"] == classes["f2"], some["doc_id"] == classes["id"]], "left_semi")
    exploded = keyed.select(F.col("doc_id").alias("id"), F.explode("bands").alias("key"))
    shared = exploded.groupBy("key").agg(F.count("*").alias("m"), F.min("id").alias("hub")).filter("m > 1")
    buckets = scratch.keep(exploded.join(shared, "key").select("key", "id", "hub").distinct(), "buckets")
    star = scratch.keep(buckets.filter("id <> hub").select(F.col("hub").alias("a"), F.col("id").alias("b")).distinct(), "star")
    near = scratch.keep(buckets.select("id").distinct(), "near")
    n_near = near.count()
    near = checked(near, n_near)
    texts = scratch.keep(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).join(near, F.col("doc_id") == near["id"], "left_semi"), "texts")

    links = scratch.keep(confirm(star, texts, p), "links")
    if (same := same_ids(rows, classes, scratch)) is not None:
        links = links.union(same)
    labels = components(links, scratch)
    # a bucket of two vertices has only the pair that its star has tried already
    unsure = scratch.keep(apart(buckets.select("key", "id"), labels, 3).select("id").distinct(), "unsure")
    if not unsure.isEmpty():
        lists = prefix_lists(texts.join(checked(unsure), texts["doc_id"] == unsure["id"], "left_semi"), p, scratch)
        more = scratch.keep(apart(lists, labels, 2).filter("id <> hub").select(F.col("hub").alias("a"), F.col("id").alias("b")).distinct().join(star, ["a", "b"], "left_anti"), "more")
        if not more.isEmpty():
            links = links.union(scratch.keep(confirm(more, texts, p), "links"))
            labels = components(links, scratch)
        rest = apart(lists, labels, 3)
        if not rest.isEmpty():
            links = links.union(scratch.keep(cluster_links(rest, links, labels, texts, p, scratch), "links"))
            labels = components(links, scratch)
        scratch.drop(lists)
    scratch.drop(texts, buckets, star)

    joined = rows.select("doc_id", "n_shingles", "f1", "f2").join(classes, ["f1", "f2"], "left").join(checked(labels), "id", "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "id", "doc_id"))
    return joined.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(component == F.col("doc_id"), F.lit(True)).alias("kept"))


def survivors(docs: DataFrame, p: Params = Params()) -> DataFrame:
    """``docs`` without the documents that another one of their group stands for."""
    scratch = Scratch(docs.sparkSession, "near-kept")
    gone = scratch.keep(classify(docs, p).filter("not kept").select("doc_id").distinct(), "gone")
    return docs.join(checked(gone), "doc_id", "left_anti").select(*[f"`{c}`" for c in docs.columns])

"""Nearest neighbours by cosine with a vantage-point tree per shard.

*Vertices.* Equal vectors are one vertex with its ``k + 1`` smallest ids: no answer needs more of them, so a group of
copies is searched once.
*Shards.* Vertices go to the nearest of some pivots, which are fitted on a bounded sample; a shard that is still too
large is cut by hash, so every shard fits a task. A shard's vantage-point tree is one file in the shared folder, and
its centre and radius are a row of a table that is bounded by the number of pivots and cuts.
*Search.* Distances are Euclidean on unit vectors, which order like the cosine. A query first searches its own shard;
its k-th best distance is then an upper bound for everything else. By the triangle inequality it goes on only to shards
whose ball reaches into that bound, and inside a tree only to subtrees whose ring around the vantage point does.
``factor`` divides the bound before these tests: above one fewer subtrees are entered, and answers may be missed; one
restores exact search. (Query, shard) rows are dealt by ranges, so a popular shard spreads over tasks, and queries go
down a tree in batches.
*Scores.* Candidates within rounding of the bound are scored again on the original vectors in double precision, in
the order of their components, and sorted by score, then id.

Edge cases: vectors that are null, empty, zero, hold a null or non-finite component, or whose squared length overflows
or vanishes take no part, nor do rows with a null id. Vectors are compared only with vectors of their own length.
Rows are told apart even if they repeat an id: a query's own row is left out once. A query with fewer candidates than
``k`` gets all; an empty table gives no rows. Extra columns, whatever their names, are ignored.
"""

from __future__ import annotations

import io
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch, checked
from .shared_files import Writer, attempt, open_fs

#: Slack of comparisons of distances, and of cosines, for rounding.
NEAR, SAME = 1e-6, 1e-11


@dataclass(frozen=True)
class Params:
    """``k`` neighbours; ``factor`` of the pruning; most vectors of a shard and of a leaf; most pivots, which are sampled
    among at most ``sample`` vertices; queries that go down a tree together."""

    k: int = 5
    factor: float = 1.0
    shard: int = 32_768
    leaf: int = 128
    pivots: int = 1_024
    sample: int = 16_384
    batch: int = 256

    def most(self, dim: int) -> int:
        """Vectors of a shard: ``shard``, fewer if they are long (64 MB)."""
        return max(1, min(self.shard, (8 << 20) // dim))


def unit(x: np.ndarray) -> np.ndarray:
    return x / np.sqrt((x * x).sum(axis=1))[:, None]


class Tree:
    """A vantage-point tree in arrays. Node i covers the vectors ``begin[i]:end[i]`` of the tree's order, of which the
    first is its vantage point; ``near``/``far`` are its children (-1: a leaf) and ``low``/``high`` the least and
    greatest distance of its vectors from its parent's vantage point."""

    PARTS = ("x", "ids", "starts", "begin", "end", "near", "far", "low", "high")

    def __init__(self, **parts):
        self.__dict__ |= parts
        self.u = unit(self.x.astype(np.float64))

    @classmethod
    def build(cls, x: np.ndarray, ids: list[list[int]], leaf: int) -> Tree:
        u = unit(x.astype(np.float64))
        order = np.arange(len(x))
        nodes = []  # begin, end, near, far, low, high

        def add(begin, end, low, high):
            nodes.append([begin, end, -1, -1, low, high])
            return len(nodes) - 1

        todo = [add(0, len(x), 0.0, 2.0)]
        while todo:
            i = todo.pop()
            begin, end = nodes[i][:2]
            if end - begin <= leaf:
                continue
            own = order[begin:end]
            # the vector farthest from one of them sees the others at well spread distances
            v = int(np.argmin(u[own] @ u[own[0]]))
            own[[0, v]] = own[[v, 0]]
            d = np.sqrt(np.maximum(0.0, 2 - 2 * (u[own[1:]] @ u[own[0]])))
            half = len(d) // 2
            split = np.argpartition(d, half)
            order[begin + 1 : end] = own[1:][split]
            d = d[split]
            nodes[i][2] = add(begin + 1, begin + 1 + half, float(d[:half].min()), float(d[:half].max()))
            nodes[i][3] = add(begin + 1 + half, end, float(d[half:].min()), float(d[half:].max()))
            todo += nodes[i][2:4]
        sizes = [len(ids[j]) for j in order]
        columns = list(zip(*nodes, strict=True))
        return cls(
            x=x[order], ids=np.array([v for j in order for v in ids[j]], np.int64), starts=np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64),
            **{n: np.array(c, np.int64 if n in ("begin", "end", "near", "far") else np.float64) for n, c in zip(cls.PARTS[3:], columns, strict=True)},
        )

    def dump(self) -> bytes:
        out = io.BytesIO()
        np.savez(out, **{n: getattr(self, n) for n in self.PARTS})
        return out.getvalue()

    @classmethod
    def load(cls, data: bytes) -> Tree:
        with np.load(io.BytesIO(data)) as f:
            return cls(**{n: f[n] for n in cls.PARTS})


def cosines(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Row by row, in double precision and component order."""
    dot, qq, xx = (np.zeros(len(x)) for _ in range(3))
    for j in range(x.shape[1]):
        a, b = q[:, j].astype(np.float64), x[:, j].astype(np.float64)
        dot += a * b
        qq += a * a
        xx += b * b
    return dot / (np.sqrt(qq) * np.sqrt(xx))


class Search:
    """A batch of queries in one tree: the best ``k + 1`` rows of each with a cosine of at least its bound."""

    def __init__(self, tree: Tree, q: np.ndarray, least: np.ndarray, p: Params):
        self.tree, self.q, self.p = tree, q, p
        self.u = unit(q.astype(np.float64))
        self.k = p.k + 1
        self.top = np.repeat(least[:, None], self.k, axis=1)  # the k + 1 best cosines so far, or the bound
        self.found: list[tuple[np.ndarray, np.ndarray]] = []  # query, vertex: not below the bound when they were met
        self.pool, self.read = 0, 0

    def scan(self, who: np.ndarray, begin: int, end: int) -> None:
        self.read += len(who) * (end - begin)
        sims = self.u[who] @ self.tree.u[begin:end].T
        near = sims >= self.top[who, 0][:, None] - SAME
        a, b = np.nonzero(near)
        if not len(a):
            return
        self.found.append((who[a], begin + b))
        self.pool += len(a)
        # a vertex's rows all count: its cosine comes as often as it has ids
        copies = np.minimum(np.diff(self.tree.starts[begin : end + 1]), self.k)
        most = int(copies[b].max())
        wide = np.where(near, sims, -2.0)
        best = np.concatenate([self.top[who], wide, *[np.where(copies[None, :] > c, wide, -2.0) for c in range(1, most)]], axis=1)
        self.top[who] = np.sort(np.partition(best, best.shape[1] - self.k, axis=1)[:, -self.k :], axis=1)
        if self.pool > 2_000_000:
            self.shrink()

    def shrink(self) -> None:
        """Only candidates that are still within rounding of their query's bound."""
        if self.found:
            a, b = (np.concatenate(c) for c in zip(*self.found, strict=True))
            keep = (self.u[a] * self.tree.u[b]).sum(axis=1) >= self.top[a, 0] - 2 * SAME
            self.found, self.pool = [(a[keep], b[keep])], int(keep.sum())

    def seed(self) -> None:
        """Bounds from the leaf on whose side of every vantage point a query lies; nothing is kept but the bounds."""
        t = self.tree
        todo = [(0, np.arange(len(self.q)))]
        while todo:
            i, who = todo.pop()
            if t.near[i] < 0:
                self.scan(who, int(t.begin[i]), int(t.end[i]))
                continue
            d = np.sqrt(np.maximum(0.0, 2 - 2 * (self.u[who] @ t.u[t.begin[i]])))
            close = d <= (t.high[t.near[i]] + t.low[t.far[i]]) / 2
            todo += [(int(child), who[side]) for child, side in ((t.near[i], close), (t.far[i], ~close)) if side.any()]
        self.top[:] = self.top[:, :1]
        self.found, self.pool = [], 0

    def run(self) -> list[tuple[int, int, float]]:
        """(query, id, cosine), at most k + 1 a query."""
        t = self.tree
        if t.near[0] >= 0 and (self.top[:, 0] <= -2).any():
            self.seed()
        todo = [(0, np.arange(len(self.q)), None)]  # node, queries, their distances from its parent's vantage point
        while todo:
            i, who, d = todo.pop()
            if d is not None:
                reach = np.sqrt(np.maximum(0.0, 2 - 2 * np.minimum(1.0, self.top[who, 0]))) / self.p.factor + NEAR
                who = who[(d + reach >= t.low[i]) & (d - reach <= t.high[i])]
            if not len(who):
                continue
            begin, end = int(t.begin[i]), int(t.end[i])
            if t.near[i] < 0:
                self.scan(who, begin, end)
                continue
            self.scan(who, begin, begin + 1)
            d = np.sqrt(np.maximum(0.0, 2 - 2 * (self.u[who] @ t.u[begin])))
            todo += [(int(t.far[i]), who, d), (int(t.near[i]), who, d)]
        self.shrink()
        out: list[tuple[int, int, float]] = []
        if not self.found or not self.pool:
            return out
        a, b = self.found[0]
        scores = cosines(self.q[a], t.x[b])
        sizes = np.diff(t.starts)[b]
        rows = np.repeat(np.arange(len(a)), sizes)
        ids = t.ids[np.repeat(t.starts[b], sizes) + np.arange(len(rows)) - np.repeat(np.cumsum(sizes) - sizes, sizes)]
        order = np.lexsort((ids, -scores[rows], a[rows]))
        last, n = -1, 0
        for j in order.tolist():
            query = int(a[rows[j]])
            last, n = (query, 1) if query != last else (last, n + 1)
            if n <= self.k:
                out.append((query, int(ids[j]), float(scores[rows[j]])))
        return out


@dataclass
class Index:
    """``shards``: shard, cut, n, centre, radius, file; ``vertices``: vertex, dim, vector, ids, shard, cut."""

    vertices: DataFrame
    shards: DataFrame
    params: Params


def _vectors(column: pa.Array, dim: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.float64).reshape(-1, dim)


def usable(rows: DataFrame, id_column: str, vector: str) -> DataFrame:
    """id, vector (doubles), dim, vertex (the vector's digest) of the rows that take part."""
    v = F.col("vector")
    length = F.aggregate(v, F.lit(0.0), lambda s, x: s + x * x)
    plain = F.transform(F.col(vector).cast("array<double>"), lambda x: x + F.lit(0.0))  # one zero only
    some = rows.select(F.col(id_column).cast("long").alias("id"), plain.alias("vector")).filter("id is not null and size(vector) > 0")
    some = some.filter(~F.exists(v, lambda x: x.isNull() | F.isnan(x)) & (length > 0) & (length < float("inf")))
    return some.select("id", "vector", F.size("vector").alias("dim"), F.sha2(F.concat_ws(",", F.transform("vector", lambda x: x.cast("string"))), 256).alias("vertex"))


def _assign(pivots: dict[int, np.ndarray]):
    def run(batches):
        for batch in batches:
            dims = np.array(batch.column(1).to_pylist(), np.int64)
            shard = np.zeros(len(dims), np.int64)
            lists = batch.column(2)
            packed = [None] * len(dims)
            for dim in np.unique(dims).tolist():
                at = np.flatnonzero(dims == dim)
                x = np.asarray(lists.take(pa.array(at)).flatten(), np.float64).reshape(-1, dim)
                if dim in pivots:
                    shard[at] = np.argmax(unit(x) @ pivots[dim].T, axis=1)
                for i, r in zip(at.tolist(), x, strict=True):
                    packed[i] = r.tobytes()
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(packed, pa.binary()), batch.column(3), pa.array(shard)], names=["vertex", "dim", "vector", "ids", "shard"])

    return run


def _plant(root: str, leaf: int, pivots: dict[int, np.ndarray]):
    def run(key, table):
        dim, shard, piece = (v.as_py() for v in key)
        table = table.sort_by("vertex").combine_chunks()
        x = _vectors(table.column("vector"), dim)
        tree = Tree.build(x, table.column("ids").to_pylist(), leaf)
        centre = pivots[dim][shard] if dim in pivots else tree.u[0]
        radius = float(np.sqrt(np.maximum(0.0, 2 - 2 * (tree.u @ centre))).max())
        file = f"{root}/tree-{dim}-{shard}-{piece}.npz"
        out = Writer(file, attempt())
        out.write(tree.dump())
        out.close()
        return pa.table({"dim": pa.array([dim], pa.int32()), "shard": [shard], "piece": [piece], "n": [len(x)], "centre": pa.array([centre.tobytes()], pa.binary()), "radius": [radius], "file": [file]})

    return run


def build(rows: DataFrame, id_column: str = "vec_id", vector: str = "embedding", p: Params = Params(), scratch: Scratch | None = None) -> Index:
    """Index every usable row of ``rows``."""
    spark = rows.sparkSession
    scratch = scratch or Scratch(spark, "vantage")
    clean = usable(rows, id_column, vector)
    by_copy = Window.partitionBy("vertex").orderBy("id")
    kept = clean.withColumn("_k", F.row_number().over(by_copy)).filter(F.col("_k") <= p.k + 1)
    grouped = kept.groupBy("vertex").agg(F.first("dim").alias("dim"), F.first("vector").alias("vector"), F.sort_array(F.collect_list("id")).alias("ids"))  # at most k + 1 ids
    vertices = scratch.keep(grouped, "vertices")
    pivots: dict[int, np.ndarray] = {}
    # one row per vector length
    for r in vertices.groupBy("dim").agg(F.count("*").alias("n")).collect():
        wanted = min(p.pivots, -(-r["n"] // p.most(r["dim"])))
        if wanted > 1:
            sample = [x["vector"] for x in vertices.filter(F.col("dim") == r["dim"]).orderBy("vertex").limit(min(p.sample, 16 * wanted)).select("vector").collect()]  # hashes order: bounded, arbitrary rows
            u = unit(np.array(sample))
            chosen = [0]
            nearest = u @ u[0]
            for _ in range(wanted - 1):
                chosen.append(int(np.argmin(nearest)))
                nearest = np.maximum(nearest, u @ u[chosen[-1]])
            pivots[r["dim"]] = u[chosen]
    dealt = scratch.keep(vertices.mapInArrow(_assign(pivots), "vertex string, dim int, vector binary, ids array<long>, shard long"), "dealt")
    pieces = dealt.groupBy("dim", "shard").agg(F.ceil(F.count("*") * 4 / (3 * F.greatest(F.lit(1), F.least(F.lit(p.shard), F.floor(F.lit(8 << 20) / F.col("dim")))))).alias("pieces"))  # at most one row a pivot
    cut = dealt.join(F.broadcast(pieces), ["dim", "shard"]).withColumn("piece", F.when(F.col("pieces") > 1, F.pmod(F.xxhash64("vertex"), F.col("pieces"))).otherwise(F.lit(0)).cast("long")).drop("pieces")
    cut = scratch.keep(cut, "cut")
    root = scratch.path("trees")
    shards = scratch.keep(cut.groupBy("dim", "shard", "piece").applyInArrow(_plant(root, p.leaf, pivots), "dim int, shard long, piece long, n long, centre binary, radius double, file string"), "shards")
    return Index(cut, shards, p)


VISITS = "query string, vector binary, least double, dim int, shard long, piece long, file string"
REACHED = "query string, vector binary, least double, dim int, shard long, own_shard long, own_piece long"


def _reaching(balls: list, factor: float):
    """Queries to the shards whose ball their bound reaches."""
    by_dim: dict[int, list] = {}
    for b in balls:
        by_dim.setdefault(b["dim"], []).append(b)
    centres = {d: _vectors(pa.array([b["centre"] for b in bs]), d) for d, bs in by_dim.items()}
    radii = {d: np.array([b["radius"] for b in bs]) for d, bs in by_dim.items()}
    kinds = (pa.string(), pa.binary(), pa.float64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())

    def table(out):
        return pa.RecordBatch.from_arrays([pa.array([o[i] for o in out], t) for i, t in enumerate(kinds)], names=[c.split()[0] for c in REACHED.split(", ")])

    def run(batches):
        for batch in batches:
            q, v, least, dims, shard, piece = (c.to_pylist() for c in batch.columns)
            out = []
            for dim in set(dims):
                at = [i for i, d in enumerate(dims) if d == dim]
                u = unit(_vectors(pa.array([v[i] for i in at], pa.binary()), dim))
                bound = np.array([least[i] for i in at])
                reach = np.sqrt(np.maximum(0.0, 2 - 2 * np.minimum(1.0, bound))) / factor + NEAR
                far = np.sqrt(np.maximum(0.0, 2 - 2 * (u @ centres[dim].T))) - radii[dim][None, :]
                for a, s in zip(*np.nonzero(far <= reach[:, None]), strict=True):
                    i = at[a]
                    out.append((q[i], v[i], least[i], dim, by_dim[dim][s]["shard"], shard[i], piece[i]))
                    if len(out) >= 2048:
                        yield table(out)
                        out = []
            if out:
                yield table(out)

    return run


def _searching(p: Params):
    def run(batches):
        held: tuple[str | None, Tree | None] = (None, None)
        for batch in batches:
            files = batch.column(6).to_pylist()
            names, vectors, least = batch.column(0).to_pylist(), batch.column(1), np.array(batch.column(2).to_pylist(), np.float64)
            begin = 0
            while begin < len(files):
                end = begin
                while end < len(files) and files[end] == files[begin] and end - begin < p.batch:
                    end += 1
                if held[0] != files[begin]:
                    at, path = open_fs(files[begin])
                    with at.open_input_stream(path, compression=None) as f:
                        held = (files[begin], Tree.load(f.read()))
                tree = held[1]
                search = Search(tree, _vectors(vectors.slice(begin, end - begin), tree.x.shape[1]), least[begin:end], p)
                rows = search.run()
                share = search.read / len(tree.x) / (end - begin)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([names[begin + r[0]] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.int64()), pa.array([r[2] for r in rows], pa.float64()), pa.array([share] * len(rows), pa.float64())],
                    names=["query", "id", "score", "share"],
                )
                begin = end

    return run


def _searched(visits: DataFrame, p: Params) -> DataFrame:
    n = int(visits.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    order = ["dim", "shard", "piece", "query"]
    return visits.repartitionByRange(n, *order).sortWithinPartitions(*order).select(*[c.split()[0] for c in VISITS.split(", ")]).mapInArrow(_searching(p), "query string, id long, score double, share double")


def nearest(queries: DataFrame, index: Index, id_column: str = "vec_id", vector: str = "embedding", scratch: Scratch | None = None) -> DataFrame:
    """query_id, rank, vec_id, score of the ``k`` nearest indexed rows of every query but the query's own row.

    ``queries`` are rows of the indexed table (the vertex of a query's vector holds its row).
    """
    p = index.params
    scratch = scratch or Scratch(queries.sparkSession, "nearest")
    asked = scratch.keep(usable(queries, id_column, vector).select("id", F.col("vertex").alias("query")), "asked")
    at = F.col("query") == F.col("vertex")
    files = checked(index.shards.select("dim", "shard", "piece", "file"))
    start = index.vertices.join(asked.select("query").distinct(), at, "left_semi").join(files, ["dim", "shard", "piece"])
    none = F.lit(-2.0)
    visits = scratch.keep(start.select(F.col("vertex").alias("query"), "vector", none.alias("least"), "dim", "shard", "piece", "file"), "visits")
    own = scratch.keep(_searched(visits, p), "own")
    # the k + 1 best hold the query itself, so the last of them bounds the k-th other row
    bound = own.groupBy("query").agg(F.count("*").alias("n"), F.min("score").alias("worst")).select("query", F.when(F.col("n") > p.k, F.col("worst")).otherwise(none).alias("least"))
    # the pieces of a shard share its pivot as centre; without pivots there is one shard, and all of it is reached
    balls = index.shards.groupBy("dim", "shard").agg(F.max_by("centre", "radius").alias("centre"), F.max("radius").alias("radius"), F.count_distinct("centre").alias("centres")).collect()  # at most one row a pivot
    balls = [r.asDict() | ({"radius": 2.0} if r["centres"] > 1 else {}) for r in balls]
    reached = visits.drop("least").join(bound, "query").select("query", "vector", "least", "dim", "shard", "piece").mapInArrow(_reaching(balls, p.factor), REACHED)
    other = (F.col("shard") != F.col("own_shard")) | (F.col("piece") != F.col("own_piece"))
    others = _searched(scratch.keep(reached.join(files, ["dim", "shard"]).filter(other), "reaching"), p)
    hits = own.unionByName(others)
    best = Window.partitionBy("query").orderBy(F.desc("score"), "id")
    top = scratch.keep(hits.withColumn("_k", F.row_number().over(best)).filter(F.col("_k") <= p.k + 1).select("query", "id", "score", "_k"), "top")
    rows = asked.withColumnRenamed("id", "query_id").join(top.groupBy("query").agg(F.sort_array(F.collect_list(F.struct("_k", "id", "score"))).alias("hits")), "query")  # k + 1 each
    return _ranked(rows, p)


def _ranked(rows: DataFrame, p: Params) -> DataFrame:
    """Each query row's hits without the row itself: once, among the hits with its id the one with the greatest cosine."""
    mine = F.array_position(F.transform("hits", lambda h: h["id"]), F.col("query_id"))
    others = F.when(mine > 0, F.concat(F.slice("hits", F.lit(1), (mine - 1).cast("int")), F.slice("hits", (mine + 1).cast("int"), F.lit(p.k + 1)))).otherwise(F.slice("hits", 1, p.k))
    return rows.select("query_id", F.posexplode(F.slice(others, 1, p.k)).alias("at", "h")).select("query_id", (F.col("at") + 1).cast("int").alias("rank"), F.col("h.id").alias("vec_id"), F.col("h.score").alias("score"))

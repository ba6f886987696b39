"""Bounded traversal, reachability, project scope, shortest paths."""

from __future__ import annotations

from dataclasses import dataclass, field
from itertools import count

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strataflow.functions.lineage import cut
from strataflow.functions.sizes import small

EDGE_KEY = ("source_id", "target_id", "relation")


def oriented(edges: DataFrame, direction: str, relations: list[str] | None = None) -> DataFrame:
    """Edges as (from_id, to_id, key columns) in the direction of travel; a self-loop counts once."""
    if relations:
        edges = edges.filter(F.col("relation").isin(list(relations)))
    edges = edges.select(*EDGE_KEY)
    out = edges.select(F.col("source_id").alias("from_id"), F.col("target_id").alias("to_id"), *EDGE_KEY)
    into = edges.select(F.col("target_id").alias("from_id"), F.col("source_id").alias("to_id"), *EDGE_KEY)
    if direction == "outgoing":
        return out
    if direction == "incoming":
        return into
    return out.unionByName(into.filter("source_id <> target_id"))


def those_among(nodes: DataFrame, ids: DataFrame) -> DataFrame:
    """(node_id) of the written ``ids`` (node_id) that are nodes: few ids go to the nodes, which stay where they are."""
    return nodes.select("node_id").join(small(ids.select("node_id").distinct()), "node_id", "left_semi").distinct()


@dataclass
class Traversal:
    """Node ids in order of selection, edge keys, and why (and where) it stopped short."""

    nodes: list[str]
    edges: list[tuple[str, str, str]]
    truncated: list[str] = field(default_factory=list)
    scope_boundary: str | None = None
    levels: dict[str, int] = field(default_factory=dict)


def traverse(nodes: DataFrame, edges: DataFrame, starts: list[str], direction: str = "outgoing", relations: list[str] | None = None, max_depth: int = 2, max_nodes: int = 100, scope: DataFrame | None = None, whole: bool = False) -> Traversal:
    """Breadth-first traversal with a node budget and deterministic order. ``whole`` says that every edge is
    known to end in existing nodes, which then needs no test in each hop.

    The frontier and the result are bounded by ``max_nodes``, so each hop is one filtered scan of the
    edges against a short list, whose result is written before it is used; what a hop brings to the driver is
    cut to the room that is left before it is collected. The encounter order of a neighbour is (frontier node, edge key).
    """
    hops = oriented(edges, direction, relations)
    starts = sorted(set(starts))
    ids = nodes.select("node_id")
    known = {r[0] for r in ids.filter(F.col("node_id").isin(starts)).collect()}
    starts = [s for s in starts if s in known]
    if scope is not None and starts:
        inside = {r[0] for r in scope.select("node_id").filter(F.col("node_id").isin(starts)).collect()}
        outside = [s for s in starts if s not in inside]
        if outside:
            raise ValueError(f"start node {outside[0]} is outside the project scope")
    if len(starts) > max_nodes:
        return Traversal(starts[:max_nodes], [], ["node_limit"], levels={s: 0 for s in starts[:max_nodes]})
    out = Traversal(list(starts), [], levels={s: 0 for s in starts})
    selected, frontier, edge_set = set(starts), list(starts), {}

    def truncate(reason: str) -> None:
        if reason not in out.truncated:
            out.truncated.append(reason)

    for depth in range(1, max_depth + 1):
        if not frontier:
            break
        cand = cut(hops.filter(F.col("from_id").isin(frontier)))
        if not whole:
            there = cut(those_among(ids, cand.select(F.col("to_id").alias("node_id"))))
            cand = cand.join(small(there.withColumnRenamed("node_id", "to_id")), "to_id", "left_semi")
        cand = cand.withColumn("k", F.struct("from_id", *EDGE_KEY))
        if scope is not None:
            cand = cand.join(scope.select(F.col("node_id").alias("to_id"), F.lit(True).alias("inside")).distinct(), "to_id", "left").fillna(False, ["inside"])
        else:
            cand = cand.withColumn("inside", F.lit(True))
        room = max_nodes - len(selected)
        fresh = cand.filter(~F.col("to_id").isin(list(selected))).groupBy("to_id").agg(F.min("k").alias("k"), F.first("inside").alias("inside")).orderBy("k").limit(room + 1).collect()
        if len(fresh) > room:
            truncate("node_limit")
        kept = fresh[:room]
        full_at = () if room == 0 else tuple(kept[-1]["k"]) if len(kept) == room else None
        selected |= {r["to_id"] for r in kept}
        hop = cand.filter(F.col("to_id").isin(list(selected)))
        if full_at is not None and scope is not None:
            late = ~F.col("inside") & (F.lit(True) if not full_at else F.col("k") > F.struct(*[F.lit(x) for x in full_at]))
            if not cand.filter(late).isEmpty():
                truncate("node_limit")
            hop = hop.filter(~late)
        for r in hop.select(*EDGE_KEY).distinct().collect():  # edges among at most max_nodes nodes
            edge_set[tuple(r)] = True
        if scope is not None and out.scope_boundary is None:
            edge = cand.filter(~F.col("inside")).orderBy("k").select("to_id").limit(1).collect()
            out.scope_boundary = edge[0][0] if edge else None
        for r in kept:
            out.nodes.append(r["to_id"])
            out.levels[r["to_id"]] = depth
        frontier = sorted(r["to_id"] for r in kept if r["inside"])
    if frontier and not hops.filter(F.col("from_id").isin(frontier) & ~F.col("to_id").isin(list(selected))).isEmpty():
        truncate("depth_limit")
    out.edges = sorted(edge_set)
    return out


def traverse_indexed(adjacency, starts: list[str], direction: str = "outgoing", relations: list[str] | None = None, max_depth: int = 2, max_nodes: int = 100) -> Traversal:
    """``traverse`` of existing ``starts`` over an adjacency table, one job a hop.

    A hop brings to the driver the neighbours that are selected already and, in encounter order, as many new ones as
    there is room for and one more, each with its edges from the frontier: at most ``max_nodes`` rows and one.
    """
    starts = sorted(set(starts))
    if len(starts) > max_nodes:
        return Traversal(starts[:max_nodes], [], ["node_limit"], levels={s: 0 for s in starts[:max_nodes]})
    out = Traversal(list(starts), [], levels={s: 0 for s in starts})
    frontier, edges = list(starts), set()

    def neighbours(room: int):
        known = F.col("to_id").isin(list(out.levels))
        key = F.struct(*EDGE_KEY)
        near = adjacency.near(frontier, direction, relations).groupBy("to_id").agg(F.min(F.struct("from_id", *EDGE_KEY)).alias("k"), F.collect_set(key).alias("edges")).withColumn("known", known)
        return near.orderBy(F.desc("known"), "k").limit(len(out.levels) + room + 1).collect()

    for depth in range(1, max_depth + 1):
        if not frontier:
            break
        room = max_nodes - len(out.levels)
        near = neighbours(room)
        fresh = [r for r in near if not r["known"]]
        if len(fresh) > room and "node_limit" not in out.truncated:
            out.truncated.append("node_limit")
        kept = fresh[:room]
        edges |= {tuple(e) for r in near if r["known"] for e in r["edges"]} | {tuple(e) for r in kept for e in r["edges"]}
        for r in kept:
            out.nodes.append(r["to_id"])
            out.levels[r["to_id"]] = depth
        frontier = sorted(r["to_id"] for r in kept)
    if frontier and not adjacency.near(frontier, direction, relations).filter(~F.col("to_id").isin(list(out.levels))).isEmpty():
        out.truncated.append("depth_limit")
    out.edges = sorted(edges)
    return out


def reach(nodes: DataFrame, edges: DataFrame, starts: DataFrame, direction: str, relations: list[str] | None, max_depth: int) -> DataFrame:
    """(node_id, distance) of everything within ``max_depth`` hops of any start, without a node budget.

    Purely set-based: each hop joins the frontier with the edges first and tests existence on what that
    reaches, so the whole edge table is never joined with the nodes. Every hop is written before the next
    one reads it, so a hop costs one join, not the joins of all hops before it. A frontier, and what it
    reaches, is broadcast while it is small, so that edges and nodes are read but not shuffled.
    """
    hops = oriented(edges, direction, relations).select("from_id", "to_id")
    ids = nodes.select("node_id")
    found = cut(starts.select("node_id").distinct().join(ids, "node_id", "left_semi").withColumn("distance", F.lit(0)))
    frontier = found
    for depth in range(1, max_depth + 1):
        near = cut(hops.join(small(frontier), F.col("node_id") == F.col("from_id")).select(F.col("to_id").alias("node_id")).distinct().join(found, "node_id", "left_anti"))
        step = cut(those_among(ids, near).withColumn("distance", F.lit(depth)))
        if step.isEmpty():
            break
        found, frontier = found.unionByName(step), step
    return found


def project_scope(edges: DataFrame, projects: DataFrame) -> DataFrame:
    """Project ids and everything below them through ``contains``, to any depth (cycles end by set difference)."""
    below = edges.filter("relation = 'contains'").select("source_id", "target_id")
    found = projects.select("node_id").distinct()
    frontier = found
    for depth in count(1):
        step = cut(frontier.join(below, F.col("node_id") == F.col("source_id")).select(F.col("target_id").alias("node_id")).distinct().join(found, "node_id", "left_anti"))
        if step.isEmpty():
            break
        found, frontier = found.unionByName(step), step
        if depth % 8 == 0:
            found = cut(found.repartition("node_id"))
    return found


def explain(nodes: DataFrame, edges: DataFrame, node_id: str) -> tuple[DataFrame, DataFrame]:
    """The node, its neighbours and all its edges."""
    from .snapshot import incident

    at = incident(edges, node_id)
    ends = at.select(F.col("source_id").alias("node_id")).union(at.select("target_id")).distinct().union(nodes.sparkSession.createDataFrame([(node_id,)], "node_id string")).distinct()
    return nodes.join(ends, "node_id", "left_semi"), at


def shortest_paths(nodes: DataFrame, edges: DataFrame, starts: DataFrame, max_depth: int, relations: list[str] | None = None, undirected: bool = False) -> DataFrame:
    """(node_id, distance, path) with path the smallest sequence of edge keys among the shortest ones.

    First-in-first-out search over sorted neighbours finds exactly that path, so the minimum per node and
    hop replaces the queue. Every hop is written before the next one reads it.
    """
    ids = nodes.select("node_id")
    hops = oriented(edges, "both" if undirected else "outgoing", relations)
    hops = hops.select("from_id", "to_id", F.concat_ws("|", *EDGE_KEY).alias("edge"))
    found = cut(starts.select("node_id", F.lit(0).alias("distance"), F.array().cast("array<string>").alias("path")))
    frontier = found
    for depth in range(1, max_depth + 1):
        step = cut(
            frontier.join(hops, F.col("node_id") == F.col("from_id")).groupBy(F.col("to_id").alias("node_id")).agg(F.min(F.concat("path", F.array("edge"))).alias("path"))
            .join(found.select("node_id"), "node_id", "left_anti").join(ids, "node_id", "left_semi").select("node_id", F.lit(depth).alias("distance"), "path")
        )
        if step.isEmpty():
            break
        found, frontier = found.unionByName(step), step
    return found


def walk_from_each(adjacency, starts: list[str], direction: str = "outgoing", relations: list[str] | None = None, max_depth: int = 2, max_nodes: int = 100) -> dict[str, Traversal]:
    """``traverse_indexed`` from every start by itself, all in one breadth-first search: a hop is one job for all of them.

    Rows carry the start that they belong to; each start has its own budget, and its neighbours come in the order that
    a search from it alone would meet them in. At most ``len(starts) * (max_nodes + 1)`` rows reach the driver.
    """
    out = {s: Traversal([s], [], levels={s: 0}) for s in sorted(set(starts))}
    edges: dict[str, set] = {s: set() for s in out}
    frontier = {s: [s] for s in out}
    spark = adjacency.rows.sparkSession

    def step(room: dict[str, int]):
        """Neighbours of each start's frontier: known ones, then new ones in encounter order, up to its room and one."""
        at = spark.createDataFrame([(s, n, room[s]) for s, ns in frontier.items() for n in ns], "start string, from_id string, room int")
        seen = spark.createDataFrame([(s, n) for s in frontier if frontier[s] for n in out[s].levels], "start string, to_id string").withColumn("known", F.lit(True))
        every = sorted({n for ns in frontier.values() for n in ns})
        near = adjacency.near(every, direction, relations).join(F.broadcast(at), "from_id")  # bounded by the budgets
        per = near.groupBy("start", "to_id").agg(F.min(F.struct("from_id", *EDGE_KEY)).alias("k"), F.collect_set(F.struct(*EDGE_KEY)).alias("edges"), F.first("room").alias("room"))
        per = per.join(F.broadcast(seen), ["start", "to_id"], "left").withColumn("known", F.coalesce("known", F.lit(False)))
        order = Window.partitionBy("start", "known").orderBy("k")
        return per.withColumn("_n", F.row_number().over(order)).filter(F.col("known") | (F.col("_n") <= F.col("room") + 1)).select("start", "to_id", "k", "edges", "known").collect()

    for depth in range(1, max_depth + 2):
        frontier = {s: ns for s, ns in frontier.items() if ns}
        if not frontier:
            break
        room = {s: max_nodes - len(out[s].levels) for s in frontier}
        rows = sorted(step(room), key=lambda r: tuple(r["k"]))
        for s in list(frontier):
            t, mine = out[s], [r for r in rows if r["start"] == s]
            fresh = [r for r in mine if not r["known"]]
            if depth > max_depth:  # one look beyond the depth
                if fresh:
                    t.truncated.append("depth_limit")
                continue
            if len(fresh) > room[s] and "node_limit" not in t.truncated:
                t.truncated.append("node_limit")
            kept = fresh[: room[s]]
            edges[s] |= {tuple(e) for r in mine if r["known"] for e in r["edges"]} | {tuple(e) for r in kept for e in r["edges"]}
            for r in kept:
                t.nodes.append(r["to_id"])
                t.levels[r["to_id"]] = depth
            frontier[s] = sorted(r["to_id"] for r in kept)
    for s, t in out.items():
        t.edges = sorted(edges[s])
    return out


def path_between(t: Traversal, source: str, target: str, undirected: bool = False) -> list[tuple[str, str, str]] | None:
    """Shortest path inside a bounded traversal (at most its node budget), ties by edge key."""
    if source == target:
        return []
    back, queue = {source: None}, [source]
    for node in queue:
        steps = [(e, e[1]) for e in t.edges if e[0] == node] + ([(e, e[0]) for e in t.edges if e[1] == node and e[0] != node] if undirected else [])
        for e, to in sorted(steps):
            if to in back or to not in t.levels:
                continue
            back[to] = (node, e)
            if to == target:
                out = []
                while back[to]:
                    to, e = back[to]
                    out.append(e)
                return out[::-1]
            queue.append(to)
    return None


def top_by(rows: DataFrame, key: list[str], order: list, n: int) -> DataFrame:
    return rows.withColumn("_n", F.row_number().over(Window.partitionBy(*key).orderBy(*order))).filter(F.col("_n") <= n).drop("_n")

"""The engine's front door: questions, terms, paths, inspection, export over one snapshot."""

from __future__ import annotations

import json
import math
from collections.abc import Callable, Sequence
from dataclasses import asdict, dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strataflow.functions.text import bm25, fold, identifier_tokens, match_groups, plain_tokens
from strataflow.operators import catalog as cat
from strataflow.operators import evidence, lookup, rank, relations, traverse
from strataflow.operators.adjacency import Adjacency

from .lexical import LexicalIndex
from .question import Plan, Slot, analyze, planner_response

WEIGHTS = {"label": 10.0, "qualified_name": 6.0, "span_path": 3.0, "kind": 1.0, "tokens": 5.0}
CANDIDATE_FACTOR = 4
#: Relations that a change reaches less surely than others (fixed values).
IMPACT_WEIGHT = {"contains": 0.25, "implements": 0.9}


@dataclass
class Answer:
    """Seeds by role, ranked evidence (small, on the driver), and warnings instead of unfounded claims.

    ``limits`` lists every stage with its bounds and why it stopped short; ``catalog`` is the ranked
    catalog's answer where the question asks for one.
    """

    plan: Plan | None
    seeds: dict[str, list[dict]] = field(default_factory=dict)
    evidence: list[dict] = field(default_factory=list)
    edges: list[tuple] = field(default_factory=list)
    warnings: list[dict] = field(default_factory=list)
    truncated: list[str] = field(default_factory=list)
    limits: list[dict] = field(default_factory=list)
    scope_boundary: str | None = None
    catalog: dict | None = None

    def warn(self, code: str, message: str, suggestions: Sequence[str] = ()) -> Answer:
        self.warnings.append({"code": code, "message": message, "suggestions": list(suggestions)})
        return self

    def stage(self, stage: str, role: str = "", depth: int | None = None, nodes: int | None = None, truncated: Sequence[str] = ()) -> None:
        self.limits.append({"stage": stage, "role": role, "maxDepth": depth, "maxNodes": nodes, "truncated": list(truncated)})

    def to_json(self, version: int, published_at: str | None = None) -> str:
        """The envelope that callers of the command line and of tools read."""
        result = {k: v for k, v in asdict(self).items() if k != "plan"} | {"intent": self.plan.intent if self.plan else None}
        return json.dumps({"graphVersion": version, "publishedAt": published_at, "result": result}, default=str)

    def to_text(self) -> str:
        """The same for people: one line each of evidence, edges and warnings."""
        lines = [f"{i + 1}. " + " ".join(f"{k}={v}" for k, v in e.items() if v not in (None, "", [])) for i, e in enumerate(self.evidence)]
        lines += [" ".join(e) for e in self.edges]
        lines += [f"{m['node_id']}: {m.get('name', '')}" for m in (self.catalog or {}).get("matches", [])]
        return "\n".join(lines + [f"warning {w['code']}: {w['message']}" for w in self.warnings])

    def exit_code(self) -> int:
        """0 with an answer, 1 without."""
        return 0 if self.evidence or self.edges or (self.catalog or {}).get("matches") else 1


@dataclass
class Catalog:
    """A snapshot's catalog: ``entries`` (node_id, name, synopsis, and other synopses), ``vectors`` and an
    optional model that turns a text into a vector."""

    entries: DataFrame
    vectors: DataFrame | None = None
    embed: Callable[[str], list[float]] | None = None


def search_fields() -> dict:
    whole = F.concat_ws(" ", "node_id", "label", "qualified_name", "span_path", "kind")
    return {"label": plain_tokens(F.col("label")), "qualified_name": plain_tokens(F.col("qualified_name")), "span_path": plain_tokens(F.col("span_path")), "kind": plain_tokens(F.col("kind")), "tokens": identifier_tokens(fold(whole))}


class Engine:
    """One snapshot's ``nodes`` (node_id, kind, label, qualified_name, span_path) and ``edges``.

    ``projects`` limits everything to those projects' nodes unless a request names others; ``lexical`` is the
    version's stored postings, without which a search counts tokens in the nodes; ``adjacency`` is its stored
    edges by node, without which the first walk writes one; ``planners`` are tried in order for questions that no
    rule knows, each a function from the question to one JSON object.
    """

    def __init__(self, nodes: DataFrame, edges: DataFrame, version: int = 0, projects: Sequence[str] = (), lexical: LexicalIndex | None = None, catalog: Catalog | None = None, planners: Sequence[Callable[[str], str]] = (), adjacency: Adjacency | None = None):
        self.nodes, self.edges, self.version, self._adjacency = nodes, edges, version, adjacency
        self._along: dict[tuple[str, ...], Adjacency] = {}
        self.projects, self.lexical, self.catalog, self.planners = tuple(projects), lexical, catalog, tuple(planners)
        self._scopes: dict[tuple[str, ...], DataFrame] = {}

    @classmethod
    def open(cls, store, version: int | None = None, projects: Sequence[str] = (), **more) -> Engine:
        """Over a stored version and its indexes."""
        m = store.manifest()
        v = m.latest() if version is None else m.check(version)
        nodes = store.rows("nodes", v).selectExpr("node_id", "kind", "label", "qualified_name", "source_path as span_path")
        edges = store.workspace("edges", v).select(*traverse.EDGE_KEY)
        return cls(nodes, edges, v, projects, LexicalIndex.stored(store, v), adjacency=Adjacency(store.workspace("adjacency", v)), **more)

    @property
    def adjacency(self) -> Adjacency:
        """Edges by node."""
        if self._adjacency is None:
            self._adjacency = Adjacency.build(self.nodes, self.edges)
        return self._adjacency

    def along(self, names: Sequence[str] | None) -> Adjacency:
        """Edges of some relations by node: all edges' table if there is one, else one of these alone, kept between requests."""
        if self._adjacency is not None or not names:
            return self.adjacency
        key = tuple(sorted(set(names)))
        if key not in self._along:
            self._along[key] = Adjacency.build(self.nodes, self.edges.filter(F.col("relation").isin(list(key))))
        return self._along[key]

    def close(self) -> None:
        """Let go of what was kept between requests."""
        self._scopes.clear()

    def scope(self, projects: Sequence[str] | None = None) -> DataFrame | None:
        """The node ids of some projects, or None for all; kept between requests."""
        key = tuple(sorted(self.projects if projects is None else projects))
        if not key:
            return None
        if key not in self._scopes:
            ids = self.nodes.sparkSession.createDataFrame([(p,) for p in key], "node_id string")
            self._scopes[key] = traverse.project_scope(self.edges, ids)
        return self._scopes[key]

    def _walk(self, starts: list[str], direction: str, names: list[str] | None, depth: int, nodes: int, projects: Sequence[str] | None, known: bool = False, alone: bool = False) -> traverse.Traversal:
        """``known`` says that the starts are nodes, ``alone`` that no other relations will be asked for soon."""
        inside = self.scope(projects)
        if inside is None:
            known = set(starts) if known else {r[0] for r in self.nodes.select("node_id").filter(F.col("node_id").isin(sorted(set(starts)))).collect()} if starts else set()
            return traverse.traverse_indexed(self.along(names) if alone else self.adjacency, [s for s in starts if s in known], direction, names, depth, nodes)
        return traverse.traverse(self.nodes, self.adjacency.hops("outgoing"), starts, direction, names, depth, nodes, inside, whole=self.adjacency.whole)

    # --- retrieval -------------------------------------------------------------------------------

    def search(self, text: str, groups: list[list[str]], phrases: Sequence[str] = (), kinds: Sequence[str] = (), limit: int = 10, projects: Sequence[str] | None = None) -> DataFrame:
        """Weighted full-text search; equal labels come first."""
        wanted = match_groups(text, groups, list(phrases))
        if self.lexical is not None:
            found = self.lexical.search(WEIGHTS, wanted, list(phrases))
        else:
            found = bm25(self.nodes, "node_id", search_fields(), WEIGHTS, wanted, list(phrases))
        rows = found.join(self.nodes, "node_id")
        if kinds:
            rows = rows.filter(F.col("kind").isin(list(kinds)))
        if (inside := self.scope(projects)) is not None:
            rows = rows.join(inside, "node_id", "left_semi")
        bare = lambda c: F.regexp_replace(F.lower(c), "[_\\- ]", "")
        return rows.orderBy((bare(F.col("label")) == bare(F.lit(text))).desc(), F.desc("score"), "qualified_name", "node_id").limit(limit)

    def retrieve(self, text: str, limit: int = 10, projects: Sequence[str] | None = None) -> DataFrame:
        """Exact matches, cut to the limit, if there are any, else search results in their order."""
        exact = self._exact(text, "", projects).limit(limit)
        return exact if not exact.isEmpty() else self.search(text, [], limit=limit, projects=projects).select(*self.nodes.columns)

    def _exact(self, text: str, source_path: str, projects: Sequence[str] | None) -> DataFrame:
        found = lookup.exact(self.nodes, text)
        if source_path:
            found = found.filter(F.col("span_path") == source_path)
        if (inside := self.scope(projects)) is not None:
            found = found.join(inside, "node_id", "left_semi").orderBy(*lookup.ORDER)
        return found

    def seeds(self, slot: Slot, phrases: Sequence[str] = (), projects: Sequence[str] | None = None) -> list[dict]:
        """Exact matches with score 1, else fused search results; with a source path the exactly labelled
        ones if there are any; one of each path before a second one of any."""
        rows = self._exact(slot.text, slot.source_path, projects).limit(slot.limit).withColumns({"fused": F.lit(1.0), "exact": F.lit(1.0), "score": F.lit(0.0), "token_coverage": F.lit(0.0)})
        if rows.isEmpty():
            found = self.search(slot.text, slot.groups, phrases, slot.kinds, slot.limit * CANDIDATE_FACTOR, projects)
            if slot.source_path:
                found = found.filter(F.col("span_path") == slot.source_path)
            rows = rank.fuse_few(rank.components(found, slot.text, [t for g in slot.groups for t in g], slot.role, slot.entity_role, slot.kinds, self.scope(projects) is not None))
        if slot.source_path:
            rows = rank.prefer_exact_label(rows, slot.text)
        order = [F.desc("fused"), "qualified_name", "label", "node_id"]
        some = rank.diversify(rows, order, "span_path", "node_id", slot.limit).collect()  # at most the slot's limit
        return [{"node_id": r["node_id"], "label": r["label"], "kind": r["kind"], "score": r["fused"], "exact": r["exact"], "lexical": r["score"], "coverage": r["token_coverage"]} for r in some]

    # --- questions -------------------------------------------------------------------------------

    def plan(self, question: str) -> tuple[Plan, list[dict]]:
        """The rules' plan; for an unknown question the first planner's that holds, and why others did not."""
        plan, failed = analyze(question), []
        if plan.intent == "unknown":
            for planner in self.planners:
                try:
                    return planner_response(question, planner(question)), failed
                except Exception as e:  # noqa: BLE001  a planner is outside code; the rules' plan stands without it
                    failed.append({"code": "planner_failed", "message": f"{getattr(planner, '__name__', 'planner')}: {e}", "suggestions": []})
        return plan, failed

    def ask(self, question: str, max_depth: int | None = None, max_nodes: int | None = None, projects: Sequence[str] | None = None) -> Answer:
        """Plan, seed, stop where a slot has no certain entity, then run the plan's operator."""
        plan, failed = self.plan(question)
        depth, nodes = plan.max_depth if max_depth is None else max_depth, plan.max_nodes if max_nodes is None else max_nodes
        out = Answer(plan, warnings=failed)
        if plan.intent == "capability":
            out.catalog = self.rank_catalog(question)
            return out
        for s in plan.slots:
            out.seeds[s.role] = self.seeds(s, plan.phrases, projects)
            out.stage("retrieval", s.role, nodes=s.limit)
        if plan.intent == "unknown":
            self._found(out)
            for w in plan.warnings:
                out.warn(w["code"], w["message"], ["Ask where something is: where is <name>?", "Ask who calls something: who calls <name>?"])
            out.catalog = self.rank_catalog(question) if self.catalog else None
            return out
        empty = [s for s in plan.slots if not out.seeds[s.role]]
        for s in empty:
            out.warn("entity_not_found", f"Nothing in the graph fits {s.text!r} as {s.role}, so the graph was not asked.", [f"Look {s.text!r} up as a literal term."])
        if empty:
            return self._found(out)
        if plan.operator in ("lookup", "explain"):
            uncertain = self._uncertain(out)
            if uncertain or plan.operator == "lookup":
                return self._found(out)
        starts = {r: [x["node_id"] for x in s] for r, s in out.seeds.items()}
        if plan.operator == "path":
            return self._path(out, depth, nodes, projects)
        if plan.operator == "intersection":
            return self._intersection(out, starts, depth, nodes, projects)
        names = {"impact": relations.impact, "neighbors": relations.dependencies if plan.intent.startswith("depend") else relations.calls}.get(plan.operator, lambda r: r)(plan.relations)
        direction = {"impact": "incoming", "explain": "both"}.get(plan.operator, plan.direction)
        depth = min(depth, 1) if plan.operator == "explain" else depth
        t = self._walk([n for s in starts.values() for n in s], direction, names or None, depth, nodes, projects)
        out.stage("traversal", depth=depth, nodes=nodes, truncated=t.truncated)
        out.truncated, out.edges, out.scope_boundary = t.truncated, t.edges, t.scope_boundary
        out.evidence = self._impact(t) if plan.operator == "impact" else self._groups(t, out, direction)
        return out

    @staticmethod
    def _relevance(out: Answer) -> float:
        return math.prod(s[0]["score"] for s in out.seeds.values() if s)

    @staticmethod
    def _found(out: Answer) -> Answer:
        """The seeds themselves as evidence, best first."""
        confidence = out.plan.confidence if out.plan else 1.0
        rows = [{"node_id": x["node_id"], "label": x["label"], "kind": x["kind"], "role": role, "score": x["score"] * confidence} for role, seeds in out.seeds.items() for x in seeds]
        rows.sort(key=lambda r: (-r["score"], r["node_id"]))
        out.evidence = [{"rank": i + 1, **r} for i, r in enumerate(rows)]
        return out

    @staticmethod
    def _uncertain(out: Answer) -> bool:
        """Warn of more than one candidate, or of one that shares only some of the words."""
        say = "Explain" if out.plan.operator == "explain" else "Look up"
        found = [x for s in out.seeds.values() for x in s]
        if len(found) > 1:
            out.warn("ambiguous_entity", f"{len(found)} entities fit, so the graph was not asked.", [f"{say} {x['node_id']}." for x in found])
        elif not found[0]["exact"] and found[0]["coverage"] < 1:
            out.warn("weak_entity_match", "The only candidate shares just some of the words, so the graph was not asked.", [f"{say} {found[0]['node_id']}."])
        else:
            return False
        return True

    @staticmethod
    def _discovered(t: traverse.Traversal, direction: str):
        """(distance, edge, node) of the edge that first reaches each node of a bounded traversal."""
        for n in t.nodes:
            if t.levels[n]:
                ways = [(e[0] if e[1] == n else e[1], e) for e in t.edges if (direction != "incoming" and e[1] == n) or (direction != "outgoing" and e[0] == n)]
                ways = [w for w in ways if t.levels.get(w[0]) == t.levels[n] - 1]
                if ways:
                    yield t.levels[n], min(ways)[1], n

    def _impact(self, t) -> list[dict]:
        found = [{"node_id": n, "relation": e[2], "distance": d, "score": IMPACT_WEIGHT.get(e[2], 1.0) / d} for d, e, n in self._discovered(t, "incoming")]
        return sorted(found, key=lambda r: (-r["score"], r["distance"], r["node_id"]))

    def _groups(self, t, out: Answer, direction: str) -> list[dict]:
        plan, relevance, groups = out.plan, self._relevance(out), {}
        for d, e, _ in self._discovered(t, direction):
            groups.setdefault((d, e[2]), []).append(e)
        fit = lambda r: 1.0 if any(r == a or r.endswith(":" + a) for a in plan.relations) else 0.5
        found = [{"distance": d, "relation": r, "edges": es, "score": relevance * fit(r) * plan.confidence * len(es) / d} for (d, r), es in groups.items()]
        return sorted(found, key=lambda g: (-g["score"], g["distance"], g["relation"]))

    def _path(self, out: Answer, depth: int, nodes: int, projects) -> Answer:
        """The first directed path between candidates, sources and targets in their order."""
        sides = []
        for s in out.plan.slots:
            both = [x for x in out.seeds[s.role] if x["exact"] and x["lexical"] > 0]
            sides.append([x["node_id"] for x in both or out.seeds[s.role]])
        sources, targets = sides
        searched = any(x["lexical"] > 0 for s in out.seeds.values() for x in s)
        if not searched and (len(sources), len(targets)) != (1, 1):
            return out.warn("ambiguous_path_endpoints", "More than one entity has an endpoint's exact name, so no path was sought.", [f"Run path from {a} to {b}." for a in sources for b in targets])
        names, t = relations.calls(out.plan.relations), None
        inside = self.scope(projects)
        walks = traverse.walk_from_each(self.adjacency, sources, "outgoing", names, depth, nodes) if inside is None else {}
        for source in sources:
            t = walks[source] if inside is None else self._walk([source], "outgoing", names, depth, nodes, projects)
            target = next((x for x in targets if x in t.levels and traverse.path_between(t, source, x) is not None), None)
            if target is not None:
                out.edges = traverse.path_between(t, source, target)
                score = self._relevance(out) * max(1, len(out.edges)) * out.plan.confidence * 2
                out.evidence = [{"source": source, "target": target, "distance": len(out.edges), "relation": out.edges[0][2] if out.edges else "", "score": score, "edges": out.edges}]
                out.scope_boundary = t.scope_boundary
                break
        out.truncated = t.truncated
        out.stage("path", depth=depth, nodes=nodes, truncated=t.truncated)
        if not out.evidence:
            out.warn("no_directed_path", "No directed path came up within the limits, which proves nothing about reachability.", [f"Run path from {sources[0]} to {targets[0]} in either direction."])
        return out

    def _intersection(self, out: Answer, starts: dict, depth: int, nodes: int, projects) -> Answer:
        """What both slots reach, with a path from a seed of each slot to it as proof."""
        names, sides = relations.shared_contract(out.plan.relations), []
        for s in out.plan.slots:
            t = self._walk(starts[s.role], out.plan.direction, names, depth, nodes, projects)
            sides.append(t)
            out.stage("intersection", s.role, depth, nodes, t.truncated)
        out.truncated = sorted({r for t in sides for r in t.truncated})
        frame = lambda t: self.nodes.sparkSession.createDataFrame([(i,) for i in t.nodes], "node_id string")
        near = self.nodes.filter(F.col("node_id").isin([n for t in sides for n in t.nodes]))  # at most two node budgets
        shared = sorted(r[0] for r in evidence.common(near, frame(sides[0]), frame(sides[1])).collect()) if all(t.nodes for t in sides) else []
        if not shared:
            return out.warn("no_common_evidence", "Nothing that the graph holds joins the two entities, so nothing is claimed of them.", [f"Look up {i}." for s in starts.values() for i in s])
        members, proofs = set(shared), set()
        for t, s in zip(sides, out.plan.slots, strict=True):
            for node in shared:
                ways = ((seed, traverse.path_between(t, seed, node, undirected=True)) for seed in starts[s.role] if seed in t.levels and node in t.levels)
                seed, way = next(((a, w) for a, w in ways if w), (None, []))
                proofs.update(way)
                members |= {n for e in way for n in e[:2]} - {seed}
        out.edges = sorted(proofs)
        relation = out.edges[0][2] if out.edges else ""
        fit = 1.0 if any(relation == a or relation.endswith(":" + a) for a in out.plan.relations) else 0.5
        score = self._relevance(out) * fit * out.plan.confidence * len(sides) * len(out.edges)
        out.evidence = [{"role": "+".join(s.role for s in out.plan.slots), "shared": shared, "nodes": sorted(members), "edges": out.edges, "relation": relation, "distance": 1, "score": score}]
        return out

    def rank_catalog(self, text: str) -> dict:
        """The ranked catalog's answer: matches, how they were found, and why not otherwise."""
        if self.catalog is None:
            return {"matches": [], "method": "lexical", "skipped": "no catalog", "warnings": ["there is no catalog to ask"]}
        return cat.ranked(self.catalog.entries, self.catalog.vectors, text, self.catalog.embed)

    # --- literal requests ------------------------------------------------------------------------

    def terms(self, terms: list[str], names: list[str] | None = None, max_depth: int = 2, max_nodes: int = 100, projects: Sequence[str] | None = None) -> traverse.Traversal:
        """Literal lookup of terms, then outgoing traversal; relations are taken as given."""
        inside = self.scope(projects)
        ids = [i for term in terms for i in lookup.resolved_ids(self.nodes, term, 3, inside)]
        return self._walk(ids, "outgoing", names, max_depth, max_nodes, projects, known=True)

    def path(self, source: str, target: str, names: list[str] | None = None, undirected: bool = False, max_depth: int = 8, max_nodes: int = 100, projects: Sequence[str] | None = None) -> dict:
        """Shortest path between two terms that must each resolve to one node; else up to three candidates of
        each and how many more there are (counted up to one)."""
        inside = self.scope(projects)
        ends = {w: lookup.resolved_ids(self.nodes, t, 4, inside) for w, t in (("source", source), ("target", target))}
        if any(len(v) != 1 for v in ends.values()):
            return {"path": None, "candidates": {w: v[:3] for w, v in ends.items()}, "more": {w: max(0, len(v) - 3) for w, v in ends.items()}, "truncated": []}
        (a,), (b,) = ends["source"], ends["target"]
        t = self._walk([a], "outgoing", names, max_depth, max_nodes, projects, known=True, alone=True)
        found = traverse.path_between(t, a, b)
        if found is None and undirected:
            t = self._walk([a], "both", names, max_depth, max_nodes, projects, known=True, alone=True)
            found = traverse.path_between(t, a, b, True)
        return {"path": found, "candidates": {}, "more": {}, "truncated": t.truncated}

    def inspect(self, term: str, projects: Sequence[str] | None = None) -> dict:
        """One node with its edges and neighbours, or up to three candidates."""
        ids = lookup.resolved_ids(self.nodes, term, 4, self.scope(projects))
        if len(ids) != 1:
            return {"candidates": ids[:3], "more": max(0, len(ids) - 3)}
        near, at = traverse.explain(self.nodes, self.adjacency.near([ids[0]], "both").select(*self.edges.columns) if set(self.edges.columns) <= set(traverse.EDGE_KEY) else self.edges, ids[0])
        return {"nodes": near, "edges": at}

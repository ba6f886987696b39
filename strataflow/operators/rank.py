"""Seed ranking: component scores, reciprocal-rank fusion, diversification."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strataflow.functions.lineage import cut
from strataflow.functions.ranks import value_ranks
from strataflow.functions.sizes import small

COMPONENTS = ("exact", "lexical", "entity_role", "node_kind", "project_scope", "path_affinity", "token_coverage")

#: Which base kinds fit a slot's role, and an entity role (fixed values).
ROLE_KINDS = {
    "caller": ("function", "method"), "callee": ("function", "method"),
    "dependent": ("package", "module", "file", "project"), "dependency": ("package", "module", "file", "project"),
    "left": ("class", "interface", "type_alias", "type", "package", "module", "file", "project"), "right": ("class", "interface", "type_alias", "type", "package", "module", "file", "project"),
}
ENTITY_ROLE_KINDS = {"folder": ("file",), "file": ("file",), "package": ("package",), "class": ("class", "type"), "service": ("class", "type")}
FUSION_CONSTANT = 60


def base_kind(kind: Column) -> Column:
    return F.element_at(F.split(kind, ":"), -1)


def role_fit(kind: Column, role: str, entity_role: str = "") -> Column:
    fits = [*ROLE_KINDS.get(role, ()), *ENTITY_ROLE_KINDS.get(entity_role, ())]
    return base_kind(kind).isin(fits).cast("double") if fits else F.lit(0.0)


def coverage(text: Column, tokens: list[str]) -> Column:
    """Share of the tokens that occur in the text, as substrings without case."""
    if not tokens:
        return F.lit(0.0)
    hits = F.lit(0)
    for t in tokens:
        hits = hits + F.lower(text).contains(t.lower()).cast("int")
    return hits / F.lit(float(len(tokens)))


def components(candidates: DataFrame, text: str, tokens: list[str], role: str = "", entity_role: str = "", kinds: list[str] = (), scoped: bool = False) -> DataFrame:
    """Candidates (a lexical score per node) with the seven component columns."""
    best = F.col("_best")  # one row beside each candidate
    lexical = F.when(best > 0, F.col("score") / best).otherwise(F.col("score"))
    candidates = candidates.crossJoin(F.broadcast(candidates.agg(F.max("score").alias("_best"))))
    whole = F.concat_ws(" ", "node_id", "label", "qualified_name", "span_path")
    tokens = tokens or text.lower().split()
    return candidates.withColumns(
        {
            "exact": (F.col("label") == text).cast("double"), "lexical": lexical, "entity_role": role_fit(F.col("kind"), role, entity_role),
            "node_kind": F.col("kind").isin(list(kinds)).cast("double") if kinds else F.lit(0.0), "project_scope": F.lit(float(scoped)),
            "path_affinity": coverage(F.col("span_path"), tokens), "token_coverage": coverage(whole, tokens),
        }
    ).drop("_best")


def fuse(candidates: DataFrame) -> DataFrame:
    """Sum of 1/(60+rank) over the components, ties sharing a rank and zeros having none, for any number of candidates.

    Ranks belong to values, not to rows: the distinct positive values of each component with their counts are ranked by
    ranges and prefix sums and joined back, broadcast where they are few.
    """
    held = cut(candidates)
    values = held.select(F.explode(F.array(*[F.struct(F.lit(c).alias("component"), F.col(c).cast("double").alias("value")) for c in COMPONENTS])).alias("v")).select("v.*").filter("value > 0")
    ranked = value_ranks(values, ["component"], F.col("value"), "_before")
    # a rank is one more than the rows with a greater value
    ranked = cut(ranked.select("component", "_value", (F.col("_total") - F.col("_before") - F.col("_n") + 1).alias("_rank")))
    out, total = held, F.lit(0.0)
    for c in COMPONENTS:
        mine = small(ranked.filter(F.col("component") == c).select(F.col("_value").alias(f"_v_{c}"), F.col("_rank").alias(f"_r_{c}")))
        out = out.join(mine, F.col(c).cast("double") == F.col(f"_v_{c}"), "left")
        total = total + F.coalesce(1 / (FUSION_CONSTANT + F.col(f"_r_{c}")), F.lit(0.0))
    return _fused(out, total).drop(*[f"_{x}_{c}" for c in COMPONENTS for x in "vr"])


def fuse_few(candidates: DataFrame) -> DataFrame:
    """``fuse`` of a request's candidates (at most four times its limit): they fit one row, in which each counts those
    before it."""
    one = candidates.agg(F.collect_list(F.struct(*candidates.columns)).alias("_all"))

    def reciprocal(c: str, x: Column) -> Column:
        before = F.size(F.filter("_all", lambda y: y[c] > x[c]))
        return F.when(x[c] > 0, 1 / (FUSION_CONSTANT + 1 + before)).otherwise(0.0)

    total = lambda x: sum((reciprocal(c, x) for c in COMPONENTS), F.lit(0.0))
    each = one.select(F.explode(F.transform("_all", lambda x: F.struct(x.alias("x"), total(x).alias("total")))).alias("e")).select("e.x.*", "e.total")
    return _fused(each, F.col("total")).drop("total")


def _fused(rows: DataFrame, total: Column) -> DataFrame:
    return rows.withColumn("reciprocal_rank", total).withColumn("fused", F.col("exact") + F.col("reciprocal_rank"))


def diversify(ranked: DataFrame, order: list, path: str, key: str, limit: int) -> DataFrame:
    """The first row of each path by ``order``, then the others, up to ``limit`` distinct keys."""
    first = Window.partitionBy(key).orderBy(*order)
    once = ranked.withColumn("_k", F.row_number().over(first)).filter("_k = 1").drop("_k")
    in_path = F.row_number().over(Window.partitionBy(path).orderBy(*order))
    return once.withColumn("deferred", (in_path > 1).cast("int")).orderBy("deferred", *order).limit(limit)


def prefer_exact_label(candidates: DataFrame, text: str) -> DataFrame:
    """Only the candidates whose label equals the text without case, if there are any."""
    same = F.lower("label") == text.lower()
    any_ = candidates.agg(F.max(same.cast("int")).alias("_any"))  # one row
    return candidates.crossJoin(F.broadcast(any_)).filter((F.col("_any") == 0) | same).drop("_any")


def evidence_score(seed_relevance: Column, distance: Column, fit: Column, confidence: Column, support: Column, diversity: Column) -> Column:
    return seed_relevance * (1 / distance) * fit * confidence * support * diversity

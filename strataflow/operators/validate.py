"""Validation of facts against a vocabulary, as a table of violations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strataflow.functions.sizes import small


def violations(nodes: DataFrame, edges: DataFrame, kinds: DataFrame, endpoints: DataFrame) -> DataFrame:
    """(phase, fact, check_no, code) of every violation.

    ``nodes``: node_id, kind, confidence; ``edges``: source_id, target_id, relation, confidence;
    ``kinds``: kind; ``endpoints``: relation, source_kind, target_kind. Checks run in a fixed order per
    node (empty id, unknown kind, evidence, duplicate), then per edge (relation, evidence, source,
    target, endpoint kinds).
    """
    known = kinds.select("kind", F.lit(True).alias("ok"))
    checked = nodes.join(small(known), "kind", "left")
    bad_confidence = ~F.coalesce(F.col("confidence").isin("extracted", "inferred", "ambiguous"), F.lit(False))

    def found(df: DataFrame, phase: int, no: int, code: str, when, fact="node_id") -> DataFrame:
        return df.filter(when).select(F.lit(phase).alias("phase"), F.col(fact).alias("fact") if isinstance(fact, str) else fact.alias("fact"), F.lit(no).alias("check_no"), F.lit(code).alias("code"))

    n = found(checked, 1, 1, "empty_node_id", F.coalesce(F.col("node_id"), F.lit("")) == "").union(found(checked, 1, 2, "unknown_node_kind", F.col("ok").isNull())).union(found(checked, 1, 3, "invalid_node_evidence", bad_confidence))
    twice = nodes.groupBy("node_id").agg(F.count("*").alias("n")).filter("n > 1")
    n = n.union(found(twice, 1, 4, "duplicate_node", F.lit(True)))
    key = F.concat_ws("|", "source_id", "target_id", "relation")
    relations = endpoints.select("relation").distinct().withColumn("known", F.lit(True))
    ids = nodes.groupBy("node_id").agg(F.min("kind").alias("k"))
    e = (
        edges.join(small(relations), "relation", "left")
        .join(ids.select(F.col("node_id").alias("source_id"), F.col("k").alias("source_kind")), "source_id", "left")
        .join(ids.select(F.col("node_id").alias("target_id"), F.col("k").alias("target_kind")), "target_id", "left")
        .join(small(endpoints.select("relation", "source_kind", "target_kind", F.lit(True).alias("allowed"))), ["relation", "source_kind", "target_kind"], "left")
    )
    both = F.col("source_kind").isNotNull() & F.col("target_kind").isNotNull() & F.col("known").isNotNull()
    return (
        n.union(found(e, 2, 5, "unknown_relation", F.col("known").isNull(), key)).union(found(e, 2, 6, "invalid_edge_evidence", bad_confidence, key))
        .union(found(e, 2, 7, "missing_source", F.col("source_kind").isNull(), key)).union(found(e, 2, 8, "missing_target", F.col("target_kind").isNull(), key))
        .union(found(e, 2, 9, "invalid_endpoint", both & F.col("allowed").isNull(), key))
    )


def first_violation(table: DataFrame) -> DataFrame:
    """The violation a sequential check would report: smallest phase, fact, check."""
    return table.orderBy("phase", "fact", "check_no").limit(1)


def vocabulary_errors(kinds: list[str], endpoints: list[tuple[str, str, str]], relations: list[str] = ()) -> list[str]:
    """Problems of a vocabulary's own definition; ``relations`` are those it declares."""
    out = ["empty kind"] if any(not k for k in kinds) else []
    out += [f"duplicate kind {k}" for k in sorted({k for k in kinds if kinds.count(k) > 1})]
    out += ["empty relation"] if any(not r for r in [*relations, *(r for r, _, _ in endpoints)]) else []
    out += [f"duplicate relation {r}" for r in sorted({r for r in relations if list(relations).count(r) > 1})]
    out += [f"relation {r} has no endpoints" for r in relations if r not in {x for x, _, _ in endpoints}]
    out += [f"relation {r} has unknown endpoint {k}" for r, s, t in endpoints for k in (s, t) if k not in kinds]
    return out


#: What a row of each contribution table must have, and which of its columns names a node of its own source.
REQUIRED = {
    "units": (("node_id", "name", "kind", "signature"), "node_id"), "references": (("source_id", "target", "kind"), "source_id"), "symbols": (("source_id", "target", "relation"), "source_id"),
    "surfaces": (("node_id", "name"), "node_id"), "dependencies": (("source_path", "target_path"), None), "diagnostics": (("message", "severity"), None),
}
REFERENCE_KINDS, SEVERITIES = ("import", "re_export", "require"), ("error", "warning", "info")


def contribution_violations(nodes: DataFrame, tables: dict[str, DataFrame]) -> DataFrame:
    """(source_path, part, code, detail) of everything wrong with contribution tables (see ``REQUIRED``).

    Codes: incomplete, not_local, unsupported (a reference's kind or a diagnostic's severity), empty_token,
    empty_binding.
    """
    out = None

    def found(part: str, code: str, rows: DataFrame, detail) -> None:
        nonlocal out
        some = rows.select("source_path", F.lit(part).alias("part"), F.lit(code).alias("code"), detail.cast("string").alias("detail"))
        out = some if out is None else out.unionByName(some)

    for part, df in tables.items():
        columns, local = REQUIRED[part]
        blank = F.lit(False)
        for c in columns:
            blank = blank | (F.coalesce(F.col(c), F.lit("")) == "")
        found(part, "incomplete", df.filter(blank), F.concat_ws("|", *columns))
        if local:
            found(part, "not_local", local_references(df.filter(F.col(local) != ""), nodes.select("source_path", "node_id"), local), F.col(local))
        allowed = {"references": ("kind", REFERENCE_KINDS), "diagnostics": ("severity", SEVERITIES)}.get(part)
        if allowed:
            found(part, "unsupported", df.filter((F.col(allowed[0]) != "") & ~F.col(allowed[0]).isin(*allowed[1])), F.col(allowed[0]))
        if part == "units" and "tokens" in df.columns:
            found(part, "empty_token", df.filter(F.exists("tokens", lambda t: F.coalesce(t, F.lit("")) == "")), F.col("node_id"))
        if part == "references" and "bindings" in df.columns:
            found(part, "empty_binding", df.filter(F.exists("bindings", lambda b: F.coalesce(b["imported"], F.lit("")) == "")), F.col("target"))
    return out


def local_references(units: DataFrame, nodes: DataFrame, key: str = "node_id") -> DataFrame:
    """Rows of a contribution that name a node the same source does not define."""
    return units.join(nodes.select("source_path", F.col("node_id").alias(key)).distinct(), ["source_path", key], "left_anti")

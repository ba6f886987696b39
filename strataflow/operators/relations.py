"""Generic relation names and their language variants."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from strataflow.schema import LANGUAGES

DEPENDENCY = ("imports_from", "requires", "depends_on")
IMPACT = ("references", "implements", "contains", "calls", "imports_from", "requires", "depends_on")
EXPANDED_IN_IMPACT = ("implements", "calls", "imports_from", "requires", "depends_on")


def expand(relations, generic) -> list[str]:
    """Each relation, followed by its language variants if it is in ``generic``."""
    out = []
    for r in relations:
        out.append(r)
        if r in generic:
            out += [f"{lang}:{r}" for lang in LANGUAGES]
    return out


def calls(relations) -> list[str]:
    return expand(relations, ("calls",))


def dependencies(relations) -> list[str]:
    return expand(relations, tuple(relations))


def impact(relations=IMPACT) -> list[str]:
    return expand(relations, EXPANDED_IN_IMPACT)


def shared_contract(relations) -> list[str]:
    return [*expand(relations, ("implements",)), "defines", "references"]


def fit(relation: Column, allowed) -> Column:
    """1 for an allowed relation or its language variant, else one half."""
    hit = F.lit(False)
    for r in allowed:
        hit = hit | (relation == r) | relation.endswith(":" + r)
    return F.when(hit, 1.0).otherwise(0.5)


def impact_weight(relation: Column) -> Column:
    return F.when(relation == "contains", 0.25).when(relation == "implements", 0.9).otherwise(1.0)

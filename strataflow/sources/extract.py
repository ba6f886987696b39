"""Per-file extraction as a plug-in over Arrow batches.

A parser maps (path, language, text) to the rows of ``parse.Parsed``; one file is parsed once for all tables.
Parsers are registered per file extension.
"""

from __future__ import annotations

from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strataflow.schema import EXTENSIONS

from .parse import Parsed, parse

BINDINGS = "array<struct<imported:string,local:string>>"
#: Columns of each table, besides source_path.
TABLES = {
    "nodes": {"node_id": "string", "kind": "string", "label": "string", "qualified_name": "string", "line": "int", "exported": "boolean", "start_column": "int", "end_line": "int", "end_column": "int", "owner": "string", "signature": "string", "comments": "array<string>"},
    "edges": {"source_id": "string", "target_id": "string", "relation": "string"},
    "references": {"specifier": "string", "kind": "string", "line": "int", "ambiguous": "boolean", "bindings": BINDINGS},
    "symbols": {"source_id": "string", "target": "string", "receiver": "string", "relation": "string", "line": "int"},
    "exports": {"local": "string", "exported_name": "string"},
}
_ALL: dict[str, str] = {k: v for t in TABLES.values() for k, v in t.items()}
ARROW = {"string": pa.string(), "int": pa.int32(), "boolean": pa.bool_(), "array<string>": pa.list_(pa.string()), BINDINGS: pa.list_(pa.struct([("imported", pa.string()), ("local", pa.string())]))}
#: Tasks that parse, for each core, and most rows of a batch that they hand on.
TASKS, BATCH = 4, 20_000


class Registry:
    """Parsers by file extension; an extension belongs to one language and one parser."""

    def __init__(self):
        self.languages: dict[str, str] = {}
        self.parsers: dict[str, Callable[[str, str, str], Parsed]] = {}

    def register(self, language: str, extensions: list[str], parser: Callable[[str, str, str], Parsed]) -> Registry:
        taken = [e for e in extensions if e in self.languages]
        if taken or language in self.parsers:
            raise ValueError(f"registered already: {taken or language}")
        if bad := [e for e in extensions if not e.startswith(".")]:
            raise ValueError(f"not an extension: {bad}")
        self.languages |= dict.fromkeys(extensions, language)
        self.parsers[language] = parser
        return self

    def language(self, path: Column) -> Column:
        """The language of a path's extension, or null."""
        if not self.languages:
            return F.lit(None).cast("string")
        table = F.create_map(*[F.lit(x) for pair in self.languages.items() for x in pair])
        return F.try_element_at(table, F.regexp_extract(path, r"(\.[^./]+)$", 1))


def default_registry() -> Registry:
    out = Registry()
    for language in dict.fromkeys(EXTENSIONS.values()):
        out.register(language, [e for e, of in EXTENSIONS.items() if of == language], parse)
    return out


def rows(p: Parsed, only: str | None = None) -> list[dict]:
    """One file's rows with the table that each belongs to; of one table ``only``, if it is named."""
    made = {
        "nodes": lambda: p.nodes,
        "edges": lambda: [{"source_id": a, "target_id": b, "relation": r} for a, b, r in p.edges],
        "references": lambda: [{"specifier": s, "kind": k, "line": n, "ambiguous": a, "bindings": [{"imported": i, "local": o} for i, o in b]} for s, k, n, a, b in p.references],
        "symbols": lambda: [{"source_id": a, "target": t, "receiver": r, "relation": rel, "line": n} for a, t, r, rel, n in p.symbols],
        "exports": lambda: [{"local": a, "exported_name": b} for a, b in p.exports],
    }
    return [{"table": t, "source_path": p.path, **x} for t in (made if only is None else [only]) for x in made[t]()]


def spread(sources: DataFrame) -> DataFrame:
    """``sources`` dealt by path to a fixed number of tasks: parsing costs far more than reading, and a scan has a task
    per so many bytes, which are few for a table that texts are made of."""
    return sources.repartition(TASKS * sources.sparkSession.sparkContext.defaultParallelism, "path")


def extract_all(sources: DataFrame, registry: Registry | None = None, fail_fast: bool = True, only: str | None = None) -> DataFrame:
    """All rows of every source (path, language, content), or those of one table ``only``. A parse error fails the run
    unless ``fail_fast`` is off, which leaves the file out. Write the result before several tables are taken from it."""
    parsers = (registry or default_registry()).parsers
    kinds = {"source_path": "string", **TABLES[only]} if only else {"table": "string", "source_path": "string", **_ALL}

    def batch(out: list[dict]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([x.get(c) for x in out], ARROW[kind]) for c, kind in kinds.items()], names=list(kinds))

    def run(batches):
        for given in batches:
            out: list[dict] = []
            for path, language, text in zip(*(given.column(c).to_pylist() for c in ("path", "language", "content")), strict=True):
                try:
                    out += rows(parsers[language](path, language, text or ""), only)
                except Exception as e:
                    if fail_fast:
                        raise ValueError(f"{path}: {e}") from e
                if len(out) >= BATCH:
                    yield batch(out)
                    out = []
            yield batch(out)

    return spread(sources.select("path", "language", "content")).mapInArrow(run, ", ".join(f"{c} {kind}" for c, kind in kinds.items()))


def table(found: DataFrame, name: str) -> DataFrame:
    """One table of ``extract_all``'s rows."""
    return found.filter(F.col("table") == name).select("source_path", *TABLES[name])


def extract(sources: DataFrame, what: str = "nodes", registry: Registry | None = None, fail_fast: bool = True) -> DataFrame:
    """One table of every source; see ``extract_all``."""
    return extract_all(sources, registry, fail_fast, what)

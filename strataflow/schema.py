"""Column layouts, vocabularies and fixed name lists of the graph model."""

from __future__ import annotations

from pyspark.sql import types as T

SPAN = T.StructType([T.StructField("path", T.StringType()), *[T.StructField(n, T.IntegerType()) for n in ("start_line", "start_column", "end_line", "end_column")]])
EVIDENCE = T.StructType([T.StructField("span", SPAN), *[T.StructField(n, T.StringType()) for n in ("file_hash", "extractor", "provenance", "confidence")]])
NODE = T.StructType([*[T.StructField(n, T.StringType()) for n in ("id", "kind", "label", "qualified_name")], T.StructField("evidence", EVIDENCE)])
EDGE = T.StructType([*[T.StructField(n, T.StringType()) for n in ("source_id", "target_id", "relation")], T.StructField("evidence", EVIDENCE)])

CONFIDENCES = ("extracted", "inferred", "ambiguous")
LANGUAGES = ("go", "javascript", "typescript")
SHARED_KINDS = ("project", "file", "symbol")
LANGUAGE_KINDS = {
    "go": ("package", "type", "struct", "interface", "type_alias", "constant", "function", "method", "variable"),
    "javascript": ("class", "function", "method", "variable"),
    "typescript": ("class", "function", "method", "interface", "type_alias", "variable"),
}
LANGUAGE_RELATIONS = {
    "go": ("imports_from", "implements", "embeds", "calls"),
    "javascript": ("imports_from", "re_exports", "extends", "calls"),
    "typescript": ("imports_from", "re_exports", "extends", "implements", "calls"),
}
SHARED_RELATIONS = ("contains", "defines", "references")
EXTENSIONS = {".go": "go", ".js": "javascript", ".jsx": "javascript", ".ts": "typescript", ".tsx": "typescript"}
INTERNAL_DIRS = (".git", "node_modules", ".strataflow")
ROOT_MARKERS = ("go.mod", "package.json", "tsconfig.json", "jsconfig.json")
RETAINED_VERSIONS = 25
SCHEMA_VERSION = 1


def kinds() -> list[str]:
    return [*SHARED_KINDS, *(f"{lang}:{k}" for lang, ks in LANGUAGE_KINDS.items() for k in ks)]

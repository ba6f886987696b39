"""Project configuration: path aliases, package entry points and Go modules as rows."""

from __future__ import annotations

import json
import posixpath
import re

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

NAMES = ("package.json", "tsconfig.json", "jsconfig.json", "go.mod", "go.work")
SCHEMA = "kind string, dir string, key string, value string, position int"
#: Export conditions that an import may take, best first (fixed values).
CONDITIONS = ("import", "require", "default")


def relaxed_json(text: str):
    """JSON with comments and trailing commas."""
    bare = re.sub(r'("(?:\\.|[^"\\])*")|//[^\n]*|/\*.*?\*/', lambda m: m[1] or "", text, flags=re.S)
    return json.loads(re.sub(r'("(?:\\.|[^"\\])*")|,(?=\s*[}\]])', lambda m: m[1] or "", bare))


def below(where: str, path: str) -> str:
    """A path of a configuration file in ``where``, relative to the workspace."""
    out = posixpath.normpath(posixpath.join(where, path))
    return "" if out == "." else out


def targets(value) -> list[str]:
    """The files that an exports value can mean, best condition first."""
    if isinstance(value, str):
        return [value]
    if isinstance(value, list):
        return [t for v in value for t in targets(v)]
    return [t for c in CONDITIONS if c in value for t in targets(value[c])] if isinstance(value, dict) else []


def aliases(where: str, config: dict) -> list[tuple]:
    options = config.get("compilerOptions") or {}
    base = below(where, options.get("baseUrl", "."))
    out = [("alias", where, pattern, below(base, options_[0]), i) for i, (pattern, options_) in enumerate((options.get("paths") or {}).items()) if options_]
    return out + ([("base", where, "", base, 0)] if "baseUrl" in options else []) + [("config", where, "", "", 0)]


def packages(where: str, config: dict) -> list[tuple]:
    exports, out = config.get("exports"), []
    if exports is not None:
        table = exports if isinstance(exports, dict) and any(k.startswith(".") for k in exports) else {".": exports}
        out = [("package", where, sub, below(where, t), i) for sub, value in table.items() for i, t in enumerate(targets(value))]
    else:
        out = [("package", where, ".", below(where, config[k]), i) for i, k in enumerate(("module", "main")) if isinstance(config.get(k), str)]
        out += [("package", where, ".", below(where, "index"), 9), ("open_package", where, "", where, 0)]
    return out + ([("named", where, config["name"], where, 0)] if isinstance(config.get("name"), str) else [])


def modules(where: str, text: str) -> list[tuple]:
    """The module of a go.mod, and its local replacements."""
    out, inside = [], False
    for line in text.splitlines():
        line = line.split("//")[0].strip() if "replace" in line or not line.startswith("module") else line.split(" //")[0].strip()
        if m := re.match(r"module\s+\"?([^\s\"]+)", line):
            out.append(("module", where, m[1], where, 0))
        inside = (inside or bool(re.match(r"replace\s*\(", line))) and not line.startswith(")")
        if (inside or line.startswith("replace")) and (m := re.match(r"(?:replace\s+)?(\S+)(?:\s+v\S+)?\s+=>\s+(\.\S*)", line)):
            out.append(("module", where, m[1], below(where, m[2]), 1))
    return out


def rows(path: str, text: str) -> list[tuple]:
    """Rows of one configuration file; one that can't be read gives none."""
    where, name = posixpath.dirname(path), posixpath.basename(path)
    try:
        if name == "package.json":
            return packages(where, relaxed_json(text))
        if name in ("tsconfig.json", "jsconfig.json"):
            return aliases(where, relaxed_json(text))
    except (ValueError, TypeError, AttributeError, KeyError):
        return []
    if name == "go.work":
        return [("use", where, "", below(where, d), 0) for d in re.findall(r"(?m)^\s*(?:use\s+)?(\.\S*)", text)]
    return modules(where, text)


def parse_configs(files: DataFrame) -> DataFrame:
    """(kind, dir, key, value, position) of configuration files (path, content)."""

    def run(batches):
        for pdf in batches:
            yield pd.DataFrame([x for p, t in zip(pdf["path"], pdf["content"], strict=True) for x in rows(p, t or "")], columns=["kind", "dir", "key", "value", "position"])

    return files.select("path", "content").mapInPandas(run, SCHEMA)


def read_configs(spark: SparkSession, workspace: str) -> DataFrame:
    """The configuration of a tree, installed packages included; only files of these names are opened."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "{" + ",".join(NAMES) + "}").load(workspace)
    top = workspace.split("://")[-1].rstrip("/") + "/"
    return parse_configs(files.select(F.substring_index("path", top, -1).alias("path"), F.col("content").cast("string").alias("content")))

"""Source discovery: project roots, ownership, globs, ignore rules."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strataflow.operators.resolve import dirname, longest_prefix
from strataflow.schema import EXTENSIONS, INTERNAL_DIRS, ROOT_MARKERS


def glob_regex(pattern: str) -> str:
    """A double-star glob over slash-separated paths as a regular expression."""
    out, i = "", 0
    while i < len(pattern):
        if pattern.startswith("**/", i):
            out, i = out + "(?:.*/)?", i + 3
        elif pattern.startswith("**", i):
            out, i = out + ".*", i + 2
        elif pattern[i] == "*":
            out, i = out + "[^/]*", i + 1
        elif pattern[i] == "?":
            out, i = out + "[^/]", i + 1
        elif pattern[i] == "[" and "]" in pattern[i + 1 :]:
            end = pattern.index("]", i + 2) if "]" in pattern[i + 2 :] else pattern.index("]", i + 1)
            body = pattern[i + 1 : end]
            out, i = out + "[" + ("^" + body[1:] if body[:1] in "!^" else body) + "]", end + 1
        elif pattern[i] == "{" and "}" in pattern[i:]:
            end = pattern.index("}", i)
            out, i = out + "(?:" + "|".join(glob_regex(p) for p in pattern[i + 1 : end].split(",")) + ")", end + 1
        else:
            out, i = out + re.escape(pattern[i]), i + 1
    return out


def matches(path: Column, patterns: list[str]) -> Column:
    hit = F.lit(False)
    for p in patterns:
        hit = hit | path.rlike(f"^{glob_regex(p)}$")
    return hit


def included(path: Column, include: list[str] | None, exclude: list[str]) -> Column:
    """No include list admits everything, an empty one nothing; excludes come after."""
    return (F.lit(True) if include is None else matches(path, include)) & ~matches(path, exclude)


def internal(path: Column) -> Column:
    """Below an internal directory."""
    return F.arrays_overlap(F.split(path, "/"), F.array(*[F.lit(d) for d in INTERNAL_DIRS]))


def extension(path: Column) -> Column:
    return F.regexp_extract(path, r"(\.[^./]+)$", 1)


def language(path: Column) -> Column:
    table = F.create_map(*[F.lit(x) for pair in EXTENSIONS.items() for x in pair])
    return F.try_element_at(table, extension(path))


def project_roots(paths: DataFrame, configured: list[str] = ()) -> DataFrame:
    """(root, project_id): directories of the marker files, and configured ones."""
    base = F.element_at(F.split("path", "/"), -1)
    found = paths.filter(base.isin(*ROOT_MARKERS)).select(dirname(F.col("path")).alias("root"))
    if configured:
        found = found.union(paths.sparkSession.createDataFrame([(r.strip("/"),) for r in configured], "root string"))
    return found.distinct().withColumn("project_id", F.concat(F.lit("project:"), F.when(F.col("root") == "", ".").otherwise(F.col("root"))))


class IgnoreRules:
    """Nested ignore files: rules in order, the last match wins, a negation re-admits, and nothing below an
    ignored directory can be re-admitted."""

    def __init__(self, files: dict[str, str]):
        self.rules = []
        for where in sorted(files, key=lambda d: (d.count("/") + bool(d), d)):
            for line in files[where].splitlines():
                line = line.rstrip()
                if not line or line.startswith("#"):
                    continue
                negated = line.startswith("!")
                line = line[negated:].lstrip("\\") if line.startswith("\\") else line[negated:]
                only_dir, body = line.endswith("/"), line.strip("/")
                anchored = "/" in line.rstrip("/")
                prefix = re.escape(where + "/") if where else ""
                self.rules.append((re.compile(prefix + ("" if anchored else "(?:.*/)?") + glob_regex(body)), negated, only_dir))

    def _last(self, path: str, is_dir: bool) -> bool:
        ignored = False
        for pattern, negated, only_dir in self.rules:
            if (is_dir or not only_dir) and pattern.fullmatch(path):
                ignored = not negated
        return ignored

    def ignores(self, path: str) -> bool:
        parts = path.split("/")
        return any(self._last("/".join(parts[:i]), True) for i in range(1, len(parts))) or self._last(path, False)


def ignored_column(spark: SparkSession, files: dict[str, str]):
    """A column function path -> ignored, for the (few) ignore files of a workspace."""
    shipped = spark.sparkContext.broadcast(IgnoreRules(files))

    @F.pandas_udf("boolean")
    def run(paths: pd.Series) -> pd.Series:
        return paths.map(shipped.value.ignores)

    return run


def owned(paths: DataFrame, roots: DataFrame) -> DataFrame:
    """Each source with its most specific project root; sources under none are dropped."""
    return longest_prefix(paths.select("path"), "path", roots).join(roots, "root")


def ignore_files(spark: SparkSession, workspace: str, depth: int) -> dict[str, str]:
    """The tree's own ``.gitignore`` files by directory, down to ``depth``; as many as directories that have one.

    Spark's readers pass over names that begin with a dot, so they are found by one pattern for each depth."""
    jvm, root = spark.sparkContext._jvm, workspace.rstrip("/")
    files = jvm.org.apache.hadoop.fs.Path(root).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    top, out = root.split("://")[-1] + "/", {}
    for d in range(depth):
        for status in files.globStatus(jvm.org.apache.hadoop.fs.Path(root + "/*" * d + "/.gitignore")) or []:
            where = status.getPath().toString().rpartition(top)[2].rpartition("/")[0]
            if set(where.split("/")).isdisjoint(INTERNAL_DIRS):
                stream = files.open(status.getPath())
                try:
                    out[where] = jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
                finally:
                    stream.close()
    return out


def _files(spark: SparkSession, workspace: str, names: str | None = None) -> DataFrame:
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", "true")
    return (reader.option("pathGlobFilter", names) if names else reader).load(workspace)


def discover(spark: SparkSession, workspace: str, include: list[str] | None = None, exclude: list[str] = (), ignore: dict[str, str] | None = None, configured: list[str] = (), only: DataFrame | None = None) -> DataFrame:
    """(path, root, project_id, language, content) of a directory tree's supported sources.

    Ignore rules are those of the tree's ``.gitignore`` files unless ``ignore`` gives others. ``only`` (path)
    limits the result; paths are judged before any content is read.
    """
    top = workspace.split("://")[-1].rstrip("/") + "/"
    whole = _files(spark, workspace)
    paths = whole.select(F.substring_index("path", top, -1).alias("path")).filter(~internal(F.col("path")))
    roots = project_roots(paths, list(configured))
    keep = language(F.col("path")).isNotNull() & included(F.col("path"), include, list(exclude))
    wanted = paths.filter(keep) if only is None else paths.filter(keep).join(only, "path", "left_semi")
    if ignore is None:
        deepest = paths.agg(F.max(F.size(F.split("path", "/")))).first()[0] or 1
        ignore = ignore_files(spark, workspace, deepest)
    rules = ignore
    if rules:
        wanted = wanted.filter(~ignored_column(spark, rules)(F.col("path")))
    chosen = owned(wanted, roots)
    if only is not None:
        few = [r["path"] for r in chosen.select("path").collect()]  # as many as paths were asked for
        content = spark.read.format("binaryFile").load([f"{workspace.rstrip('/')}/{p}" for p in few]) if few else whole.limit(0)
    else:
        content = whole
    content = content.select(F.substring_index("path", top, -1).alias("path"), F.col("content").cast("string").alias("content"))
    return content.join(chosen, "path").select("path", "root", "project_id", language(F.col("path")).alias("language"), "content")

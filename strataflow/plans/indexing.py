"""Full and incremental indexing: discover, extract, resolve, publish."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strataflow.functions.lineage import cut
from strataflow.functions.sizes import small
from strataflow.operators import incremental, resolve
from strataflow.operators.adjacency import both_ways, laid_out
from strataflow.sources.configs import read_configs
from strataflow.sources.discovery import discover
from strataflow.sources.extract import TABLES, extract_all, table
from strataflow.sources.store import Staged, Store
from strataflow.streaming.feed import normalised

from .engine import search_fields
from .lexical import segment

CONTRIBUTED = tuple(TABLES)


@dataclass
class Facts:
    """The contribution tables of all sources that a version will show, and the configuration of its tree."""

    nodes: DataFrame
    references: DataFrame
    symbols: DataFrame
    edges: DataFrame
    exports: DataFrame
    configs: DataFrame
    owners: DataFrame | None = None

    @classmethod
    def staged(cls, view: Staged, configs: DataFrame) -> Facts:
        """Scans of the base and the segments with what this version replaces masked: reading them again costs no shuffle."""
        return cls(**{n: view.contributions(n) for n in CONTRIBUTED}, configs=configs)

    def of(self, owners: DataFrame | None) -> Facts:
        """The same with only the references, symbols and local edges of some sources."""
        if owners is None:
            return self
        few = small(owners.select("source_path"))
        some = lambda df: df.join(few, "source_path", "left_semi")
        return Facts(self.nodes, some(self.references), some(self.symbols), some(self.edges), self.exports, self.configs, few)


def surfaces(f: Facts) -> DataFrame:
    """(path, name, node_id) of what each file exports itself: declarations, and names that it exports them as."""
    own = f.nodes.filter("exported and kind not in ('file', 'project') and owner = ''")
    direct = own.select(F.col("source_path").alias("path"), F.col("label").alias("name"), "node_id")
    renamed = f.exports.join(f.nodes.filter("owner = ''").select("source_path", F.col("label").alias("local"), "node_id"), ["source_path", "local"])
    return direct.union(renamed.select("source_path", "exported_name", "node_id")).distinct()


def is_go(path: str = "source_path"):
    return F.col(path).endswith(".go")


def workspace_edges(f: Facts, owners: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Resolved edges (source_id, target_id, relation, owner, confidence) and references without a target.

    ``owners`` limits the work to the references and symbols of some sources; what they refer to may be anywhere.
    """
    mine = f.of(owners)
    own = mine.edges.select("source_id", "target_id", "relation", F.col("source_path").alias("owner"), F.lit("extracted").alias("confidence"))
    found, missing = [own], None
    # a language without references and symbols among the owners costs two looks, not its resolution
    has = lambda df, go: not df.filter(is_go() == F.lit(go)).isEmpty()
    if has(mine.references, False) or has(mine.symbols, False):
        known, missing = _script_edges(f, mine)
        found += known
    if has(mine.references, True) or has(mine.symbols, True) or has(mine.edges, True):
        found.append(_inferred(_go_edges(f, mine)))
    every_edge = found[0]
    for more in found[1:]:
        every_edge = every_edge.unionByName(more)
    # an edge that more than one reference gives is as sure as the surest of them
    sure = F.min(F.array_position(F.array(F.lit("extracted"), F.lit("inferred"), F.lit("ambiguous")), F.col("confidence")))
    edges = every_edge.groupBy("source_id", "target_id", "relation", "owner").agg(F.element_at(F.array(F.lit("extracted"), F.lit("inferred"), F.lit("ambiguous")), sure.cast("int")).alias("confidence"))
    none = f.references.sparkSession.createDataFrame([], "source_path string, specifier string, severity string")
    return edges, none if missing is None else missing


def _inferred(rows: DataFrame) -> DataFrame:
    return rows.select("source_id", "target_id", "relation", F.col("source_path").alias("owner"), F.lit("inferred").alias("confidence"))


def _script_edges(f: Facts, mine: Facts) -> tuple[list[DataFrame], DataFrame]:
    """Edges of JavaScript and TypeScript sources, and their references without a target."""
    files = f.nodes.filter("kind = 'file'").select(F.col("source_path").alias("path"))
    script = mine.references.filter(~is_go())
    every = f.references.filter(~is_go())
    # re-exports pass names on through any number of files, so they are resolved for all of them
    hops_of = every.filter("kind = 're_export'")
    asked = script.select("source_path", "specifier").union(hops_of.select("source_path", "specifier")).distinct()
    found = []
    for javascript, endings in ((True, resolve.JAVASCRIPT_ENDINGS), (False, resolve.TYPESCRIPT_ENDINGS)):
        some = asked.filter(F.col("source_path").rlike(r"\.jsx?$") == F.lit(javascript))
        found.append(resolve.script_targets(some, files, f.configs, endings))
    targets = cut(found[0].unionByName(found[1]))
    at = ["source_path", "specifier"]
    hops = hops_of.join(targets.filter("target_path is not null"), at).select(F.col("source_path").alias("path"), "target_path", F.explode("bindings").alias("b")).select("path", "target_path", F.col("b.imported").alias("imported"), F.col("b.local").alias("exported"))
    named = cut(resolve.re_export_closure(surfaces(f), hops))
    language = F.when(is_go(), "go").when(F.col("source_path").rlike(r"\.jsx?$"), "javascript").otherwise("typescript")
    resolved = script.join(targets, at)
    hit = resolved.filter("target_path is not null")
    file_id = F.concat(F.lit("file:"), F.col("source_path"))
    relation = F.concat(language, F.when(F.col("kind") == "re_export", ":re_exports").otherwise(":imports_from"))
    confidence = F.when(F.col("ambiguous"), "ambiguous").otherwise("extracted")
    to_file = hit.select(file_id.alias("source_id"), F.concat(F.lit("file:"), F.col("target_path")).alias("target_id"), relation.alias("relation"), F.col("source_path").alias("owner"), confidence.alias("confidence"))
    to_name = hit.join(named.select(F.col("path").alias("target_path"), "node_id"), "target_path").select(file_id.alias("source_id"), F.col("node_id").alias("target_id"), relation.alias("relation"), F.col("source_path").alias("owner"), confidence.alias("confidence"))
    bindings = hit.select("source_path", "target_path", F.explode("bindings").alias("b")).select("source_path", "target_path", F.col("b.imported").alias("imported"), F.col("b.local").alias("local"))
    uses = mine.symbols.filter(~is_go())
    through = resolve.bound_targets(uses, bindings, named)
    local = f.nodes.filter(~is_go() & (F.col("kind") != "file")).select("source_path", F.col("owner").alias("receiver"), F.col("label").alias("target"), "node_id")
    within = uses.join(local, ["source_path", "receiver", "target"]).select("source_id", F.col("node_id").alias("target_id"), "relation", "source_path")
    return [to_file, to_name, _inferred(through.unionByName(within))], resolve.unresolved(resolved)


def _go_edges(f: Facts, mine: Facts) -> DataFrame:
    """Imports, calls, embedding and implementation of Go sources: (source_id, target_id, relation, source_path)."""
    here = resolve.dirname(F.col("source_path"))
    declared = f.nodes.filter(is_go() & ~F.col("kind").isin("file", "go:package")).select(here.alias("dir"), "owner", "label", "exported", "node_id", "kind", "source_path")
    refs = mine.references.filter(is_go())
    at = ["source_path", "specifier"]
    places = refs.join(resolve.go_packages(refs, f.configs), at)
    package = f.nodes.filter("kind = 'go:package'").groupBy(here.alias("target_dir")).agg(F.min("label").alias("package"))
    alias = F.coalesce(F.try_element_at("bindings", F.lit(1))["local"], F.col("package"), F.element_at(F.split("specifier", "/"), -1))
    imports = places.join(package, "target_dir", "left").select("source_path", "target_dir", alias.alias("alias")).distinct()
    file_id = F.concat(F.lit("file:"), F.col("source_path")).alias("source_id")
    one = imports.select("source_path", "target_dir").distinct()
    mates = f.nodes.filter(is_go() & (F.col("kind") == "file")).select(here.alias("target_dir"), F.col("node_id").alias("target_id"))
    shown = declared.filter("exported and owner = ''").select(F.col("dir").alias("target_dir"), F.col("node_id").alias("target_id"))
    members = mates.union(shown).select(F.col("target_dir").alias("dir"), F.col("target_id").alias("node_id"))
    imported = resolve.package_edges(one.select(file_id, "target_dir"), members).select("source_id", "target_id", F.lit("go:imports_from").alias("relation"), F.substring("source_id", 6, 1 << 30).alias("source_path"))
    symbols = mine.symbols.filter(is_go())
    callable_ = declared.filter("kind in ('go:function', 'go:method')").drop("kind", "source_path")
    calls = resolve.package_uses(symbols.filter("relation = 'go:calls'"), imports, callable_)
    types = declared.filter("kind in ('go:type', 'go:struct', 'go:interface', 'go:type_alias')").drop("kind", "source_path")
    embeds = resolve.package_uses(symbols.filter("relation = 'go:embeds'"), imports, types)
    # implementation is judged within packages of one name, over all their files
    methods = declared.filter("kind = 'go:method'").select("dir", F.col("owner").alias("label"), F.col("label").alias("name"))
    owners = declared.filter("kind in ('go:type', 'go:struct')").select("dir", "label", F.col("node_id").alias("type_id"), "source_path")
    if mine is not f:
        owners = owners.join(mine.owners, "source_path", "left_semi")
    package_of = f.nodes.filter("kind = 'go:package'").groupBy(here.alias("dir")).agg(F.min("label").alias("package"))
    have = owners.join(methods, ["dir", "label"]).join(package_of, "dir")
    interfaces = declared.filter("kind = 'go:interface'").select("dir", F.col("node_id").alias("interface_id")).join(package_of, "dir")
    required = f.symbols.filter("relation = 'go:requires'").select(F.col("source_id").alias("interface_id"), F.col("target").alias("name"))
    need = interfaces.join(required, "interface_id").select("package", "interface_id", "name")
    if mine is not f:
        need = need.join(have.select("package").distinct(), "package", "left_semi")
    fits = resolve.implements(have.select("package", "type_id", "name"), need).join(owners.select("type_id", "source_path"), "type_id")
    implemented = fits.select(F.col("type_id").alias("source_id"), F.col("interface_id").alias("target_id"), F.lit("go:implements").alias("relation"), "source_path")
    return imported.unionByName(calls).unionByName(embeds).unionByName(implemented).distinct()


def _publish(store: Store, found: DataFrame, written: DataFrame, configs: DataFrame, owners: DataFrame | None, full: bool) -> int:
    """Resolve against the staged version and publish it; edges of other owners are carried over."""

    def resolved(view: Staged) -> dict[str, DataFrame]:
        edges, missing = workspace_edges(Facts.staged(view, configs), owners)
        edges = cut(edges)
        # both indexes get a segment: the edges of the owners that are resolved, the names of the sources that are written
        named = view.own("nodes").withColumn("span_path", F.col("source_path"))
        return {"edges": edges, "diagnostics": missing.withColumnRenamed("source_path", "owner"), "adjacency": laid_out(both_ways(edges, ["owner"])), **segment(named, search_fields())}

    return store.publish({n: table(found, n) for n in CONTRIBUTED}, written, resolved, full=full, replaced_owners=owners)


def full_index(spark: SparkSession, store: Store, workspace: str, **options) -> int:
    """Index every source of a directory tree; sources that are gone are closed."""
    sources = discover(spark, workspace, **options)
    found = cut(extract_all(sources))
    written = table(found, "nodes").filter("kind = 'file'").select("source_path", F.lit(False).alias("deleted"))
    return _publish(store, found, written, cut(read_configs(spark, workspace)), None, True)


def publish_batch(spark: SparkSession, store: Store, workspace: str, changed: list[str], **options) -> int:
    """Index the changed paths and resolve again what depends on them; returns the version, which is the
    current one if nothing relevant changed.

    Only changed files are read and extracted. Sources that depend on a surface that changed (and the files of
    a changed Go package) keep their contributions; their stored references are resolved again. The edges of all
    other sources are carried over.
    """
    m = store.manifest()
    version = m.latest()
    paths = spark.createDataFrame([(p,) for p in changed] or [], "path string").select(normalised(F.col("path")).alias("source_path")).filter("source_path is not null").distinct()
    now = discover(spark, workspace, only=paths.select(F.col("source_path").alias("path")), **options)
    found = cut(extract_all(now))
    fresh = table(found, "nodes")
    old = store.rows("nodes", version)
    present = fresh.filter("kind = 'file'").select("source_path")
    gone = old.filter("kind = 'file'").select("source_path").join(small(paths), "source_path", "left_semi").join(present, "source_path", "left_anti")
    if present.isEmpty() and gone.isEmpty():
        return version
    touched = paths.select("source_path")
    names = lambda n: n.filter("exported").select("source_path", "node_id", F.col("label").alias("name"))
    before = names(old.join(touched, "source_path", "left_semi"))
    targets = incremental.changed_targets(before, names(fresh)).union(gone).distinct()
    edges = store.workspace("edges", version).filter(F.col("relation").endswith("imports_from") | F.col("relation").endswith("re_exports"))
    deps = incremental.derive_dependencies(edges, old.select("node_id", F.col("source_path").alias("span_path")))
    again = incremental.affected(targets, deps)
    # a file that appears or goes can also change what unresolved or shadowed specifiers of others mean
    waiting = store.workspace("diagnostics", version).select(F.col("owner").alias("source_path")) if not present.join(old.select("source_path"), "source_path", "left_anti").isEmpty() else again.limit(0)
    here = resolve.dirname(F.col("source_path"))
    go_dirs = touched.filter(is_go()).select(here.alias("dir")).distinct()
    mates = old.filter(is_go()).select("source_path", here.alias("dir")).join(go_dirs, "dir", "left_semi").select("source_path")
    written = present.withColumn("deleted", F.lit(False)).unionByName(gone.withColumn("deleted", F.lit(True)))
    owners = cut(written.select("source_path").union(again).union(waiting).union(mates).distinct())
    return _publish(store, found, written, cut(read_configs(spark, workspace)), owners, False)

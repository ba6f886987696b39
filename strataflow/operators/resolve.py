"""Cross-file resolution as joins."""

from __future__ import annotations

from itertools import count

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strataflow.functions.lineage import cut
from strataflow.functions.sizes import small

#: Candidate endings of a relative specifier, in order of preference (fixed values).
TYPESCRIPT_ENDINGS = ("", ".ts", ".tsx", ".mts", ".cts", ".js", ".jsx", ".mjs", ".cjs")
JAVASCRIPT_ENDINGS = ("", ".js", ".jsx", ".mjs", ".cjs", ".ts", ".tsx", ".mts", ".cts")


def dirname(path: Column) -> Column:
    return F.regexp_replace(path, "/?[^/]*$", "")


def clean(path: Column) -> Column:
    """Resolve ``.`` and ``..`` parts: a fold over the parts with the result as a stack."""
    parts = F.filter(F.split(path, "/"), lambda p: ~p.isin("", "."))
    up = lambda acc, p: F.when(p != "..", F.concat(acc, F.array(p))).when((F.size(acc) > 0) & (F.element_at(F.concat(F.array(F.lit("..")), acc), -1) != ".."), F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0)))).otherwise(F.concat(acc, F.array(p)))
    return F.array_join(F.aggregate(parts, F.array().cast("array<string>"), up), "/")


def relative_base(references: DataFrame) -> DataFrame:
    """References with ``base``: the path that a relative specifier names, before endings are tried."""
    return references.withColumn("base", clean(F.concat_ws("/", dirname(F.col("source_path")), F.col("specifier"))))


def relative_candidates(references: DataFrame, endings: tuple[str, ...] = TYPESCRIPT_ENDINGS) -> DataFrame:
    """(source_path, specifier, position, candidate) of every file a relative specifier could mean."""
    return with_endings(relative_base(references), endings)


def with_endings(based: DataFrame, endings: tuple[str, ...] = TYPESCRIPT_ENDINGS) -> DataFrame:
    """(source_path, specifier, position, candidate): each base with every ending, and as a directory's index."""
    suffixes = [*endings, *(f"/index{e}" for e in endings[1:])]
    return based.select("source_path", "specifier", F.posexplode(F.array(*[F.concat("base", F.lit(s)) for s in suffixes])).alias("position", "candidate"))


def first_existing(candidates: DataFrame, files: DataFrame) -> DataFrame:
    """(source_path, specifier, target_path) of the first candidate that is a file."""
    hit = candidates.join(files.select(F.col("path").alias("candidate")).distinct(), "candidate")
    return hit.groupBy("source_path", "specifier").agg(F.min_by("candidate", "position").alias("target_path"))


def resolve_relative(references: DataFrame, files: DataFrame, endings: tuple[str, ...] = TYPESCRIPT_ENDINGS) -> DataFrame:
    """The first existing candidate of each reference (target_path null if there is none)."""
    hit = first_existing(relative_candidates(references, endings), files)
    return references.select("source_path", "specifier").distinct().join(hit, ["source_path", "specifier"], "left")


def ancestors(path: Column, with_self: bool = True) -> Column:
    """All directory prefixes of a path, and the path itself."""
    parts = F.split(path, "/")
    last = F.size(parts) if with_self else F.size(parts) - 1
    return F.transform(F.sequence(F.lit(1), F.greatest(last, F.lit(1))), lambda i: F.array_join(F.slice(parts, 1, i), "/"))


def longest_prefix(rows: DataFrame, path: str, roots: DataFrame) -> DataFrame:
    """Each row with its most specific root; rows under no root are dropped.

    Exploding the ancestors turns the prefix join into an equality join.
    """
    each = rows.withColumn("root", F.explode(F.array_union(ancestors(F.col(path)), F.array(F.lit("")))))
    return each.join(roots.select("root").distinct(), "root").groupBy(*rows.columns).agg(F.max_by("root", F.length("root")).alias("root"))


def alias_target(specifiers: DataFrame, patterns: DataFrame) -> DataFrame:
    """Path aliases: the longest pattern whose fixed part begins the specifier, its star substituted.

    ``patterns`` (pattern, replacement, each with at most one star) is one project's configuration.
    """
    one = specifiers.select("specifier").distinct().withColumn("dir", F.lit(""))
    return alias_in(one, patterns.withColumn("dir", F.lit(""))).select("specifier", "target")


def alias_in(rows: DataFrame, patterns: DataFrame) -> DataFrame:
    """``rows`` (dir, specifier) with ``target``, by the patterns of their own ``dir``; rows without one go.

    The beginnings of a specifier are joined with the patterns' fixed parts, so no row meets all patterns.
    """
    p = patterns.select("dir", "pattern", "replacement", F.substring_index("pattern", "*", 1).alias("head"), F.col("pattern").contains("*").alias("star"))
    heads = rows.withColumn("head", F.explode(F.transform(F.sequence(F.lit(0), F.length("specifier")), lambda i: F.substring(F.col("specifier"), F.lit(1), i))))
    hit = heads.join(p, ["dir", "head"]).filter(F.col("star") | (F.col("specifier") == F.col("pattern")))
    rest = F.substring(F.col("specifier"), F.length("head") + 1, F.length("specifier"))
    made = F.when(F.col("star"), F.concat(F.substring_index("replacement", "*", 1), rest)).otherwise(F.col("replacement"))
    return hit.withColumn("target", made).groupBy(*rows.columns).agg(F.max_by("target", F.struct(F.length("head"), ~F.col("star"), "pattern")).alias("target"))


def nearest_dir(rows: DataFrame, dirs: DataFrame) -> DataFrame:
    """``rows`` (source_path, ...) with the nearest of ``dirs`` (dir) at or above their file's directory."""
    each = rows.withColumn("dir", F.explode(F.array_union(ancestors(dirname(F.col("source_path"))), F.array(F.lit("")))))
    return each.join(dirs.select("dir").distinct(), "dir").groupBy(*rows.columns).agg(F.max_by("dir", F.length("dir")).alias("dir"))


def alias_bases(references: DataFrame, configs: DataFrame) -> DataFrame:
    """(source_path, specifier, base) by the nearest project configuration: its aliases, else its base directory."""
    rows = nearest_dir(references.select("source_path", "specifier").distinct(), configs.filter("kind = 'config'"))
    named = alias_in(rows, configs.filter("kind = 'alias'").select("dir", F.col("key").alias("pattern"), F.col("value").alias("replacement")))
    below = rows.join(configs.filter("kind = 'base'").select("dir", F.col("value").alias("top")), "dir").select("source_path", "specifier", clean(F.concat_ws("/", "top", "specifier")).alias("second"))
    both = named.select("source_path", "specifier", F.col("target").alias("first")).join(below, ["source_path", "specifier"], "full")
    return both.select("source_path", "specifier", F.coalesce("first", "second").alias("base"))


def package_bases(references: DataFrame, configs: DataFrame) -> DataFrame:
    """(source_path, specifier, base) of package specifiers: the nearest installed package going upward, else
    a package of the workspace by its name; within it the entry for the subpath, best condition first."""
    name = F.regexp_extract("specifier", "^(@[^/]+/[^/]+|[^/]+)", 1)
    asked = references.select("source_path", "specifier").distinct().withColumn("name", name).withColumn("sub", F.concat(F.lit("."), F.substring(F.col("specifier"), F.length("name") + 1, F.length("specifier"))))
    up = F.array_union(ancestors(dirname(F.col("source_path"))), F.array(F.lit("")))
    installed = asked.withColumn("above", F.explode(up)).withColumn("dir", F.concat(F.when(F.col("above") == "", "").otherwise(F.concat("above", F.lit("/"))), F.lit("node_modules/"), F.col("name"))).withColumn("near", F.length("above") + 1)
    own = asked.join(configs.filter("kind = 'named'").select(F.col("key").alias("name"), "dir"), "name").withColumn("near", F.lit(0))
    places = installed.select("source_path", "specifier", "sub", "dir", "near").unionByName(own.select("source_path", "specifier", "sub", "dir", "near"))
    entries = configs.filter("kind = 'package'").select("dir", F.col("key").alias("sub"), F.col("value").alias("base"), "position")
    listed = places.join(entries, ["dir", "sub"])
    free = places.filter("sub <> '.'").join(configs.filter("kind = 'open_package'").select("dir"), "dir", "left_semi").select("*", clean(F.concat_ws("/", "dir", "sub")).alias("base"), F.lit(99).alias("position"))
    return listed.unionByName(free).groupBy("source_path", "specifier").agg(F.min_by("base", F.struct(-F.col("near"), "position")).alias("base"))


def script_targets(references: DataFrame, files: DataFrame, configs: DataFrame, endings: tuple[str, ...] = TYPESCRIPT_ENDINGS) -> DataFrame:
    """(source_path, specifier, target_path) of script references: relative, then aliases, then packages."""
    asked = references.select("source_path", "specifier").distinct()
    relative = F.col("specifier").rlike(r"^\.{1,2}(/|$)")
    named = asked.filter(~relative)
    tries = [relative_base(asked.filter(relative)), alias_bases(named, configs), package_bases(named, configs)]
    found = None
    for k, based in enumerate(tries):
        some = with_endings(based.select("source_path", "specifier", "base"), endings).withColumn("position", F.col("position") + 100 * k)
        found = some if found is None else found.unionByName(some)
    return asked.join(first_existing(found, files), ["source_path", "specifier"], "left")


def go_packages(references: DataFrame, configs: DataFrame) -> DataFrame:
    """(source_path, specifier, target_dir) of Go imports: the longest module path that begins the import path,
    a local replacement before the module's own place."""
    each = references.select("source_path", "specifier").distinct().withColumn("module", F.explode(ancestors(F.col("specifier"))))
    hit = each.join(configs.filter("kind = 'module'").select(F.col("key").alias("module"), "value", "position"), "module")
    best = hit.groupBy("source_path", "specifier").agg(F.max_by(F.struct("module", "value"), F.struct(F.length("module"), "position", "value")).alias("m"))
    rest = F.substring(F.col("specifier"), F.length("m.module") + 1, F.length("specifier"))
    return best.select("source_path", "specifier", clean(F.concat("m.value", rest)).alias("target_dir"))


def re_export_closure(surfaces: DataFrame, re_exports: DataFrame) -> DataFrame:
    """Fixpoint of exported names through re-exports.

    ``surfaces``: path, name, node_id; ``re_exports``: path, target_path, imported, exported, where ``*``
    passes every name but ``default``. Each round joins only the newest rows (semi-naive).
    """
    found = surfaces.select("path", "name", "node_id").distinct()
    new = found
    for depth in count(1):
        moved = new.select(F.col("path").alias("target_path"), "name", "node_id").join(re_exports, "target_path")
        star = moved.filter("imported = '*' and name <> 'default'").select("path", "name", "node_id")
        named = moved.filter("imported = name").select("path", F.col("exported").alias("name"), "node_id")
        new = cut(star.union(named).distinct().join(found, ["path", "name", "node_id"], "left_anti"))
        if new.isEmpty():
            break
        found = found.union(new)
        if depth % 8 == 0:
            found = cut(found.repartition("path"))
    return found


def import_edges(resolved: DataFrame, surfaces: DataFrame) -> DataFrame:
    """File-to-file and file-to-surface edges of resolved references."""
    ok = resolved.filter("target_path is not null")
    to_file = ok.select("source_path", F.col("target_path").alias("target"), F.lit("file").alias("what"))
    to_name = ok.join(surfaces.select(F.col("path").alias("target_path"), F.col("node_id").alias("target")), "target_path").select("source_path", "target", F.lit("surface").alias("what"))
    return to_file.union(to_name).distinct()


def unresolved(resolved: DataFrame) -> DataFrame:
    return resolved.filter("target_path is null").select("source_path", "specifier", F.lit("warning").alias("severity"))


def bound_targets(symbols: DataFrame, bindings: DataFrame, surfaces: DataFrame) -> DataFrame:
    """(source_id, target_id, relation, source_path) of symbol uses through import bindings.

    ``bindings``: source_path, local, imported, target_path; a use of ``local`` means the imported name, one of
    ``local.name`` of a whole-module binding (``*``) means ``name``. ``surfaces``: path, name, node_id. Bindings are
    broadcast while they are few, so a file or a binding of very many uses is not one task.
    """
    head = F.substring_index("target", ".", 1)
    used = symbols.filter("receiver = ''").select("source_id", "relation", "source_path", head.alias("local"), F.when(F.col("target").contains("."), F.element_at(F.split("target", r"\."), 2)).alias("member"))
    meant = used.join(small(bindings), ["source_path", "local"]).withColumn("name", F.when(F.col("imported") == "*", F.col("member")).otherwise(F.col("imported")))
    return meant.join(surfaces.select(F.col("path").alias("target_path"), "name", "node_id"), ["target_path", "name"]).select("source_id", F.col("node_id").alias("target_id"), "relation", "source_path").distinct()


def unique_matches(calls: DataFrame, callables: DataFrame, on: list[str]) -> DataFrame:
    """Calls whose name matches exactly one callable: call_id, node_id (null, with the count, otherwise)."""
    per = callables.groupBy(*on).agg(F.count("*").alias("matches"), F.min("node_id").alias("node_id"))
    joined = calls.join(per, on, "left")
    return joined.select("call_id", F.when(F.col("matches") == 1, F.col("node_id")).alias("node_id"), F.coalesce("matches", F.lit(0)).alias("matches"))


def package_uses(symbols: DataFrame, imports: DataFrame, declared: DataFrame) -> DataFrame:
    """(source_id, target_id, relation, source_path) of Go symbol uses that fit exactly one declaration.

    ``symbols``: source_id, target, receiver, relation, source_path; ``imports``: source_path, alias, target_dir;
    ``declared``: dir, owner (a method's type, else empty), label, exported, node_id. A plain name means the own
    package, ``alias.Name`` an imported one and only what it exports; a receiver's type is looked up likewise.
    """
    whole = F.when(F.col("receiver") != "", F.concat_ws(".", "receiver", "target")).otherwise(F.col("target"))
    parts = F.split(whole, r"\.")
    method = F.col("receiver") != ""
    foreign = F.size(parts) > F.when(method, 2).otherwise(1)
    used = symbols.withColumns({"alias": F.when(foreign, parts[0]), "label": F.element_at(parts, -1), "owner": F.when(method, F.element_at(parts, -2)).otherwise("")})
    at = used.join(imports, ["source_path", "alias"], "left").withColumn("dir", F.when(F.col("alias").isNull(), dirname(F.col("source_path"))).otherwise(F.col("target_dir"))).filter("dir is not null")
    fits = at.join(declared, ["dir", "owner", "label"]).filter("alias is null or exported")
    per = fits.groupBy("source_id", "target", "receiver", "relation", "source_path").agg(F.countDistinct("node_id").alias("n"), F.min("node_id").alias("target_id"))
    return per.filter("n = 1").select("source_id", "target_id", "relation", "source_path").distinct()


#: Ids in a block of a class's members, about; pairs are made from two blocks at a time.
BLOCK = 1024


def name_classes(rows: DataFrame, id_column: str) -> tuple[DataFrame, DataFrame]:
    """Classes (package, class_id, names, n) of ids with one and the same set of names, and their members (package,
    class_id, id, block), dealt into blocks by a hash. A class is called after its smallest id."""
    sets = rows.groupBy("package", id_column).agg(F.sort_array(F.collect_set("name")).alias("names"))  # one type's names
    classes = sets.groupBy("package", "names").agg(F.min(id_column).alias("class_id"), F.count("*").alias("n"))
    block = F.pmod(F.xxhash64(id_column), F.ceil(F.col("n") / BLOCK)).alias("block")
    members = sets.join(classes, ["package", "names"]).select("package", "class_id", F.col(id_column).alias("id"), block)
    return classes, members


def containment(have: DataFrame, need: DataFrame) -> DataFrame:
    """(package, have_id, need_id) of classes whose names hold all those of a class of needs.

    Prefix filtering: whatever holds all names of a set holds its rarest one, so a need meets only the classes that
    have its rarest name, and whole sets are compared there.
    """
    each = have.select("package", F.col("class_id").alias("have_id"), F.col("names").alias("has"), F.explode("names").alias("name"))
    often = each.groupBy("package", "name").agg(F.count("*").alias("n"))
    wanted = need.select("package", F.col("class_id").alias("need_id"), "names", F.explode("names").alias("name")).join(often, ["package", "name"], "left")
    rarest = wanted.groupBy("package", "need_id").agg(F.min(F.struct(F.coalesce("n", F.lit(0)), "name"))["name"].alias("name"), F.first("names").alias("names"))
    met = rarest.join(each, ["package", "name"])
    return met.filter(F.size(F.array_except("names", "has")) == 0).select("package", "have_id", "need_id")


def implement_classes(methods: DataFrame, required: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Relational division by classes: pairs (package, have_id, need_id) of classes of types and of interfaces, and the
    members of both (package, class_id, id, block).

    ``methods``: package, type_id, name; ``required``: package, interface_id, name (non-empty sets).
    """
    types, of_types = name_classes(methods, "type_id")
    interfaces, of_interfaces = name_classes(required, "interface_id")
    return containment(types, interfaces), of_types, of_interfaces


def implement_pairs(pairs: DataFrame, types: DataFrame, interfaces: DataFrame) -> DataFrame:
    """(type_id, interface_id) of all members of the pairs of classes that ``implement_classes`` gives.

    Pairs of blocks are shuffled, not pairs of ids: a row of two blocks stands for the product of their sizes, which the
    task that gets it writes out. So a class of any size is spread over all tasks, and none holds more than two blocks.
    """
    tasks = int(pairs.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # a fixed number: rows grow after the exchange
    held = lambda members, side: members.groupBy("package", F.col("class_id").alias(f"{side}_id"), F.col("block").alias(f"{side}_block")).agg(F.collect_list("id").alias(side))
    met = pairs.join(held(types, "have"), ["package", "have_id"]).join(held(interfaces, "need"), ["package", "need_id"])
    dealt = met.repartition(tasks, "package", "have_id", "have_block", "need_id", "need_block")
    # coalesce (to as many) keeps the two loops apart: in one generated function all rows of two blocks are made before the first leaves
    return dealt.select(F.explode("have").alias("type_id"), "need").coalesce(tasks).select("type_id", F.explode("need").alias("interface_id"))


def implements(methods: DataFrame, required: DataFrame) -> DataFrame:
    """(type_id, interface_id) of types of a package that have every method an interface requires."""
    pairs, types, interfaces = implement_classes(methods, required)
    met = pairs.join(types.select("package", F.col("class_id").alias("have_id"), F.col("id").alias("type_id")), ["package", "have_id"])
    return met.join(interfaces.select("package", F.col("class_id").alias("need_id"), F.col("id").alias("interface_id")), ["package", "need_id"]).select("type_id", "interface_id")


def package_edges(imports: DataFrame, members: DataFrame) -> DataFrame:
    """(source_id, target_id) from each importing file to every member of the imported package.

    ``imports``: source_id, target_dir; ``members``: dir, node_id.
    """
    return imports.join(members.select(F.col("dir").alias("target_dir"), F.col("node_id").alias("target_id")), "target_dir").filter("source_id <> target_id").select("source_id", "target_id").distinct()

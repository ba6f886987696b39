"""An append-only store of graph versions on Parquet parts and numbered manifests.

``root/parts/<attempt>/<table>/`` holds what one publish attempt wrote, every row with the version that
wrote it (``written``); ``root/manifests/<n>.json`` lists the versions and their parts. The manifest with the
highest number counts. A commit creates the next one if nobody else has: that is one atomic step, nothing is
deleted or replaced, so a crash leaves the previous manifest in force and of two publishers one gets a
conflict. Validity intervals are never stored: a source's rows end where its next write (or tombstone)
begins, so rollback and prune only write a manifest. When as many versions have been forgotten as are kept,
what is still visible of them is compacted into one base part; ``vacuum`` deletes what no manifest in force
names, after a grace period for readers that hold an older one.

Tables are read as a base and the segments after it. A *whole* table (of a first version, a full index, or a
merge) hides everything before it; later parts hold only what they replaced, and the log of what that was
(``_sources`` by source, ``_owners`` by owner of workspace rows) masks older rows. The masks are as small as the
changes since the base, so rows are filtered where they are scanned and are not shuffled. ``merge`` writes what a
version shows of a workspace table as a new base when many segments have come together.
"""

from __future__ import annotations

import json
import os
import time
import uuid
from collections.abc import Callable
from contextlib import suppress
from dataclasses import asdict, dataclass, field
from datetime import datetime, timezone
from urllib.parse import unquote, urlparse

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strataflow.functions.sizes import small
from strataflow.schema import RETAINED_VERSIONS, SCHEMA_VERSION

#: Most rows of logs whose mask is a plain filter, and most of those whose mask is broadcast.
FEW_MASKED, MASK_ROWS = 1_000, 200_000
SOURCES = "source_path string, deleted boolean, written long"


class StoreError(ValueError):
    """``workspace not found``, ``version not found``, ``pruned``, ``conflict``, ``budget``, ``state``."""


@dataclass
class Manifest:
    """``versions``: version, published_at, counts, part of each kept version, oldest first, and the part ``merged``
    that shows its workspace tables whole, if there is one. ``older``: parts that hold rows of forgotten versions,
    oldest first. A part is its folder, tables (name to schema), bytes, and the names of its ``whole`` tables."""

    schema: int = SCHEMA_VERSION
    number: int = 0
    versions: list[dict] = field(default_factory=list)
    older: list[dict] = field(default_factory=list)
    next_version: int = 1
    pruned_below: int = 1

    def latest(self) -> int:
        if not self.versions:
            raise StoreError("workspace not found")
        return self.versions[-1]["version"]

    def check(self, version: int) -> int:
        if any(v["version"] == version for v in self.versions):
            return version
        raise StoreError("pruned" if 0 < version < self.pruned_below else "version not found")

    def parts(self, version: int | None = None) -> list[dict]:
        """All parts, or those up to a version, oldest first."""
        kept = [v for v in self.versions if version is None or v["version"] <= version]
        return [*self.older, *(p for v in kept for p in entry_parts(v))]


def entry_parts(entry: dict) -> list[dict]:
    """The parts of a version: what it wrote, and what was merged for it."""
    return [entry["part"], *([entry["merged"]] if "merged" in entry else [])]


def since_whole(parts: list[dict], name: str) -> list[dict]:
    """The parts from the last one on that has table ``name`` whole; all if none has."""
    at = max((i for i, p in enumerate(parts) if name in p.get("whole", ())), default=0)
    return parts[at:]


class Store:
    """Contribution tables (each with ``source_path``) and workspace tables of one workspace."""

    def __init__(self, spark: SparkSession, root: str, retained: int = RETAINED_VERSIONS, byte_budget: int | None = None, merge_after: int = 12):
        self.spark, self.root, self.retained, self.byte_budget, self.merge_after = spark, root.rstrip("/"), retained, byte_budget, merge_after
        self._masks: dict[tuple, list] = {}

    # file access goes through Spark's file system layer, so any store that Spark reads will do
    def _fs(self, path: str):
        at = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        return at.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), at

    def _list(self, folder: str) -> list:
        files, at = self._fs(f"{self.root}/{folder}")
        return list(files.listStatus(at)) if files.exists(at) else []

    def text(self, name: str) -> str:
        """The content of a small file."""
        files, at = self._fs(f"{self.root}/{name}")
        stream = files.open(at)
        try:
            return self.spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def _numbers(self) -> list[int]:
        names = [s.getPath().getName() for s in self._list("manifests")]
        return sorted(int(n[:-5]) for n in names if n.endswith(".json") and n[:-5].isdigit())

    def manifest(self, number: int | None = None) -> Manifest:
        """The manifest in force, or an earlier one by its number."""
        numbers = self._numbers()
        if not numbers:
            return Manifest()
        m = Manifest(**json.loads(self.text(f"manifests/{numbers[-1] if number is None else number:012d}.json")))
        if m.schema != SCHEMA_VERSION:
            raise StoreError(f"schema version {m.schema} is not {SCHEMA_VERSION}")
        return m

    def _commit(self, before: Manifest, after: Manifest) -> Manifest:
        """Create the manifest that follows ``before``, if nobody else has."""
        after.number = before.number + 1
        self.create(f"manifests/{after.number:012d}.json", json.dumps(asdict(after)).encode())
        return after

    def create(self, name: str, content: bytes) -> None:
        """Create a file with its whole content unless it exists; of several writers one succeeds, the others get a
        conflict.

        On ``file:`` a hard link gives a written file its name. ``hdfs:`` and ``viewfs:`` rename and refuse an existing
        target in one step. Other schemes promise neither, so they are refused.
        """
        files, at = self._fs(f"{self.root}/{name}")
        folder, _, last = name.rpartition("/")
        _, temp = self._fs(f"{self.root}/{folder}/.{last}.{uuid.uuid4().hex}.tmp")
        scheme = urlparse(files.makeQualified(at).toString()).scheme
        if scheme not in ("file", "hdfs", "viewfs"):
            raise StoreError(f"{scheme}: can't create a file only if it is absent")
        out = files.create(temp, True)
        out.write(bytearray(content))
        out.close()
        self._create(files, temp, at)

    def _create(self, files, temp, at) -> None:
        """Give a written file its name unless that name exists; one atomic step."""
        qualified = [urlparse(files.makeQualified(p).toString()) for p in (temp, at)]
        if qualified[0].scheme == "file":
            source, target = (unquote(q.path) for q in qualified)
            try:
                os.link(source, target)
            except FileExistsError:
                raise StoreError("conflict") from None
            finally:
                self._discard(files, temp)
        elif not files.rename(temp, at):  # refuses an existing target
            self._discard(files, temp)
            raise StoreError("conflict")

    @staticmethod
    def _discard(files, temp) -> None:
        """Delete a temporary file; one that stays behind harms nobody and is not an error."""
        with suppress(Exception):
            files.delete(temp, False)

    def _write(self, part: dict, name: str, df: DataFrame) -> None:
        at = f"{self.root}/parts/{part['folder']}/{name}"
        # tables that are read by few of their keys get small row groups
        writer = df.write.option("parquet.block.size", 256 << 10) if name in self.ORDERS else df.write
        writer.parquet(at)
        files, path = self._fs(at)
        part["tables"][name] = df.schema.json()
        part["bytes"] += files.getContentSummary(path).getLength()

    def _log(self, part: dict, name: str, df: DataFrame) -> None:
        """Write what the part replaces, and remember how much that is: masks are broadcast by these counts."""
        self._write(part, name, df)
        part.setdefault("rows", {})[name] = self._scan([part], name).count()

    def publish(self, tables: dict[str, DataFrame], rewritten: DataFrame, workspace: dict[str, DataFrame] | Callable | None = None, full: bool = False, replaced_owners: DataFrame | None = None, on_progress=None) -> int:
        """Write one version. ``rewritten`` (source_path, deleted) lists the sources it replaces; a full
        index also closes every known source that is not among them. With ``replaced_owners``, the rows of
        workspace tables replace those of these owners only (of the rewritten sources, in tables with a
        ``source_path``); the others' rows stay where they are. ``workspace`` may be a
        function that gets a ``Staged`` view of the new version, before it is committed, and returns the workspace
        tables."""
        before = self.manifest()
        v = before.next_version
        if rewritten.groupBy("source_path").count().filter("count > 1").limit(1).count():
            raise StoreError("a source is contributed twice")
        if full and before.versions:
            known = self.intervals(before).filter("valid_to is null and not deleted").select("source_path")
            gone = known.join(rewritten.select("source_path"), "source_path", "left_anti").withColumn("deleted", F.lit(True))
            rewritten = rewritten.select("source_path", "deleted").unionByName(gone)
        part = {"folder": f"{v:06d}-{uuid.uuid4().hex[:12]}", "tables": {}, "bytes": 0, "whole": []}
        try:
            version = F.lit(v).cast("long").alias("written")
            self._log(part, "_sources", rewritten.select("source_path", "deleted", version))
            counts = {}
            for name, df in tables.items():
                self._write(part, name, df.select("*", version))
                counts[name] = self._scan([part], name).count()
                if on_progress:
                    on_progress(name, counts[name])
            if full or not before.versions:
                part["whole"] += list(tables)
            if callable(workspace):
                workspace = workspace(Staged(self, before, part))
            segments = replaced_owners is not None and bool(before.versions)
            if segments:
                self._log(part, "_owners", replaced_owners.select(F.col("source_path").alias("owner"), version).distinct())
            for name, df in (workspace or {}).items():
                self._write(part, f"ws_{name}", df.select("*", version))
                if not segments or not {"owner", "source_path"} & set(df.columns):
                    part["whole"].append(f"ws_{name}")
            entry = {"version": v, "published_at": datetime.now(timezone.utc).isoformat(), "counts": counts, "part": part}
            after = self._retain(Manifest(versions=[*before.versions, entry], older=before.older, next_version=v + 1, pruned_below=before.pruned_below))
            if self.byte_budget is not None and sum(p["bytes"] for p in after.parts()) > self.byte_budget:
                raise StoreError("budget")
            self._commit(before, after)
        except BaseException:
            self._abandon(part)
            raise
        if segments:
            with suppress(StoreError):  # somebody else has committed: their next publish merges
                self.merge()
        return v

    def _abandon(self, part: dict) -> None:
        """Delete the part of a failed attempt, unless a manifest names it: an interrupt may come after the commit."""
        if part["folder"] in {p["folder"] for p in self.manifest().parts()}:
            return
        files, at = self._fs(f"{self.root}/parts/{part['folder']}")
        files.delete(at, True)

    def merge(self, least: int | None = None) -> list[str]:
        """Write the workspace tables that consist of more than ``least`` (``merge_after``) parts as one, in place of their
        segments, for the last version and those after it; returns their names. Readers of older manifests keep theirs."""
        m, least = self.manifest(), self.merge_after if least is None else least
        parts, last = m.parts(), m.versions[-1]
        names = sorted({n for p in parts for n in p["tables"] if n.startswith("ws_")})
        due = [n for n in names if sum(n in p["tables"] for p in since_whole(parts, n)) > least]
        if not due:
            return []
        merged = {"folder": f"merged-{uuid.uuid4().hex[:12]}", "tables": {}, "bytes": 0, "whole": [*due]}
        try:
            for n in due:
                self._write(merged, n, self.sorted_like(n, self._live(parts, n)))
            if "merged" in last:  # its other tables stay
                for n in last["merged"]["tables"]:
                    if n not in due:
                        self._write(merged, n, self._scan([last["merged"]], n))
                        merged["whole"].append(n)
            entry = last | {"merged": merged}
            self._commit(m, Manifest(versions=[*m.versions[:-1], entry], older=m.older, next_version=m.next_version, pruned_below=m.pruned_below))
        except BaseException:
            self._abandon(merged)
            raise
        return [n[3:] for n in due]

    #: The order in which a workspace table's rows are stored, so that readers of few keys skip the rest.
    ORDERS = {"ws_adjacency": ("from_id", "direction"), "ws_lexical_postings": ("token", "node_id")}

    def sorted_like(self, name: str, rows: DataFrame) -> DataFrame:
        order = self.ORDERS.get(name)
        return rows.repartitionByRange(*order).sortWithinPartitions(*order) if order else rows

    def _retain(self, m: Manifest) -> Manifest:
        """``m`` with its newest versions only; forgotten ones become older parts, and one base part in time."""
        over = m.versions[: max(0, len(m.versions) - self.retained)]
        if over:
            m.versions, m.older = m.versions[len(over) :], [*m.older, *(p for v in over for p in entry_parts(v))]
            m.pruned_below = m.versions[0]["version"]
        return self._compacted(m) if len(m.older) > self.retained else m

    def _compacted(self, m: Manifest) -> Manifest:
        """``m`` with one base part in place of its older ones: their rows that a kept version still shows."""
        base = {"folder": f"base-{uuid.uuid4().hex[:12]}", "tables": {}, "bytes": 0, "whole": []}
        live = self.intervals(m).select("source_path", "written")
        for name in sorted({n for p in m.older for n in p["tables"]}):
            if name.startswith("ws_"):
                self._write(base, name, self.sorted_like(name, self._live(m.older, name)))
            elif name == "_owners":
                continue  # the base holds only what is left
            else:
                self._write(base, name, self._scan(m.older, name).join(live, ["source_path", "written"], "left_semi"))
            base["whole"] += [name] if name.startswith("ws_") else []
        return Manifest(versions=m.versions, older=[base], next_version=m.next_version, pruned_below=m.pruned_below)

    def compact(self) -> None:
        """Bring what is still visible of forgotten versions into one base part now."""
        before = self.manifest()
        if len(before.older) > 1:
            self._commit(before, self._compacted(before))

    def vacuum(self, grace_seconds: float = 3600.0) -> int:
        """Delete parts and manifests that have not been in force for at least the grace period; returns
        how many parts went."""
        m, oldest, n = self.manifest(), (time.time() - grace_seconds) * 1000, 0
        needed = {p["folder"] for p in m.parts()}
        self._masks.clear()
        for status in [*self._list("parts"), *self._list("manifests")]:
            name = status.getPath().getName()
            is_part = status.isDirectory()
            if status.getModificationTime() > oldest or name in needed or name == f"{m.number:012d}.json":
                continue
            files, at = self._fs(status.getPath().toString())
            files.delete(at, True)
            n += is_part
        return n

    def _scan(self, parts: list[dict], name: str) -> DataFrame | None:
        """One scan of a table over all parts that have it."""
        having = [p for p in parts if name in p["tables"]]
        if not having:
            return None
        schema = T.StructType.fromJson(json.loads(having[-1]["tables"][name]))
        return self.spark.read.schema(schema).parquet(*[f"{self.root}/parts/{p['folder']}/{name}" for p in having])

    def _writes(self, m: Manifest) -> DataFrame:
        found = self._scan(m.parts(), "_sources")
        return found if found is not None else self.spark.createDataFrame([], SOURCES)

    def intervals(self, m: Manifest | None = None) -> DataFrame:
        """(source_path, valid_from, valid_to, deleted, written), rebased to the oldest kept version."""
        m = m or self.manifest()
        following = F.lead("written").over(Window.partitionBy("source_path").orderBy("written"))
        spans = self._writes(m).withColumn("valid_to", following - 1).filter(F.col("valid_to").isNull() | (F.col("valid_to") >= m.pruned_below))
        return spans.withColumn("valid_from", F.greatest("written", F.lit(m.pruned_below).cast("long")))

    def contributions(self, name: str, version: int | None = None) -> DataFrame:
        """A contribution table with its validity interval; at one version if asked."""
        return self._contributions(self.manifest(), name, version)

    def _contributions(self, m: Manifest, name: str, version: int | None = None) -> DataFrame:
        spans = self.intervals(m).filter("not deleted").select("source_path", "written", "valid_from", "valid_to")
        if version is not None:
            m.check(version)
            spans = spans.filter((F.col("valid_from") <= version) & (F.col("valid_to").isNull() | (F.col("valid_to") >= version)))
        rows = self._scan(m.parts(version), name)
        if rows is None:
            raise StoreError(f"no table {name}")
        return rows.join(small(spans), ["source_path", "written"]).drop("written")

    def rows(self, name: str, version: int | None = None) -> DataFrame:
        """A contribution table as one version shows it, without validity intervals: scanned from its base and
        segments, and not shuffled."""
        m = self.manifest()
        return self._rows(m, name, m.latest() if version is None else m.check(version))

    def _rows(self, m: Manifest, name: str, version: int) -> DataFrame:
        if not any(name in p["tables"] for p in m.parts(version)):
            raise StoreError(f"no table {name}")
        return self._live(m.parts(version), name).drop("written")

    def _live(self, parts: list[dict], name: str) -> DataFrame:
        """The rows of the table's base and segments, with ``written``, that no later part has replaced: by source, or
        by owner in workspace tables that have no source."""
        parts = since_whole(parts, name)
        rows = self._scan(parts, name)
        key, log = ("source_path", "_sources") if "source_path" in rows.columns else ("owner", "_owners")
        later = self._scan(parts[1:], log) if len(parts) > 1 and key in rows.columns else None
        if later is None:
            return rows
        latest = later.groupBy(key).agg(F.max("written").alias("_latest"))
        logged = sum(p.get("rows", {}).get(log, MASK_ROWS) for p in parts[1:] if log in p["tables"])
        if logged <= FEW_MASKED:
            at = (log, *(p["folder"] for p in parts[1:]))  # parts never change
            if at not in self._masks:
                self._masks[at] = [tuple(r) for r in latest.select(key, "_latest").collect()]
            dead = F.lit(False)
            for version in sorted({v for _, v in self._masks[at]}):
                dead = dead | (F.col(key).isin([k for k, v in self._masks[at] if v == version and k is not None]) & (F.col("written") < version))
            return rows.filter(~F.coalesce(dead, F.lit(False)))
        latest = F.broadcast(latest) if logged <= MASK_ROWS else latest
        return rows.join(latest, key, "left").filter(F.col("_latest").isNull() | (F.col("written") >= F.col("_latest"))).select(*rows.columns)

    def workspace(self, name: str, version: int) -> DataFrame:
        return self._workspace(self.manifest(), name, version)

    def _workspace(self, m: Manifest, name: str, version: int) -> DataFrame:
        m.check(version)
        if not any(f"ws_{name}" in p["tables"] for p in m.parts(version)):
            raise StoreError(f"no table {name}")
        return self._live(m.parts(version), f"ws_{name}").drop("written")

    def rollback(self, version: int) -> None:
        """Forget every newer version; what they closed is open again."""
        before = self.manifest()
        before.check(version)
        kept = [v for v in before.versions if v["version"] <= version]
        self._commit(before, Manifest(versions=kept, older=before.older, next_version=before.next_version, pruned_below=before.pruned_below))

    def prune(self, version: int) -> int:
        """Forget versions before ``version``; returns how many."""
        before = self.manifest()
        before.check(version)
        gone = [v for v in before.versions if v["version"] < version]
        kept = [v for v in before.versions if v["version"] >= version]
        older = [*before.older, *(p for v in gone for p in entry_parts(v))]
        self._commit(before, Manifest(versions=kept, older=older, next_version=before.next_version, pruned_below=max(version, before.pruned_below)))
        return len(gone)


class Staged:
    """What a version that is being published will show: its own part over what its sources leave of the last."""

    def __init__(self, store: Store, before: Manifest, part: dict):
        self.store, self.before, self.part = store, before, part

    def sources(self) -> DataFrame:
        """(source_path, deleted) of the version's own sources."""
        return self.store._scan([self.part], "_sources").select("source_path", "deleted")

    def own(self, name: str) -> DataFrame:
        """The version's own rows of a contribution table."""
        now = self.store._scan([self.part], name)
        if now is None:
            raise StoreError(f"no table {name}")
        return now.drop("written")

    def contributions(self, name: str) -> DataFrame:
        now = self.store._scan([self.part], name)
        now = now.drop("written") if now is not None else None
        if not self.before.versions or not any(name in p["tables"] for p in self.before.parts()):
            if now is None:
                raise StoreError(f"no table {name}")
            return now
        own = self.sources().select("source_path")
        own = F.broadcast(own) if self.part["rows"]["_sources"] <= MASK_ROWS else own
        kept = self.store._rows(self.before, name, self.before.latest()).join(own, "source_path", "left_anti")
        return kept if now is None else kept.unionByName(now)


class Session:
    """Stage sources, seal, add workspace facts, seal, commit; any other order is refused."""

    def __init__(self, store: Store):
        self.store, self.state = store, "contributions"
        self.tables: dict[str, DataFrame] = {}
        self.workspace: dict[str, DataFrame] = {}
        self.sources: DataFrame | None = None

    def _need(self, state: str) -> None:
        if self.state != state:
            raise StoreError(f"state: {self.state}, needed {state}")

    def stage(self, sources: DataFrame, **tables: DataFrame) -> None:
        self._need("contributions")
        self.sources = sources if self.sources is None else self.sources.unionByName(sources)
        for name, df in tables.items():
            self.tables[name] = df if name not in self.tables else self.tables[name].unionByName(df)

    def seal_contributions(self) -> None:
        self._need("contributions")
        self.state = "workspace"

    def add_workspace(self, **tables: DataFrame) -> None:
        self._need("workspace")
        for name, df in tables.items():
            self.workspace[name] = df if name not in self.workspace else self.workspace[name].unionByName(df)

    def seal_workspace(self) -> None:
        self._need("workspace")
        self.state = "sealed"

    def commit(self, full: bool = True) -> int:
        self._need("sealed")
        if self.sources is None:
            raise StoreError("state: nothing staged")
        version = self.store.publish(self.tables, self.sources, self.workspace, full=full)
        self.state = "committed"
        return version

    def rollback(self) -> None:
        if self.state == "committed":
            raise StoreError("state: committed")
        self.state, self.tables, self.workspace, self.sources = "rolled back", {}, {}, None

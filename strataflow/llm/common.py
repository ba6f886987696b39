"""Shared-folder tables, size-checked joins and text helpers used by the operators."""

from __future__ import annotations

import atexit
import tempfile
import uuid
from contextlib import contextmanager
from typing import ClassVar

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Most rows, and most bytes of their values, that a side may have to be broadcast; beyond it, joins shuffle.
BROADCAST_IDS = 1_000_000
BROADCAST_BYTES = 32 << 20

_own: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    A temporary folder is used only where the setting is unset and the master is a single local
    process; on a cluster an unset folder is an error. The path comes back with its scheme, so that
    what Python writes and what Spark writes go to one file system.
    """
    path = spark.conf.get("spark.checkpoint.dir", None)
    if path:
        at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path.rstrip("/"))
        return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).makeQualified(at).toString()
    app = spark.sparkContext.applicationId
    if app not in _own:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        _own[app] = "file://" + tempfile.mkdtemp(prefix="strataflow-")
        spark.sparkContext.setCheckpointDir(_own[app])
    return _own[app]


def remove(spark: SparkSession, path: str) -> None:
    """Delete a path of the shared folder through Spark's own file system layer."""
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


class Scratch:
    """Tables written to the shared folder in place of long lineage.

    ``keep`` writes a DataFrame as Parquet and returns a scan of it, so a lost executor costs one
    re-read instead of a recomputation. ``drop`` deletes a table once nothing reads it; the rest
    goes with ``ended_scratch``, or when the process ends.
    """

    open: ClassVar[list[Scratch]] = []

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.root = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex[:12]}"
        self.n = 0
        Scratch.open.append(self)

    def path(self, name: str) -> str:
        self.n += 1
        return f"{self.root}/{self.n}-{name}"

    def keep(self, df: DataFrame, name: str, compression: str = "zstd") -> DataFrame:
        at = self.path(name)
        df.write.option("compression", compression).parquet(at)
        out = self.spark.read.schema(df.schema).parquet(at)
        out._scratch = at
        return out

    def drop(self, *tables: DataFrame) -> None:
        for t in tables:
            remove(self.spark, t._scratch)

    def close(self) -> None:
        try:
            remove(self.spark, self.root)
        except Exception:  # noqa: BLE001  the session has ended; its folder is the cluster's to clear
            pass
        Scratch.open.remove(self)


@atexit.register
def _close_all() -> None:
    for s in list(Scratch.open):
        s.close()


_shipped: list = []


def ship(spark: SparkSession, value):
    """A broadcast of a bounded value, which ``ended_scratch`` takes back from driver and executors."""
    _shipped.append(spark.sparkContext.broadcast(value))
    return _shipped[-1]


@contextmanager
def ended_scratch():
    """Delete at the end all scratch tables and shipped values that were begun inside: for results that are written by
    then."""
    before, sent = set(map(id, Scratch.open)), len(_shipped)
    yield
    for s in [s for s in Scratch.open if id(s) not in before]:
        s.close()
    for b in _shipped[sent:]:
        b.destroy()
    del _shipped[sent:]


WIDTH = {"boolean": 1, "tinyint": 1, "smallint": 2, "int": 4, "date": 4, "float": 4, "bigint": 8, "double": 8, "timestamp": 8}


def checked(side: DataFrame, n: int | None = None, limit: int = BROADCAST_IDS, most_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """``side`` with a broadcast hint if its rows (``n``, if counted already) and the bytes of their values
    are measured to be within the limits, else as it is."""
    types = dict(side.dtypes)
    fixed = sum(WIDTH.get(t, 0) for t in types.values())
    other = [c for c, t in types.items() if t not in WIDTH]
    if other:
        size = sum((F.coalesce(F.octet_length(c) if types[c] in ("string", "binary") else F.octet_length(F.to_json(F.struct(c))), F.lit(0)) for c in other), F.lit(0))
        n, more = side.agg(F.count("*"), F.coalesce(F.sum(size.cast("long")), F.lit(0))).first()
    else:
        n, more = side.count() if n is None else n, 0
    return F.broadcast(side) if n <= limit and n * fixed + more <= most_bytes else side


def held_out(doc_id):
    """True for rows that training never sees: crc32 of the id as text, modulo 5, is 0."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 5 == 0


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")

"""The catalog job: units of a version, their synopses and embeddings, in checkpointed batches."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strataflow.functions.lineage import cut
from strataflow.operators import catalog
from strataflow.operators.incremental import latest_wins

#: Kinds that the catalog describes, by their last part (fixed values).
UNIT_KINDS = ("function", "type", "struct", "class", "interface", "method")
ENTRIES = "node_id string, name string, fingerprint string, synopsis string, written string, seq long"
VECTORS = "node_id string, origin string, text string, vector array<float>, seq long"
TASKS = "task string, version long, state string, phase string, done long, total long, seq long"


def units(nodes: DataFrame) -> DataFrame:
    """Catalog units (node_id, name, kind, owner, signature, comments, tokens) of extracted nodes."""
    kind = F.element_at(F.split("kind", ":"), -1)
    return nodes.filter(kind.isin(*UNIT_KINDS)).select("node_id", F.col("label").alias("name"), "kind", F.coalesce("owner", F.lit("")).alias("owner"), catalog.signature(F.coalesce("signature", F.lit(""))).alias("signature"), F.coalesce("comments", F.array().cast("array<string>")).alias("comments"), catalog.unit_tokens(F.col("label")).alias("tokens"))


@dataclass
class Providers:
    """Outside models, each from a pandas Series of texts: to synopses, and to lists of floats. ``workers`` is
    how many tasks may call them at once."""

    synopsis: Callable[[pd.Series], pd.Series] | None = None
    embed: Callable[[pd.Series], pd.Series] | None = None
    workers: int = 4


class CatalogStore:
    """Append logs of entries, vectors and task states below a root; the last row of a key counts."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def _log(self, name: str, schema: str) -> DataFrame:
        at = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")
        if not at.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(at):
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(f"{self.root}/{name}")

    def append(self, name: str, rows: DataFrame) -> None:
        rows.write.mode("append").parquet(f"{self.root}/{name}")

    def entries(self) -> DataFrame:
        return latest_wins(self._log("entries", ENTRIES), ["node_id"], ["seq"])

    def vectors(self) -> DataFrame:
        return latest_wins(self._log("vectors", VECTORS), ["node_id", "origin"], ["seq"])

    def task(self, task: str) -> dict | None:
        """The last state of a task; one of an older version never replaces a newer one's."""
        rows = self._log("tasks", TASKS).filter(F.col("task") == task).orderBy(F.desc("version"), F.desc("seq")).limit(1).collect()
        return rows[0].asDict() if rows else None

    def say(self, task: str, version: int, state: str, phase: str, done: int, total: int) -> None:
        seq = (self._log("tasks", TASKS).agg(F.max("seq")).first()[0] or 0) + 1
        self.append("tasks", self.spark.createDataFrame([(task, version, state, phase, done, total, seq)], TASKS))

    def stop(self, task: str) -> None:
        """Ask a running task to end after its present batch."""
        if now := self.task(task):
            self.say(task, now["version"], "stopping", now["phase"], now["done"], now["total"])


def run(store: CatalogStore, nodes: DataFrame, version: int, providers: Providers = Providers(), batches: int = 8, task: str = "catalog") -> str:
    """Write what is missing or changed, batch by batch, synopses before embeddings; returns the final state.

    Every batch is committed by itself and what is there already is not computed again, so a run that was
    stopped or lost goes on where it was. Batches are cut by a hash of the unit, so each is a parallel job.
    """
    every = cut(units(nodes).withColumn("synopsis", catalog.synopsis(F.col("name"), F.col("owner"), F.col("kind"), F.col("comments"), F.col("signature"), F.col("tokens"))).withColumn("fingerprint", catalog.fingerprint(["name", "kind", "owner", "signature", "comments", "tokens"])))
    total = every.count()
    store.say(task, version, "running", "synopses", 0, total)
    phases = [("synopses", _write_synopses)] + ([("embeddings", _write_vectors)] if providers.embed else [])
    for phase, work in phases:
        done = 0
        for b in range(batches):
            if store.task(task)["state"] == "stopping":
                store.say(task, version, "stopped", phase, done, total)
                return "stopped"
            some = every.filter(F.pmod(F.xxhash64("node_id"), F.lit(batches)) == b)
            try:
                work(store, some, version * 1000 + b, providers)
            except Exception as e:
                store.say(task, version, f"failed: {type(e).__name__}", phase, done, total)
                raise
            done += some.count()
            if store.task(task)["state"] != "stopping":
                store.say(task, version, "running", phase, done, total)
    store.say(task, version, "done", phases[-1][0], total, total)
    return "done"


def _write_synopses(store: CatalogStore, some: DataFrame, seq: int, providers: Providers) -> None:
    kept = cut(catalog.reuse(some, store.entries()))
    fresh = kept.filter(~F.col("reused")).select("node_id", "name", "fingerprint", "synopsis")
    if providers.synopsis:
        fresh = fresh.repartition(providers.workers).withColumn("written", F.pandas_udf(providers.synopsis, "string")(F.col("synopsis")))
    else:
        fresh = fresh.withColumn("written", F.lit("").cast("string"))
    store.append("entries", fresh.withColumn("seq", F.lit(seq).cast("long")))


def _write_vectors(store: CatalogStore, some: DataFrame, seq: int, providers: Providers) -> None:
    mine = store.entries().join(some.select("node_id"), "node_id", "left_semi")
    texts = mine.select("node_id", F.lit("deterministic").alias("origin"), F.col("synopsis").alias("text")).unionByName(mine.filter("written <> ''").select("node_id", F.lit("provider").alias("origin"), F.col("written").alias("text")))
    missing = catalog.missing_embeddings(texts, store.vectors(), ["node_id", "origin", "text"]).repartition(providers.workers)
    made = catalog.embed(missing, "text", providers.embed).filter(F.size("vector").between(1, 8192))
    store.append("vectors", made.withColumn("seq", F.lit(seq).cast("long")).select("node_id", "origin", "text", "vector", "seq"))

"""The change feed: coalesced micro-batches of changed paths, published one at a time."""

from __future__ import annotations

import json
import time
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from strataflow.operators.resolve import clean
from strataflow.sources.store import Store, StoreError

THROTTLE = "250 milliseconds"
FIRST_BACKOFF, MOST_BACKOFF = 1.0, 60.0


def normalised(path: Column) -> Column:
    """Slash-separated, dots resolved; null for paths that leave the root."""
    p = clean(F.regexp_replace(path, r"\\", "/"))
    return F.when((p != "") & ~p.startswith("..") & ~path.startswith("/"), p)


def coalesce_paths(events: DataFrame, order: str = "ts") -> DataFrame:
    """Each valid path once, with its first arrival, in arrival order."""
    first = events.select(normalised(F.col("path")).alias("path"), order).filter("path is not null").groupBy("path").agg(F.min(order).alias(order))
    return first.orderBy(order, "path")


class Publisher:
    """Calls ``publish`` with one list of changed paths after another.

    A list holds at most ``most`` paths, so a backlog goes to the driver in parts. Failed paths come first in
    the next attempt; waiting doubles from one second to a minute and begins anew after a success. Attempts
    don't end unless ``attempts`` says so; the checkpoint replays a batch that a stopped query did not finish.
    """

    def __init__(self, publish: Callable[[list[str]], None], sleep: Callable[[float], None] = time.sleep, attempts: int | None = None, most: int = 10_000):
        self.publish, self.sleep, self.attempts, self.most = publish, sleep, attempts, most
        self.pending: dict[str, None] = {}  # in order of arrival
        self.last_change = time.monotonic()

    def __call__(self, batch: DataFrame, batch_id: int) -> None:
        for row in coalesce_paths(batch).toLocalIterator():
            self.last_change = time.monotonic()
            self.pending.setdefault(row["path"])
            if len(self.pending) >= self.most:
                self.flush()
        self.flush()

    def flush(self) -> None:
        wait, tried = FIRST_BACKOFF, 0
        while self.pending:
            try:
                self.publish(list(self.pending))
                self.pending = {}
            except Exception:
                tried += 1
                if self.attempts is not None and tried >= self.attempts:
                    raise
                self.sleep(wait)
                wait = min(MOST_BACKOFF, 2 * wait)


class Ownership:
    """One feed for each workspace: numbered entries in a shared folder, of which the highest names the owner.

    Every step (taking, keeping, giving back) creates the next entry if nobody else has, through the store's file
    layer, so of two contenders for a free or stale lock one wins wherever Spark can create files safely. An entry that
    has not been followed for ``stale`` seconds belonged to a process that died. An owner that finds a newer entry of
    somebody else has lost the workspace and must stop.
    """

    def __init__(self, spark: SparkSession, root: str, owner: str, stale: float = 60.0, clock: Callable[[], float] = time.time):
        self.files, self.owner, self.stale, self.clock = Store(spark, root), owner, stale, clock

    def _numbers(self) -> list[int]:
        names = [s.getPath().getName() for s in self.files._list("lock")]
        return sorted(int(n[:-5]) for n in names if n.endswith(".json") and n[:-5].isdigit())

    def _last(self) -> tuple[int, dict]:
        """The highest entry: its number, owner (None: given back) and time."""
        numbers = self._numbers()
        if not numbers:
            return 0, {"owner": None, "at": 0.0}
        return numbers[-1], json.loads(self.files.text(f"lock/{numbers[-1]:012d}.json"))

    def _enter(self, after: int, owner: str | None) -> bool:
        try:
            self.files.create(f"lock/{after + 1:012d}.json", json.dumps({"owner": owner, "at": self.clock()}).encode())
        except StoreError as e:
            if str(e) != "conflict":
                raise
            return False
        for old in self._numbers():
            if old < after:  # the entry before stays for whoever is reading it
                files, at = self.files._fs(f"{self.files.root}/lock/{old:012d}.json")
                files.delete(at, False)
        return True

    def _held(self, entry: dict) -> bool:
        return entry["owner"] is not None and self.clock() - entry["at"] <= self.stale

    def acquire(self) -> bool:
        """True if this owner has the workspace now."""
        number, entry = self._last()
        if self._held(entry) and entry["owner"] != self.owner:
            return False
        return self._enter(number, self.owner)

    def refresh(self) -> None:
        """Keep the lock; an error if it has gone to somebody else."""
        number, entry = self._last()
        if entry["owner"] != self.owner or not self._enter(number, self.owner):
            raise StoreError(f"conflict: the feed belongs to {entry['owner']}")

    def release(self) -> None:
        number, entry = self._last()
        if entry["owner"] == self.owner:
            self._enter(number, None)

    def status(self) -> dict:
        entry = self._last()[1]
        return {"running": self._held(entry), "owner": entry["owner"]}


def start(changes: DataFrame, publish: Callable[[list[str]], None] | Publisher, checkpoint: str, throttle: str = THROTTLE) -> StreamingQuery:
    """Run the feed over a stream of (ts, path); never two publishes at once."""
    publisher = publish if isinstance(publish, Publisher) else Publisher(publish)
    return changes.writeStream.foreachBatch(publisher).option("checkpointLocation", checkpoint).trigger(processingTime=throttle).start()


def run_until_idle(query: StreamingQuery, publisher: Publisher, ownership: Ownership, idle: float = 300.0, poll: float = 5.0) -> None:
    """Keep the lock fresh while the feed runs; stop it, and give the lock back, when nothing has changed for a while."""
    try:
        while query.isActive and time.monotonic() - publisher.last_change < idle:
            ownership.refresh()
            query.awaitTermination(poll)
    finally:
        query.stop()
        ownership.release()


def reconcile(on_disk: DataFrame, indexed: DataFrame) -> DataFrame:
    """Paths whose content hash differs from the indexed one, or that exist on one side only."""
    both = on_disk.select("path", F.col("hash").alias("h1")).join(indexed.select("path", F.col("hash").alias("h2")), "path", "full")
    return both.filter(~F.col("h1").eqNullSafe(F.col("h2"))).select("path")


def windowed_counts(events: DataFrame, late: str = "10 minutes", every: str = "1 hour") -> DataFrame:
    """Events per type and window behind a watermark (works on batches and streams alike)."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", every).alias("w"), "event_type").agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), "event_type", "n")

"""A spending ledger: numbered entries, each created once, so that a check and its record are one step."""

from __future__ import annotations

import json
from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strataflow.operators.usage import grant, settle, windows

from .store import Store, StoreError

ENTRY = "entry long, kind string, reservation_id long, recorded_at timestamp, provider string, unit string, amount double"


class Ledger:
    """Reservations and settlements of one root; of two writers one sees the other's entry and tries again."""

    def __init__(self, spark: SparkSession, root: str, attempts: int = 5):
        self.spark, self.root, self.attempts, self._files = spark, root.rstrip("/"), attempts, Store(spark, root)

    def entries(self) -> DataFrame:
        files, at = self._files._fs(f"{self.root}/entries")
        if not files.exists(at):
            return self.spark.createDataFrame([], ENTRY)
        return self.spark.read.schema(ENTRY).json(f"{self.root}/entries")

    def reservations(self) -> DataFrame:
        """reservation_id, recorded_at, provider, unit and the amount that counts: a settled one where there is one."""
        every = self.entries()
        last = every.filter("kind = 'settled'").groupBy("reservation_id").agg(F.max_by("amount", "entry").alias("amount"))
        return settle(every.filter("kind = 'reserved'").drop("kind", "entry"), last)

    def _append(self, number: int, row: dict) -> None:
        self._files.create(f"entries/{number:012d}.json", json.dumps({"entry": number} | row).encode())

    def _next(self) -> int:
        return (self.entries().agg(F.max("entry")).first()[0] or 0) + 1

    def reserve(self, provider: str, unit: str, most: float, least: float = 0.0, limits: dict[str, float | None] | None = None, now: datetime | None = None) -> tuple[int | None, float]:
        """(reservation, amount) within the day's, week's and month's limits; an error if too little is left.

        Without any limit the maximum is granted and nothing is recorded (the reservation is None)."""
        limits = {"day": None, "week": None, "month": None} | (limits or {})
        if not provider or not unit or most < 0 or least < 0 or 0 < most < least or any(v is not None and v < 0 for v in limits.values()):
            raise StoreError("invalid request")
        if not any(limits.values()):
            return None, most
        now = now or datetime.now(timezone.utc)
        for _ in range(self.attempts):
            number = self._next()
            mine = self.reservations().filter((F.col("provider") == provider) & (F.col("unit") == unit))
            used = windows(mine, F.lit(now.isoformat()).cast("timestamp")).first()
            amount = grant({w: float(used[f"{w}_used"]) for w in limits}, limits, most, least)
            if amount is None:
                raise StoreError("spend limit exceeded")
            try:
                self._append(number, {"kind": "reserved", "reservation_id": number, "recorded_at": now.isoformat(), "provider": provider, "unit": unit, "amount": amount})
                return number, amount
            except StoreError:
                continue
        raise StoreError("conflict")

    def settle(self, reservation: int, exact: float) -> None:
        """Replace a reservation's amount by the exact one, which may not be above it."""
        if not 0 <= exact < float("inf"):
            raise StoreError("invalid request")
        for _ in range(self.attempts):
            number = self._next()
            held = self.reservations().filter(F.col("reservation_id") == reservation).select("amount").collect()
            if len(held) != 1 or held[0]["amount"] < exact:
                raise StoreError("invalid request")
            try:
                return self._append(number, {"kind": "settled", "reservation_id": reservation, "amount": exact})
            except StoreError:
                continue
        raise StoreError("conflict")

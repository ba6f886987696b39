"""Broadcasts only behind a measure of what is broadcast."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Most rows, and most bytes of their values, of a side that is broadcast; beyond it the same join shuffles.
ROWS, BYTES = 1_000_000, 32 << 20
FIXED = {"boolean": 1, "tinyint": 1, "smallint": 2, "int": 4, "date": 4, "float": 4, "bigint": 8, "double": 8, "timestamp": 8}


def small(side: DataFrame, rows: int = ROWS, most_bytes: int = BYTES) -> DataFrame:
    """``side`` with a broadcast hint if one aggregation finds it within both limits, else as it is."""
    types = dict(side.dtypes)
    size = F.lit(sum(FIXED.get(t, 0) for t in types.values())).cast("long")
    for c, t in types.items():
        if t not in FIXED:
            size = size + F.coalesce(F.octet_length(c) if t in ("string", "binary") else F.octet_length(F.to_json(F.struct(c))), F.lit(0))
    n, held = side.agg(F.count("*"), F.coalesce(F.sum(size), F.lit(0))).first()
    return F.broadcast(side) if n <= rows and held <= most_bytes else side

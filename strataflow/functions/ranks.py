"""Global row numbers, prefix sums and ranks without a window over all rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .lineage import cut

#: Rows of a block whose running sums one task makes.
BLOCK_BITS = 16


def numbered(df: DataFrame, order: list[Column], name: str, keep: Callable[[DataFrame], DataFrame] = cut) -> DataFrame:
    """``df`` with its rows' positions (0-based) in ``order``.

    Rows are dealt to ranges of the order and sorted there; a row's position is its place in its range plus
    the sizes of the ranges before. Ranges are written once (``keep``), so that a repeated task can't deal
    them anew. Only the ranges' sizes, one row a partition, are summed in one place. Rows that ``order``
    does not tell apart are one range: add columns until it does where they may be many.
    """
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    placed = keep(df.repartitionByRange(n, *order).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id()))
    sizes = placed.groupBy(F.shiftright("_at", 33).alias("_range")).agg(F.count("*").alias("_n"))
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)  # one row a partition
    starts = sizes.select("_range", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    at = F.col("_start") + F.col("_at").bitwiseAND((1 << 33) - 1)
    return placed.withColumn("_range", F.shiftright("_at", 33)).join(F.broadcast(starts), "_range").withColumn(name, at).drop("_range", "_at", "_start")


def prefix_sums(df: DataFrame, at: str, columns: list[str], n: int, bits: int = BLOCK_BITS) -> DataFrame:
    """``df``, whose ``at`` are the positions 0 to n-1, each once, with ``<column>_sum`` over all rows up to each.

    Sums run inside blocks of 2**bits positions; the blocks' totals are summed in the same way, so no task
    sees more than a block.
    """
    rows = df.withColumn("_block", F.shiftright(F.col(at), bits))
    inside = Window.partitionBy("_block").orderBy(at).rowsBetween(Window.unboundedPreceding, 0)
    own = rows.withColumns({f"{c}_sum": F.sum(c).over(inside) for c in columns})
    if n <= 1 << bits:
        return own.drop("_block")
    totals = rows.groupBy(F.col("_block").alias("_b")).agg(*[F.sum(c).alias(f"_t_{c}") for c in columns])
    summed = prefix_sums(totals, "_b", [f"_t_{c}" for c in columns], -(-n >> bits), bits)
    carried = summed.select(F.col("_b").alias("_block"), *[(F.col(f"_t_{c}_sum") - F.col(f"_t_{c}")).alias(f"_c_{c}") for c in columns])
    joined = own.join(carried, "_block")
    return joined.withColumns({f"{c}_sum": F.col(f"{c}_sum") + F.col(f"_c_{c}") for c in columns}).drop("_block", *[f"_c_{c}" for c in columns])


def value_ranks(df: DataFrame, keys: list[str], value: Column, name: str, keep: Callable[[DataFrame], DataFrame] = cut) -> DataFrame:
    """Per key and distinct value: ``_n`` rows with it, ``<name>`` rows of its key before it, and ``_total`` of the key.

    Rows merge by value before they are dealt, and a key's values spread over as many ranges as they fill, so
    neither a hot key nor a hot value gathers in one task.
    """
    counts = keep(df.groupBy(*keys, value.alias("_value")).agg(F.count("*").alias("_n")))
    order = [*[F.col(k) for k in keys], F.col("_value")]
    placed = numbered(counts, order, "_place", keep)
    sums = prefix_sums(placed, "_place", ["_n"], counts.count())
    upto = keep(sums.withColumn("_upto", F.col("_n_sum") - F.col("_n")).drop("_n_sum", "_place"))
    if not keys:
        total = upto.agg(F.coalesce(F.sum("_n"), F.lit(0)).alias("_total"))  # one row
        return upto.crossJoin(F.broadcast(total)).withColumnRenamed("_upto", name)
    starts = upto.groupBy(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)]).agg(F.min("_upto").alias("_first"), F.sum("_n").alias("_total"))
    same = [F.col(k).eqNullSafe(F.col(f"_k{i}")) for i, k in enumerate(keys)]
    on = same[0]
    for s in same[1:]:
        on = on & s
    return upto.join(starts, on).withColumn(name, F.col("_upto") - F.col("_first")).drop("_upto", "_first", *[f"_k{i}" for i in range(len(keys))])

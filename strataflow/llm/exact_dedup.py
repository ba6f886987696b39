"""Exact duplicates through an extendible-hash index kept in shared files.

1. *Segments.* Every scan task groups its own rows by text in a bounded table (texts with one hash
   key are chained and told apart by comparing bytes) and writes one entry per distinct text with
   the row that would stay, plus one small line per input row. However many copies a text has, a
   task passes on one entry per table flush, so a hot text never gathers in one place.
2. *Directory.* From the byte counts of key prefixes (a bounded histogram) the directory doubles
   until no bucket is overfull or no prefix bits are left. The capacity of a bucket is at least
   ``bucket_bytes`` and a fixed share of all entries, so the prefix bits suffice at every size. The
   directory, slot by slot, is a table of the index beside its segments.
3. *Owners.* Buckets are dealt to owner tasks by ranges of their slots: an owner holds one key range,
   reads its entries in key order as a stream, chains entries whose keys collide, compares bytes, and
   emits the surviving row and the group's size.

Edge cases: null text counts as empty, so null and empty rows are one group. Of equal texts the
row with the largest doc_id stays (null is smaller than any id); of rows that repeat a doc_id and its
text exactly one stays. Very long texts are hashed and compared whole. All columns of a surviving row are
carried as one struct, so no column name can clash. Empty tables give empty results.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Scratch


@dataclass(frozen=True)
class Params:
    """``flush_bytes`` bounds a scan task's table, ``bucket_bytes`` is when a bucket splits,
    ``key_bits`` is the width of the hash key (tests narrow it to force chains), ``max_depth`` bounds the directory
    (2**max_depth slots), ``owner_bytes`` is what an owner task is dealt."""

    flush_bytes: int = 48 << 20
    bucket_bytes: int = 8 << 20
    key_bits: int = 128
    max_depth: int = 18
    owner_bytes: int = 512 << 20

    def shape(self, total: int) -> tuple[int, int]:
        """The capacity of a bucket and the prefix bits of the histogram, for entries of ``total`` bytes."""
        capacity = max(1, self.bucket_bytes, total >> (self.max_depth - 2))
        return capacity, max(1, min(self.max_depth, (total // capacity).bit_length() + 3))

    def owners(self, total: int, buckets: int, tasks: int) -> int:
        """Owner tasks: of at most ``owner_bytes`` each while there are buckets to deal."""
        return max(1, min(buckets, max(tasks, -(-total // self.owner_bytes))))


LEAST = -(1 << 63)


def cut(digest: bytes, bits: int) -> bytes:
    """The first ``bits`` of a SHA-256 digest, as whole bytes."""
    return (int.from_bytes(digest, "big") >> (256 - bits)).to_bytes(-(-bits // 8), "big")


def prefix_of(key: bytes, bits: int, depth: int) -> int:
    """The leading ``depth`` bits of a key of ``bits`` bits."""
    value = int.from_bytes(key, "big")
    return value >> (bits - depth) if bits >= depth else value << (depth - bits)


def _segments(schema: pa.Schema, row_schema: pa.DataType, params: Params, hist: int):
    def write(batches):
        part, counter = TaskContext.get().partitionId(), 0
        table: dict[bytes, list] = {}
        size = 0

        def flush():
            nonlocal table, size
            entries = [e for chain in table.values() for e in chain]
            table, size = {}, 0
            for at in range(0, len(entries), 512):
                some = entries[at : at + 512]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([None] * len(some), pa.int64()), pa.array([e["id"] for e in some], pa.int64()), pa.array([e["line"] for e in some], pa.int64()), pa.array([True] * len(some)),
                        pa.array([e["key"] for e in some], pa.binary()), pa.array([prefix_of(e["key"], params.key_bits, hist) for e in some], pa.int32()),
                        pa.array([len(e["bytes"]) for e in some], pa.int64()), pa.array([e["n"] for e in some], pa.int64()), pa.array([None] * len(some), pa.string()), pa.array([e["row"] for e in some], row_schema),
                    ],
                    schema=schema,
                )

        for batch in batches:
            column = batch.column(0)
            ids, texts = column.field("doc_id").to_pylist(), column.field("text").to_pylist()
            lines: list[tuple] = []
            for j, (doc, text) in enumerate(zip(ids, texts, strict=True)):
                data = (text or "").encode("utf-8", "surrogatepass")
                digest = hashlib.sha256(data).digest()
                key = cut(digest, params.key_bits)
                chain = table.setdefault(key, [])
                rank, line = LEAST if doc is None else doc, part << 33 | counter
                counter += 1
                entry = next((e for e in chain if e["bytes"] == data), None)
                if entry is None:
                    entry = {"id": line, "key": key, "bytes": data, "n": 0, "rank": None}
                    chain.append(entry)
                    size += 2 * len(data) + 500
                entry["n"] += 1
                if entry["rank"] is None or rank > entry["rank"]:
                    entry |= {"rank": rank, "line": line, "row": column[j].as_py()}
                lines.append((doc, entry["id"], line, digest.hex()))
            none = [None] * len(lines)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([x[0] for x in lines], pa.int64()), pa.array([x[1] for x in lines], pa.int64()), pa.array([x[2] for x in lines], pa.int64()), pa.array([False] * len(lines)),
                    pa.array(none, pa.binary()), pa.array(none, pa.int32()), pa.array(none, pa.int64()), pa.array(none, pa.int64()), pa.array([x[3] for x in lines], pa.string()), pa.array(none, row_schema),
                ],
                schema=schema,
            )
            if size > params.flush_bytes:
                yield from flush()
        yield from flush()

    return write


def directory(histogram: dict[int, int], bits: int, capacity: int) -> tuple[int, list[int]]:
    """Split overfull buckets until none is, or no bits are left.

    Returns the global depth and, for each of its 2**depth slots, the bucket's first slot: slots that
    share a bucket of smaller local depth hold the same number.
    """
    buckets, todo = [], [(0, 0, sum(histogram.values()))]
    sums = {(bits, p): n for p, n in histogram.items()}
    for d in range(bits - 1, -1, -1):
        level: dict = {}
        for (e, p), n in sums.items():
            if e == d + 1:
                level[d, p >> 1] = level.get((d, p >> 1), 0) + n
        sums |= level
    while todo:
        depth, p, n = todo.pop()
        if n > capacity and depth < bits:
            todo += [(depth + 1, 2 * p + side, sums.get((depth + 1, 2 * p + side), 0)) for side in (0, 1)]
        else:
            buckets.append((depth, p))
    whole = max((d for d, _ in buckets), default=0)
    slots = [0] * (1 << whole)
    for d, p in buckets:
        first = p << (whole - d)
        slots[first : first + (1 << (whole - d))] = [first] * (1 << (whole - d))
    return whole, slots


def _owner(out: pa.Schema, keep_rows: bool):
    """Stream of entries in (bucket, key) order to one surviving row per distinct text."""

    def resolve(batches):
        key, chains = None, []

        def end():
            for entries, best in chains:
                total = sum(n for _, n in entries)
                for eid, _ in entries:
                    mine = keep_rows and eid == best["entry"]
                    yield [key, eid, best["row"]["doc_id"], best["line"], total, best["row"] if mine else None]

        def pack(rows):
            return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], f.type) for i, f in enumerate(out)], schema=out)

        rows = []
        for batch in batches:
            keys, ids, marks, ns, column = (batch.column(i) for i in range(5))
            for j in range(batch.num_rows):
                k, row = keys[j].as_py(), column[j].as_py()
                if k != key:
                    rows += end()
                    key, chains = k, []
                    if len(rows) >= 256:
                        yield pack(rows)
                        rows = []
                entry = {"entry": ids[j].as_py(), "line": marks[j].as_py(), "rank": LEAST if row["doc_id"] is None else row["doc_id"], "row": row}
                chain = next((c for c in chains if (c[1]["row"]["text"] or "") == (row["text"] or "")), None)
                if chain is None:
                    chains.append([[(entry["entry"], ns[j].as_py())], entry])
                else:
                    chain[0].append((entry["entry"], ns[j].as_py()))
                    if entry["rank"] > chain[1]["rank"]:
                        chain[1] = entry
        rows += end()
        if rows:
            yield pack(rows)

    return resolve


@dataclass
class Index:
    """``entries``: key, entry, keep_id, keep_line, group_size, row (of the survivor only);
    ``lines``: doc_id, entry, line, text_sha256 for every input row; ``directory``: slot, bucket, owner."""

    entries: DataFrame
    lines: DataFrame
    directory: DataFrame
    depth: int
    buckets: int


def build(docs: DataFrame, params: Params = Params(), scratch: Scratch | None = None, keep_rows: bool = True) -> Index:
    """Build the index over every row and whole text of ``docs``; ``keep_rows`` also carries the
    surviving rows with all their columns."""
    spark = docs.sparkSession
    scratch = scratch or Scratch(spark, "exact-dedup")
    used = docs if keep_rows else docs.select("doc_id", "text")
    row = used.select(F.struct(*[F.col(f"`{c}`") for c in used.columns]).alias("row"))
    row_type = row.schema["row"].dataType
    segment = T.StructType(
        [T.StructField(n, t) for n, t in (("doc_id", T.LongType()), ("entry", T.LongType()), ("line", T.LongType()), ("is_entry", T.BooleanType()), ("key", T.BinaryType()), ("prefix", T.IntegerType()), ("bytes", T.LongType()), ("n", T.LongType()), ("text_sha256", T.StringType()), ("row", row_type))]
    )
    from pyspark.sql.pandas.types import to_arrow_schema

    arrow = to_arrow_schema(segment)
    hist = params.max_depth
    segments = scratch.keep(row.mapInArrow(_segments(arrow, arrow.field("row").type, params, hist), segment), "segments")
    entries = segments.filter("is_entry")
    # bounded: at most 2**hist cells, and cells merge before they reach the driver
    total = entries.agg(F.coalesce(F.sum("bytes"), F.lit(0)).alias("b")).first()["b"]
    capacity, bits = params.shape(total)
    cells = entries.groupBy((F.shiftright("prefix", hist - bits)).alias("p")).agg(F.sum("bytes").alias("b")).collect()
    depth, slots = directory({r["p"]: r["b"] for r in cells}, bits, capacity)
    number = {s: i for i, s in enumerate(sorted(set(slots)))}
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    owners = params.owners(total, len(number), tasks)
    rows = [(s, b, number[b] * owners // len(number)) for s, b in enumerate(slots)]
    table = scratch.keep(spark.createDataFrame(rows, "slot int, bucket int, owner int").coalesce(1), "directory")  # 2**depth rows, at most 2**max_depth
    dealt = entries.withColumn("slot", F.shiftright("prefix", hist - depth)).join(F.broadcast(table), "slot")
    out = T.StructType([T.StructField(n, t) for n, t in (("key", T.BinaryType()), ("entry", T.LongType()), ("keep_id", T.LongType()), ("keep_line", T.LongType()), ("group_size", T.LongType()), ("row", row_type))])
    arrow_out = to_arrow_schema(out)
    owned = (
        dealt.select("owner", "key", "entry", "line", "n", "row")
        .repartitionById(owners, F.col("owner"))
        .sortWithinPartitions("key", "entry")
        .select("key", "entry", "line", "n", "row")
        .mapInArrow(_owner(arrow_out, keep_rows), out)
    )
    lines = segments.filter(~F.col("is_entry")).select("doc_id", "entry", "line", "text_sha256")
    return Index(owned, lines, table, depth, len(number))


def survivors(docs: DataFrame, params: Params = Params()) -> DataFrame:
    """One row of ``docs`` per distinct text, columns unchanged."""
    index = build(docs, params)
    return index.entries.filter("row is not null").select("row.*")


def groups(docs: DataFrame, params: Params = Params()) -> DataFrame:
    """One row per input row: doc_id, keep_id, group_size, kept, text_sha256."""
    scratch = Scratch(docs.sparkSession, "exact-dedup")
    index = build(docs, params, scratch, keep_rows=False)
    found = scratch.keep(index.entries.select("entry", "keep_id", "keep_line", "group_size"), "index")
    per_line = index.lines.join(found, "entry")
    kept = F.col("line") == F.col("keep_line")
    return per_line.select("doc_id", "keep_id", "group_size", kept.alias("kept"), "text_sha256")

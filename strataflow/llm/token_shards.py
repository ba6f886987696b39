"""Training-order token files: a keyed permutation gives every sequence its global slot.

Each document is encoded, ended with the end id, and cut into sequences of ``length`` tokens (the last
one padded with the end id). Sequences are numbered densely: a first pass counts them per input split,
prefix sums give each split its first number. A Feistel network over the smallest even number of bits
that holds the count, walked until it lands inside (cycle-walking), permutes the numbers into slots.
Slots are dealt to shards by range, so shard s holds slots s*n to (s+1)*n-1 in order, at a fixed stride:
the record of a slot is at (slot - s*n) * length * 2 bytes. A reader needs only the manifest to start,
stop or resume anywhere and reads sequentially.

The second pass checks each split's count and a checksum of its document order against the first, and
fails rather than write a wrong order if the input is not the same. Shards appear whole or not at all.

Edge cases: null and empty texts make one sequence of end ids only; special-token strings in a text are
ordinary text. A very long text is encoded whole and makes as many sequences as it needs; they lie in
different shards like any others. Repeated rows make sequences of their own. An empty table makes no shard.
Extra columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import json
import math
from array import array
from dataclasses import asdict, dataclass, replace

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared_files import Writer, attempt, read_range, stream

RANKS = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Fixed value: the word pattern of the byte-level vocabulary, in the form without backtracking.
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}++| ?\p{N}++| ?[^\s\p{L}\p{N}]++|\s++$|\s+(?!\S)|\s"""


@dataclass(frozen=True)
class Params:
    """``shard_slots`` is the least size of a shard; it doubles until there are at most ``max_shards``."""

    length: int = 512
    shard_slots: int = 16384
    max_shards: int = 50_000
    key: int = 0x5EED_0F_0DE5
    rounds: int = 6
    ranks: str = RANKS
    end: int = 50256


class Feistel:
    """A keyed permutation of range(size)."""

    def __init__(self, size: int, key: int, rounds: int):
        self.size, self.rounds = size, rounds
        self.half = max(1, math.ceil(max(1, (size - 1).bit_length()) / 2))
        self.mask = np.uint64((1 << self.half) - 1)
        self.keys = [np.uint64(xxhash.xxh3_64_intdigest(f"{key}/{r}")) for r in range(rounds)]

    def _f(self, x: np.ndarray, k: np.uint64) -> np.ndarray:
        h = (x ^ k) * np.uint64(0x9E3779B97F4A7C15)
        h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
        return (h ^ (h >> np.uint64(29))) & self.mask

    def _once(self, x: np.ndarray, keys) -> np.ndarray:
        left, right = x >> np.uint64(self.half), x & self.mask
        for k in keys:
            left, right = right, left ^ self._f(right, k)
        return (left << np.uint64(self.half)) | right

    def _back(self, x: np.ndarray) -> np.ndarray:
        left, right = x >> np.uint64(self.half), x & self.mask
        for k in reversed(self.keys):
            left, right = right ^ self._f(left, k), left
        return (left << np.uint64(self.half)) | right

    def _walk(self, x: np.ndarray, step) -> np.ndarray:
        out = step(x)
        while (over := out >= np.uint64(self.size)).any():
            out[over] = step(out[over])
        return out

    def slots(self, numbers) -> np.ndarray:
        return self._walk(np.asarray(numbers, np.uint64), lambda x: self._once(x, self.keys)).astype(np.int64)

    def numbers(self, slots) -> np.ndarray:
        return self._walk(np.asarray(slots, np.uint64), self._back).astype(np.int64)


def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


class Tokenizer:
    """Byte-level BPE to packed 16-bit ids."""

    def __init__(self, ranks: dict[bytes, int]):
        import tiktoken

        # no special tokens: the ordinary encoder skips the search for them
        self.encode = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary

    def __call__(self, text: str | None) -> bytes:
        return array("H", self.encode(text)).tobytes() if text else b""

    def count(self, text: str | None) -> int:
        return len(self.encode(text)) if text else 0


#: The tokenizer of this worker process; building it from the ranks takes longer than many texts.
_TOKENIZERS: dict = {}


def vocabulary_key(ranks: dict[bytes, int]) -> str:
    """A digest of every entry: vocabularies that differ anywhere never share a tokenizer."""
    h = hashlib.sha256()
    for token, rank in ranks.items():
        h.update(b"%d %d " % (rank, len(token)) + token)
    return h.hexdigest()


def tokenizer(ranks: dict[bytes, int], key: str | None = None) -> Tokenizer:
    """The tokenizer of a vocabulary; ``key`` is its ``vocabulary_key``, if known already."""
    key = key or vocabulary_key(ranks)
    if key not in _TOKENIZERS:
        _TOKENIZERS.clear()
        _TOKENIZERS[key] = Tokenizer(ranks)
    return _TOKENIZERS[key]


def _sequences(texts, tokenizer: Tokenizer, length: int, end: int):
    """Packed sequences of one text after another: lists of (bytes, real tokens)."""
    stop = np.uint16(end).tobytes()
    stride = 2 * length
    for text in texts:
        data = tokenizer(text) + stop
        yield [(data[i : i + stride] + stop * ((stride - len(data[i : i + stride])) // 2), len(data[i : i + stride]) // 2) for i in range(0, len(data), stride)]


MANIFEST = "manifest.json"


def write(docs: DataFrame, root: str, p: Params = Params()) -> DataFrame:
    """Write shards and manifest under ``root``. The returned DataFrame does the writing when it is
    executed and has one row per sequence, read back from its shard: doc_id, chunk, slot, shard,
    byte_offset, n_tokens, tokens_xxh64."""
    spark = docs.sparkSession
    vocabulary = load_ranks(p.ranks)
    if max(vocabulary.values(), default=0) >= 1 << 16 or p.end >= 1 << 16:
        raise ValueError(f"{p.ranks}: ids beyond 16 bits don't fit these shards")
    key = vocabulary_key(vocabulary)
    ranks = spark.sparkContext.broadcast(vocabulary)  # bounded by the vocabulary file
    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))

    def count(batches):
        tok, n, check = tokenizer(ranks.value, key), 0, 0
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                for doc, text in zip(batch.column(0).slice(at, 256).to_pylist(), batch.column(1).slice(at, 256).to_pylist(), strict=True):
                    chunks = tok.count(text) // p.length + 1  # the end id makes one token more
                    n += chunks
                    check = xxhash.xxh3_64_intdigest(f"{check}/{doc}/{chunks}") >> 1
        yield pa.RecordBatch.from_pydict({"split": pa.array([TaskContext.get().partitionId()], pa.int32()), "n": pa.array([n], pa.int64()), "check": pa.array([check], pa.int64())})

    counted = sorted(map(tuple, source.mapInArrow(count, "split int, n long, check long").collect()))  # one row per input split
    total = sum(n for _, n, _ in counted)
    base, at = {}, 0
    for split, n, check in counted:
        base[split] = (at, n, check)
        at += n
    per = p.shard_slots
    while total > per * p.max_shards:
        per *= 2
    p = replace(p, shard_slots=per)
    shards = max(1, -(-total // per))
    manifest = Writer(f"{root}/{MANIFEST}", "driver")
    manifest.write(json.dumps(asdict(p) | {"total": total, "shards": shards, "dtype": "uint16"}).encode())
    manifest.close()
    starts = spark.sparkContext.broadcast(base)
    schema = pa.schema([("shard", pa.int32()), ("slot", pa.int64()), ("doc_id", pa.int64()), ("chunk", pa.int64()), ("n_tokens", pa.int64()), ("tokens", pa.binary())])

    def place(batches):
        tok, n, check = tokenizer(ranks.value, key), 0, 0
        split = TaskContext.get().partitionId()
        first, expected, expected_check = starts.value.get(split, (0, 0, 0))
        order = Feistel(max(1, total), p.key, p.rounds)
        for batch in batches:
            ids, texts = batch.column(0).to_pylist(), batch.column(1)
            for i in range(0, len(ids), 256):
                rows = []
                for doc, chunks in zip(ids[i : i + 256], _sequences(texts.slice(i, 256).to_pylist(), tok, p.length, p.end), strict=True):
                    check = xxhash.xxh3_64_intdigest(f"{check}/{doc}/{len(chunks)}") >> 1
                    rows += [(doc, k, real, data) for k, (data, real) in enumerate(chunks)]
                if n + len(rows) > expected:
                    raise RuntimeError(f"split {split} holds more sequences than were counted")
                slots = order.slots(np.arange(first + n, first + n + len(rows)))
                n += len(rows)
                yield pa.RecordBatch.from_arrays([pa.array(slots // p.shard_slots, pa.int32()), pa.array(slots, pa.int64()), *[pa.array([r[j] for r in rows], f.type) for j, f in enumerate(list(schema)[2:])]], schema=schema)
        if n != expected or n and check != expected_check:
            raise RuntimeError(f"split {split} is not the one that was counted; write the input to a table first")

    def store(batches):
        out, name, found = None, attempt(), []

        def finish():
            out.close()
            with stream(f"{root}/shard-{shard:06d}.bin") as f:
                for slot, doc, chunk, real in found:
                    data = f.read(2 * p.length)
                    yield (doc, chunk, slot, shard, (slot - shard * p.shard_slots) * 2 * p.length, real, int(np.uint64(xxhash.xxh3_64_intdigest(data)).astype(np.int64)))

        def pack(rows):
            return pa.RecordBatch.from_arrays([pa.array([r[j] for r in rows], t) for j, t in enumerate([pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()])], names=["doc_id", "chunk", "slot", "shard", "byte_offset", "n_tokens", "tokens_xxh64"])

        shard = -1
        for batch in batches:
            columns = [batch.column(j).to_pylist() for j in range(6)]
            for s, slot, doc, chunk, real, data in zip(*columns, strict=True):
                if s != shard:
                    if out is not None:
                        yield pack(list(finish()))
                    shard, found = s, []
                    out = Writer(f"{root}/shard-{shard:06d}.bin", name)
                if out.at != (slot - shard * p.shard_slots) * 2 * p.length:
                    raise RuntimeError(f"slot {slot} is out of order")
                out.write(data)
                found.append((slot, doc, chunk, real))
        if out is not None:
            yield pack(list(finish()))

    placed = source.mapInArrow(place, "shard int, slot long, doc_id long, chunk long, n_tokens long, tokens binary")
    ordered = placed.repartitionById(shards, F.col("shard")).sortWithinPartitions("slot")
    return ordered.mapInArrow(store, "doc_id long, chunk long, slot long, shard int, byte_offset long, n_tokens long, tokens_xxh64 long")


def read_manifest(root: str) -> dict:
    with stream(f"{root}/{MANIFEST}") as f:
        return json.loads(f.read())


def read_slots(root: str, start: int, count: int) -> np.ndarray:
    """The sequences of slots start to start+count-1 as a (count x length) array; reads only them."""
    m = read_manifest(root)
    stride, per = 2 * m["length"], m["shard_slots"]
    count = max(0, min(count, m["total"] - start))
    parts, at = [], start
    while at < start + count:
        shard = at // per
        n = min(start + count, (shard + 1) * per) - at
        parts.append(read_range(f"{root}/shard-{shard:06d}.bin", (at - shard * per) * stride, n * stride))
        at += n
    return np.frombuffer(b"".join(parts), np.uint16).reshape(-1, m["length"])


def scan(spark: SparkSession, root: str) -> DataFrame:
    """All sequences as (slot, tokens), one task per shard."""
    m = read_manifest(root)
    if not m["total"]:
        return spark.createDataFrame([], "slot long, tokens array<int>")

    def run(batches):
        for batch in batches:
            for shard in batch.column(0).to_pylist():
                for first in range(shard * m["shard_slots"], min(m["total"], (shard + 1) * m["shard_slots"]), 1024):
                    some = read_slots(root, first, min(1024, (shard + 1) * m["shard_slots"] - first))
                    yield pa.RecordBatch.from_arrays([pa.array(np.arange(first, first + len(some)), pa.int64()), pa.array(list(some.astype(np.int32)), pa.list_(pa.int32()))], names=["slot", "tokens"])

    return spark.range(0, m["shards"], 1, m["shards"]).mapInArrow(run, "slot long, tokens array<int>")

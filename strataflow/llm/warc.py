"""WARC archives with a two-level capture index.

Writing: captures are range-partitioned by reversed-host URL key, so every archive holds one key range
in order and each record is its own gzip member. Beside each archive goes an index of one line per
capture in compressed blocks, and a sparse directory with the first key and byte range of every block.
Of captures with equal payloads the one with the smallest page_id is a ``response``; the others are
``revisit`` records that carry no payload.

Looking up: a table of archive parts (one row per part, bounded by the number of partitions) finds the
part of a key, a binary search of the part's directory finds the block, a binary search of the block
finds the line, and a range read fetches just that record.

Edge cases: a null html is an empty payload; payloads under ``min_revisit`` bytes are always responses.
A null URL has the empty key; very long URLs and payloads are written whole. Empty tables make no archive;
an archive that lacks records, or ends inside one, is an error. Of rows that repeat a page_id with an equal payload each is a response of
its own; a null page_id is a response unless an identified row has its payload. Extra columns are
ignored. A lost task is repeated under another attempt name and renamed over, so archives are whole.
"""

from __future__ import annotations

import base64
import bisect
import hashlib
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from urllib.parse import urlsplit

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, checked
from .shared_files import Writer, attempt, open_fs, read_range, stream

DATE = "2000-01-01T00:00:00Z"


@dataclass(frozen=True)
class Params:
    """``part_bytes`` is about the payload of one archive (unless ``parts`` says how many there are), ``hot``
    the copies from which a payload's digest is joined by broadcast."""

    min_revisit: int = 0
    block_lines: int = 200
    level: int = 3
    part_bytes: int = 1 << 30
    parts: int | None = None
    hot: int = 10_000


def url_key(url: str | None) -> str:
    """Host labels reversed and joined by commas, then ``)`` and the rest of the URL, lower-cased host."""
    if not url or "://" not in url:
        return ")" + (url or "")
    try:
        bits = urlsplit(url)
    except ValueError:
        return ")" + url
    host = bits.netloc.lower()
    tail = url.split("://", 1)[1][len(bits.netloc) :].split("#", 1)[0]
    return (",".join(reversed(host.split("."))) + ")" + tail).replace("\t", "%09").replace("\n", "%0A")


def base32_sha1(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(url: str | None, page_id: int | None, payload: bytes | None, digest: str, length: int, refers: int | None) -> bytes:
    """One WARC/1.1 record; ``payload`` None makes a revisit of ``refers``."""
    kind = "revisit" if payload is None else "response"
    head = [
        "WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>", f"WARC-Date: {DATE}",
        "WARC-Target-URI: " + (url or "").replace("\r", "%0D").replace("\n", "%0A"), f"WARC-Payload-Digest: sha1:{digest}", f"X-Payload-Length: {length}", "Content-Type: text/html; charset=utf-8",
    ]
    if kind == "revisit":
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <urn:page:{refers}>"]
    body = payload or b""
    head.append(f"Content-Length: {len(body)}")
    return "\r\n".join(head).encode("utf-8", "surrogatepass") + b"\r\n\r\n" + body + b"\r\n\r\n"


def parse(data: bytes) -> dict:
    """The fields of one record."""
    head, _, rest = data.partition(b"\r\n\r\n")
    lines = head.decode("utf-8", "surrogatepass").split("\r\n")
    fields = dict(line.split(": ", 1) if ": " in line else (line.rstrip(":"), "") for line in lines[1:])
    body = rest[: int(fields["Content-Length"])]
    number = lambda name: int(v) if (v := fields.get(name, "")[10:-1]) else None
    return {
        "page_id": number("WARC-Record-ID"), "url": fields["WARC-Target-URI"], "record_type": fields["WARC-Type"], "payload": body, "payload_digest": fields["WARC-Payload-Digest"][5:],
        "payload_bytes": int(fields["X-Payload-Length"]), "refers_to": number("WARC-Refers-To"),
    }


def members(source) -> Iterator[bytes]:
    """The gzip members of a stream, one after another, in bounded reads."""
    d, parts = zlib.decompressobj(31), []
    left = b""
    while chunk := left or source.read(1 << 20):
        left = b""
        parts.append(d.decompress(chunk))
        if d.eof:
            yield b"".join(parts)
            left, d, parts = d.unused_data, zlib.decompressobj(31), []
    if parts:
        raise ValueError("the last member of the archive is incomplete")


def gz(data: bytes, level: int) -> bytes:
    c = zlib.compressobj(level, zlib.DEFLATED, 31)
    return c.compress(data) + c.flush()


PARTS = "part int, first_key string, records long, archive string, index string, directory string"


def write(pages: DataFrame, root: str, p: Params = Params()) -> DataFrame:
    """Write archives and indexes under ``root``; returns the table of parts (also kept there)."""
    spark = pages.sparkSession
    html = F.coalesce("html", F.lit("")).cast("binary")
    rows = pages.select("page_id", "url", html.alias("payload")).withColumns({"digest": F.sha2("payload", 256), "bytes": F.octet_length("payload")})
    scratch = Scratch(spark, "warc-digests")
    # pre-aggregated by digest: a payload that a third of all pages share is one row here
    groups = scratch.keep(rows.filter(F.col("bytes") >= p.min_revisit).groupBy("digest").agg(F.min("page_id").alias("first_id"), F.count("*").alias("n")).filter("n > 1 and first_id is not null"), "groups")
    revisit = F.col("first_id").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first_id"))
    parts = p.parts or max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-rows.agg(F.coalesce(F.sum("bytes"), F.lit(0))).first()[0] // p.part_bytes))

    def run(batches):
        from pyspark import TaskContext

        part, name = TaskContext.get().partitionId(), attempt()
        archive, index, directory = (f"{root}/{kind}-{part:06d}.{end}" for kind, end in (("captures", "warc.gz"), ("index", "lines.z"), ("directory", "tsv")))
        out = None
        lines, sparse, n, first = [], [], 0, None

        def block():
            data = zlib.compress("\n".join(lines).encode("utf-8", "surrogatepass"))
            sparse.append(f"{lines[0].split(chr(9), 1)[0]}\t{ix.write(data)}\t{len(data)}")
            lines.clear()

        for batch in batches:
            columns = [batch.column(i) for i in range(7)]
            for j in range(batch.num_rows):
                page, url, payload, length, refers, key, sha1 = (c[j].as_py() for c in columns)
                if out is None:
                    out, ix, first = Writer(archive, name), Writer(index, name), key
                digest = base64.b32encode(bytes.fromhex(sha1)).decode()
                data = gz(record(url, page, payload, digest, length, refers), p.level)
                at = out.write(data)
                lines.append("\t".join([key.replace("\t", "%09").replace("\n", "%0A"), "" if page is None else str(page), str(at), str(len(data))]))
                n += 1
                if len(lines) == p.block_lines:
                    block()
        if out is not None:
            if lines:
                block()
            d = Writer(directory, name)
            d.write("\n".join(sparse).encode("utf-8", "surrogatepass"))
            for w in (out, ix, d):
                w.close()
            yield pa.RecordBatch.from_pylist([{"part": part, "first_key": first, "records": n, "archive": archive, "index": index, "directory": directory}], schema=pa.schema([("part", pa.int32()), ("first_key", pa.string()), ("records", pa.int64()), ("archive", pa.string()), ("index", pa.string()), ("directory", pa.string())]))

    # a revisit's digest is that of its payload, taken before the payload is dropped
    # rows of hot payloads leave the join by digest, which would gather them, for a broadcast of the few hot digests
    hot = groups.filter(F.col("n") > p.hot).select(F.col("digest").alias("hot_digest"), F.col("first_id").alias("hot_id"))
    cold = groups.filter(F.col("n") <= p.hot).select(F.col("digest").alias("cold_digest"), F.col("first_id").alias("cold_id"))
    alone = F.when(F.col("hot_id").isNull(), F.col("digest")).otherwise(F.concat(F.lit("-"), F.xxhash64("page_id", "url").cast("string")))
    known = rows.join(checked(hot), F.col("digest") == F.col("hot_digest"), "left").withColumn("alone", alone).join(checked(cold), F.col("alone") == F.col("cold_digest"), "left")
    dealt = known.withColumn("first_id", F.coalesce("hot_id", "cold_id")).select(
        "page_id", "url", F.when(~revisit, F.col("payload")).alias("payload"), "bytes", F.when(revisit, F.col("first_id")).alias("refers_to"), _key_column(F.col("url")).alias("key"), F.sha1("payload").alias("sha1")
    )
    ordered = dealt.repartitionByRange(parts, "key", "page_id").sortWithinPartitions("key", "page_id")
    ordered.mapInArrow(run, PARTS).write.parquet(f"{root}/parts")
    scratch.drop(groups)
    return spark.read.parquet(f"{root}/parts")


def _key_column(url):
    @F.pandas_udf("string")
    def run(urls):
        return urls.map(url_key)

    return run(url)


READ = "page_id long, url string, record_type string, payload binary, payload_digest string, payload_bytes long, refers_to long"


def streamed(archive: str, records: int) -> Iterator[dict]:
    """The records of an archive from its first byte to its last."""
    n = 0
    with stream(archive) as source:
        for data in members(source):
            n += 1
            yield parse(data)
    if n != records:
        raise ValueError(f"{archive}: {n} of {records} records")


def indexed(archive: str, index: str, directory: str, records: int) -> Iterator[dict]:
    """The records of an archive by its directory, its index blocks and range reads at their offsets."""
    n = 0
    with stream(directory) as f:
        sparse = [line.split("\t") for line in f.read().decode("utf-8", "surrogatepass").split("\n")]
    files, path = open_fs(archive)
    with files.open_input_file(path) as f:
        for first, start, size in sparse:
            lines = [x.split("\t") for x in zlib.decompress(read_range(index, int(start), int(size))).decode("utf-8", "surrogatepass").split("\n")]
            if lines[0][0] != first:
                raise ValueError(f"{directory}: the block at {start} does not begin with its key")
            for _, page, at, length in lines:
                f.seek(int(at))
                r = parse(zlib.decompress(f.read(int(length)), 31))
                if ("" if r["page_id"] is None else str(r["page_id"])) != page:
                    raise ValueError(f"{index}: the record at {at} is page {r['page_id']}, not {page}")
                n += 1
                yield r
    if n != records:
        raise ValueError(f"{index}: {n} of {records} records")


def scan(spark: SparkSession, parts: DataFrame, payloads: bool = False, by_index: bool = False) -> DataFrame:
    """Every record of the archives, one task per part, read as a stream or ``by_index``; payload digests
    are checked."""
    schema = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("record_type", pa.string()), ("payload", pa.binary()), ("payload_digest", pa.string()), ("payload_bytes", pa.int64()), ("refers_to", pa.int64())])

    def run(batches):
        for batch in batches:
            for part in batch.to_pylist():
                archive = part["archive"]
                found, held = [], 0
                for r in indexed(**part) if by_index else streamed(archive, part["records"]):
                    if r["record_type"] == "response" and (base32_sha1(r["payload"]) != r["payload_digest"] or len(r["payload"]) != r["payload_bytes"]):
                        raise ValueError(f"{archive}: payload of page {r['page_id']} does not match its digest")
                    held += len(r["payload"]) if payloads else 100
                    found.append(r if payloads else r | {"payload": None})
                    if held > 8 << 20 or len(found) >= 5000:
                        yield pa.RecordBatch.from_pylist(found, schema=schema)
                        found, held = [], 0
                if found:
                    yield pa.RecordBatch.from_pylist(found, schema=schema)

    n = max(1, parts.count())  # as many rows as archives
    return parts.select("archive", "index", "directory", "records", F.row_number().over(_by_part()).alias("i")).withColumn("i", (F.col("i") - 1).cast("int")).repartitionById(n, F.col("i")).select("archive", "index", "directory", "records").mapInArrow(run, READ)


def _by_part():
    from pyspark.sql import Window

    return Window.orderBy("part")


def lookup(urls: DataFrame, parts: DataFrame) -> DataFrame:
    """url, page_id, record_type, payload, refers_to of every capture of each distinct URL asked for."""
    spark = urls.sparkSession
    table = sorted((r["first_key"], r["directory"], r["index"], r["archive"]) for r in parts.collect())  # one row per archive part
    shipped = spark.sparkContext.broadcast(table)
    schema = pa.schema([("asked", pa.string()), ("page_id", pa.int64()), ("record_type", pa.string()), ("payload", pa.binary()), ("payload_digest", pa.string()), ("refers_to", pa.int64())])

    def run(batches):
        table = shipped.value
        firsts = [t[0] for t in table]
        directories: dict = {}
        for batch in batches:
            out = []
            for url in batch.column(0).to_pylist():
                key = url_key(url).replace("\t", "%09").replace("\n", "%0A")
                part = max(0, bisect.bisect_left(firsts, key) - 1)
                done = not table
                while not done and part < len(table) and (firsts[part] <= key):
                    _, directory, index, archive = table[part]
                    if directory not in directories:
                        if len(directories) > 16:
                            directories.clear()
                        with stream(directory) as f:
                            directories[directory] = [line.split("\t") for line in f.read().decode("utf-8", "surrogatepass").split("\n")]
                    sparse = directories[directory]
                    block = max(0, bisect.bisect_left([s[0] for s in sparse], key) - 1)
                    while block < len(sparse) and sparse[block][0] <= key:
                        lines = [x.split("\t") for x in zlib.decompress(read_range(index, int(sparse[block][1]), int(sparse[block][2]))).decode("utf-8", "surrogatepass").split("\n")]
                        at = bisect.bisect_left([x[0] for x in lines], key)
                        while at < len(lines) and lines[at][0] == key:
                            r = parse(zlib.decompress(read_range(archive, int(lines[at][2]), int(lines[at][3])), 31))
                            out.append({"asked": url} | {k: r[k] for k in ("page_id", "record_type", "payload", "payload_digest", "refers_to")})
                            at += 1
                        block += 1
                    part += 1
            yield pa.RecordBatch.from_pylist(out, schema=schema)

    asked = urls.select(F.col(urls.columns[0]).alias("asked")).filter("asked is not null").distinct().sortWithinPartitions("asked")
    return asked.mapInArrow(run, "asked string, page_id long, record_type string, payload binary, payload_digest string, refers_to long")

"""Deterministic sharded WARC writer and reader (op7).

Records are range-sorted by page id. The cut points are every 32nd id of a sample that a
hash of the id chooses, so the same rows give the same shards and the same bytes on
every run. A task writes its shards in order, one gzip member per record, and rolls
to a new file once ``roll_bytes`` of compressed output are reached. Headers and
digests are made from the payload. Every file is written under a temporary name
and renamed when complete; the task reports it, and the manifest, a table of these reports that
Spark writes under a temporary name, is renamed into place once all tasks are
done. Readers open only what the manifest lists, so
files of failed or repeated attempts are never seen. The driver holds one id a shard, nothing else.

Of rows with equal payloads of at least ``min_bytes`` bytes, the one with the largest
page id is a response and the others are revisits that refer to it. Only ids
and digests are grouped; payloads are shuffled once, by range.

Edge cases: a null or empty payload is an empty payload (all empty ones are equal). A
null url becomes ``about:blank``. A row whose page id is null, or equals the response's, is a response; rows
without an id are spread over shards of their own. Repeated
rows are written as often as they occur. An empty table has an empty manifest.
Extra columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import materialize, shared_dir

DATE = "2024-01-01T00:00:00Z"
HTTP = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {}\r\n\r\n"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
REPORT = "file string, records long, bytes long, sha256 string"
PER_SHARD = 32  # sampled ids


def sha1(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def record_id(key: object) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'page:{key}')}>"


def record(key: int | None, url: str | None, payload: bytes, refers: int | None) -> bytes:
    """One WARC/1.1 record; a revisit keeps the HTTP headers and leaves the payload out."""
    http = HTTP.format(len(payload)).encode()
    block = http if refers is not None else http + payload
    uri = re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url or "about:blank")
    head = ["WARC/1.1", f"WARC-Type: {'response' if refers is None else 'revisit'}", f"WARC-Record-ID: {record_id(key)}", f"WARC-Date: {DATE}", f"WARC-Target-URI: {uri}", f"WARC-Payload-Digest: sha1:{sha1(payload)}", f"WARC-Block-Digest: sha1:{sha1(block)}"]
    head += [] if key is None else [f"WARC-Page-ID: {key}"]
    head += [] if refers is None else [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: {record_id(refers)}", f"WARC-Refers-To-Page-ID: {refers}"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def member(data: bytes, level: int) -> bytes:
    """A gzip member without a time stamp."""
    z = zlib.compressobj(level, zlib.DEFLATED, 31)
    return z.compress(data) + z.flush()


def open_store(uri: str):
    """(file system, path) of a folder that driver and executors share."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(re.sub(r"^file:/(?!/)", "file:///", uri))


def revisits(pages: DataFrame, min_bytes: int, payload: str, key: str) -> DataFrame:
    """(page, digest, refers) of every row that revisits another; digest is the payload's SHA-1 in hex."""
    body = F.coalesce(F.col(payload), F.lit("")).cast("binary")
    ids = pages.select(F.col(key).alias("page"), F.sha1(body).alias("digest"), F.length(body).alias("size")).where(F.col("page").isNotNull() & (F.col("size") >= min_bytes))
    last = ids.groupBy("digest").agg(F.max("page").alias("refers"), F.count("*").alias("n")).where("n > 1").select(F.col("digest").alias("d"), "refers")
    return ids.join(last, F.col("digest") == F.col("d")).where("page <> refers").select("page", "digest", "refers").distinct()


def cuts(pages: DataFrame, key: str, shards: int, rows: int) -> list[int]:
    """The first ids of all shards but one: every PER_SHARD-th id of a sample in order, about one a shard.

    The places of sampled ids come from the sizes of sorted parts, so no task and not the driver holds the sample.
    """
    if shards < 2:
        return []
    every = max(1, rows // (PER_SHARD * shards))
    ids = pages.select(F.col(key).cast("long").alias("page")).where(F.col(key).isNotNull() & (F.pmod(F.xxhash64(key), F.lit(every)) == 0)).distinct()
    parts = max(1, min(shards, 256))
    ordered = materialize(ids.repartitionByRange(parts, "page").select("page", F.spark_partition_id().alias("part")))
    sizes = {r["part"]: r["n"] for r in ordered.groupBy("part").agg(F.count("*").alias("n")).collect()}  # a few hundred
    before, at = [], 0
    for part in range(max(sizes, default=0) + 1):
        before.append(at)
        at += sizes.get(part, 0)
    place = F.element_at(F.array(*[F.lit(b) for b in before]), F.col("part") + 1) + F.row_number().over(W.partitionBy("part").orderBy("page")) - 1
    found = ordered.withColumn("place", place).where((F.col("place") > 0) & (F.col("place") % PER_SHARD == 0))
    return sorted(found.select("page").toArrow()["page"].to_pylist())


def write(pages: DataFrame, folder: str, payload: str = "html", key: str = "page_id", url: str = "url", min_bytes: int = 0, shard_bytes: int = 256 << 20, roll_bytes: int = 16 << 20, level: int = 6) -> DataFrame:
    """Write the archive; the manifest's rows (file, records, bytes, sha256)."""
    spark = pages.sparkSession
    stat = pages.agg(F.count("*").alias("n"), F.sum(F.octet_length(payload)).alias("b"), F.sum(F.when(F.col(key).isNull(), F.octet_length(payload))).alias("u")).first()
    shards = max(1, -(-(stat["b"] or 0) // shard_bytes))
    bounds = np.array(cuts(pages, key, shards, stat["n"]), np.int64)
    unnamed = max(1, -(-(stat["u"] or 0) // shard_bytes))

    @F.pandas_udf("int")
    def shard(k: pd.Series) -> pd.Series:
        return pd.Series(np.searchsorted(bounds, k.to_numpy(np.int64), side="right").astype(np.int32))

    body = F.coalesce(F.col(payload), F.lit(""))
    # Rows without an id have shards below zero. Shards are dealt by range, so a task gets one of them or neighbours.
    part = F.when(F.col("page").isNull(), -1 - F.pmod(F.xxhash64("url", "payload"), F.lit(unnamed)).cast("int")).otherwise(shard(F.coalesce("page", F.lit(0))))
    rows = pages.select(F.col(key).cast("long").alias("page"), F.lit(1).alias("kind"), F.col(url).alias("url"), body.alias("payload"), F.lit(None).cast("long").alias("refers"))
    notes = revisits(pages, min_bytes, payload, key).select(F.col("page").cast("long"), F.lit(0), "digest", F.lit(None).cast("string"), F.col("refers").cast("long"))
    everything = rows.union(notes).withColumn("shard", part)
    ordered = everything.repartitionByRange(len(bounds) + 1 + unnamed, "shard").sortWithinPartitions("shard", F.col("page").asc_nulls_first(), "kind", "url", "payload")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = open_store(folder)
        done, out, now, noted, notes = [], None, None, None, {}
        for batch in batches:
            for page, kind, uri, data, refers, part in zip(*(c.to_pylist() for c in batch.columns)):
                if out is None or part != now or out.size >= roll_bytes:
                    done += [out.close()] if out else []
                    out = Roll(store, root, part, 0 if out is None or part != now else out.number + 1)
                    now = part
                if kind == 0:
                    noted, notes = page, {**(notes if noted == page else {}), uri: refers}
                else:
                    data = data.encode("utf-8", "replace")
                    again = notes.get(hashlib.sha1(data).hexdigest()) if page is not None and noted == page else None
                    out.add(member(record(page, uri, data, again), level))
        done += [out.close()] if out else []
        yield pa.RecordBatch.from_pylist([d for d in done if d], schema=pa.schema([("file", pa.string()), ("records", pa.int64()), ("bytes", pa.int64()), ("sha256", pa.string())]))

    store, root = open_store(folder)
    store.create_dir(root, recursive=True)
    ordered.mapInArrow(run, REPORT).write.parquet(f"{folder}/manifest.tmp")
    store.move(f"{root}/manifest.tmp", f"{root}/manifest")
    return manifest(spark, folder)


def manifest(spark: SparkSession, folder: str) -> DataFrame:
    """One row per file of a complete archive."""
    return spark.read.schema(REPORT).parquet(f"{folder}/manifest")


class Roll:
    """A file in the making: written under a name of its own, renamed on close."""

    def __init__(self, store, root: str, part: int, number: int):
        self.store, self.number, self.size, self.records = store, number, 0, 0
        self.name = f"{'part' if part >= 0 else 'unnamed'}-{part if part >= 0 else -part - 1:06d}-{number:04d}.warc.gz"
        self.target, self.own = f"{root}/{self.name}", f"{root}/.{self.name}.{uuid.uuid4().hex}.tmp"
        self.sink, self.sha = store.open_output_stream(self.own, compression=None), hashlib.sha256()

    def add(self, data: bytes) -> None:
        self.sink.write(data)
        self.sha.update(data)
        self.size += len(data)
        self.records += 1

    def close(self) -> dict | None:
        self.sink.close()
        if not self.records:
            self.store.delete_file(self.own)
            return None
        self.store.move(self.own, self.target)
        return {"file": self.name, "records": self.records, "bytes": self.size, "sha256": self.sha.hexdigest()}


def parse(stream) -> Iterator[tuple[dict, bytes]]:
    """(headers, block) of every record of a file that is read in order."""
    z, buffer, rest = zlib.decompressobj(31), bytearray(), b""
    while True:
        data = rest or stream.read(1 << 20)
        if not data:
            break
        buffer += z.decompress(data)
        rest = z.unused_data
        if z.eof:
            yield split(bytes(buffer))
            z, buffer = zlib.decompressobj(31), bytearray()
    if buffer:
        raise ValueError("the file ends inside a record")


def split(data: bytes) -> tuple[dict, bytes]:
    head, _, rest = data.partition(b"\r\n\r\n")
    first, *lines = head.decode().split("\r\n")
    if first != "WARC/1.1":
        raise ValueError("not a WARC record")
    headers = dict(line.split(": ", 1) for line in lines)
    return headers, rest[: int(headers["Content-Length"])]


def read(spark: SparkSession, folder: str) -> DataFrame:
    """(page_id, payload_bytes, payload_digest, record_type, refers_to, url) of every record that the manifest lists.

    Digests are recomputed: of the block always, of the payload where it is stored.
    """
    schema = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, url string"
    files = manifest(spark, folder).select("file")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, base = open_store(folder)
        names = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url"]
        kinds = pa.schema(list(zip(names, [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string()])))
        for batch in batches:
            for name in batch.column(0).to_pylist():
                rows = []
                with at.open_input_stream(f"{base}/{name}", compression=None) as f:
                    for head, block in parse(f):
                        rows.append(check(head, block))
                        if len(rows) == 4096:
                            yield pa.RecordBatch.from_pylist(rows, schema=kinds)
                            rows = []
                yield pa.RecordBatch.from_pylist(rows, schema=kinds)

    return files.repartition(max(1, files.count())).mapInArrow(run, schema)


def check(head: dict, block: bytes) -> dict:
    if head["WARC-Block-Digest"] != f"sha1:{sha1(block)}":
        raise ValueError(f"block digest of {head['WARC-Record-ID']}")
    http, _, payload = block.partition(b"\r\n\r\n")
    size = int(re.search(rb"Content-Length: (\d+)", http)[1])
    digest = head["WARC-Payload-Digest"].removeprefix("sha1:")
    if head["WARC-Type"] == "response" and (len(payload), sha1(payload)) != (size, digest):
        raise ValueError(f"payload of {head['WARC-Record-ID']}")
    number = lambda k: int(head[k]) if k in head else None
    return {"page_id": number("WARC-Page-ID"), "payload_bytes": size, "payload_digest": digest, "record_type": head["WARC-Type"], "refers_to": number("WARC-Refers-To-Page-ID"), "url": head["WARC-Target-URI"]}


def round_trip(pages: DataFrame, min_bytes: int = 0, shard_bytes: int = 16 << 20, roll_bytes: int = 2 << 20) -> DataFrame:
    """op7: write the archive to the shared folder, read it back."""
    folder = shared_dir(pages.sparkSession)
    write(pages, folder, min_bytes=min_bytes, shard_bytes=shard_bytes, roll_bytes=roll_bytes)
    return read(pages.sparkSession, folder).drop("url")


__all__ = ["manifest", "parse", "read", "record", "round_trip", "write"]

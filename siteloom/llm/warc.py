"""Deterministic sharded WARC archives, and their reader.

Records are sorted by page id over shards whose bounds come from the data alone: a hash sample
of about ``SAMPLE`` keys (the documented bound) weighted by stored bytes. So the same rows
give the same files, bit for bit, whatever the cluster and however often a task runs. A file
is rolled once it has ``roll_bytes`` compressed bytes. Every record is one gzip member with headers
and digests made anew from the payload.

Of records with equal payloads of ``min_revisit`` bytes or more, the one of the smallest page id
(then of the first URL) holds it; the others are revisits and leave their payload
before the shuffle. Copies are found by a map-side minimum per digest.

A task writes under a temporary name and renames a finished file; a task that runs again writes
the same bytes to the same name. The manifest is written last, by Spark's committer, and readers
take only files it lists, with their sizes and digests. Executors reach the folder through Arrow's
file systems (local or shared paths, and those it was built for).

A null payload is empty. A null page id comes first and is read back as null; repeated rows are kept, one
as response. Null URLs are written as ``urn:none``. Other columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from siteloom.scale import lookup_join, written

SAMPLE = 20_000
SHARD_BYTES = 64 << 20
ROLL_BYTES = 16 << 20
#: Small jobs are dealt over this many shards, of so many bytes at least.
LEAST_SHARDS, LEAST_BYTES = 32, 64 << 10
RECORD_BYTES = 600
DATE = "1970-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
MANIFEST = "_manifest"
FILES = "file string, shard bigint, records bigint, bytes bigint, sha256 string"


def file_system(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path)


def base32_sha1(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def record_id(page_id: int | None, key: str, turn: int = 0) -> str:
    return f"<urn:uuid:{uuid.UUID(bytes=hashlib.sha256(f'{page_id}|{key}|{turn}'.encode()).digest()[:16], version=4)}>"


def safe(url: str | None) -> str:
    """A header value: control characters and spaces are percent-encoded."""
    return "".join(c if " " < c != "\x7f" else "".join(f"%{b:02X}" for b in c.encode()) for c in url) if url else "urn:none"


def record(headers: list[tuple[str, str]], block: bytes) -> bytes:
    """One gzip member; its header has no time, so equal records are equal bytes."""
    lines = [*headers, ("WARC-Block-Digest", "sha1:" + base32_sha1(block)), ("Content-Length", str(len(block)))]
    head = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in lines) + "\r\n"
    packer = zlib.compressobj(6, zlib.DEFLATED, 31)
    return packer.compress(head.encode()) + packer.compress(block) + packer.compress(b"\r\n\r\n") + packer.flush()


def page_record(row: dict, turn: int) -> bytes:
    """A response (first of its payload) or a revisit."""
    page, key, size, digest = row["page_id"], row["key"], row["size"], row["digest"]
    digest = base64.b32encode(bytes.fromhex(digest)).decode()
    response = row["payload"] is not None and turn == 0
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode()
    headers = [("WARC-Type", "response" if response else "revisit"), ("WARC-Record-ID", record_id(page, key, turn)),
               ("WARC-Target-URI", safe(row["url"])), ("WARC-Date", DATE), ("WARC-Payload-Digest", f"sha1:{digest}"),
               ("Content-Type", "application/http; msgtype=response"), ("X-Payload-Length", str(size))]
    if page is not None:
        headers.append(("X-Page-Id", str(page)))
    if not response:
        headers += [("WARC-Profile", PROFILE), ("WARC-Refers-To", record_id(row["leader"], key))]
        if row["leader"] is not None:
            headers.append(("X-Refers-To-Page-Id", str(row["leader"])))
    return record(headers, http + (row["payload"] if response else b""))


class Roller:
    """The open file of one shard; closed files are renamed and reported."""

    def __init__(self, path: str, roll_bytes: int):
        self.fs, self.base = file_system(path)
        self.roll = roll_bytes
        self.tmp = f"{self.base}/_temporary/{uuid.uuid4().hex}"
        self.fs.create_dir(self.tmp)
        self.shard, self.number, self.out = None, 0, None

    def put(self, shard: int, data: bytes) -> Iterator[dict]:
        if shard != self.shard:
            yield from self.close()
            self.shard, self.number = shard, 0
        if self.out is None:
            self.name = f"part-{shard:07d}-{self.number:05d}.warc.gz"
            self.out = self.fs.open_output_stream(f"{self.tmp}/{self.name}", compression=None)
            self.sha, self.bytes, self.records = hashlib.sha256(), 0, 0
            self.add(record([("WARC-Type", "warcinfo"), ("WARC-Record-ID", record_id(None, self.name)), ("WARC-Date", DATE),
                             ("WARC-Filename", self.name), ("Content-Type", "application/warc-fields")],
                            b"format: WARC File Format 1.1\r\n"))
        self.add(data)
        self.records += 1
        if self.bytes >= self.roll:
            yield from self.close()

    def add(self, data: bytes) -> None:
        self.out.write(data)
        self.sha.update(data)
        self.bytes += len(data)

    def close(self) -> Iterator[dict]:
        if self.out is not None:
            self.out.close()
            self.out = None
            final = f"{self.base}/{self.name}"
            try:
                self.fs.move(f"{self.tmp}/{self.name}", final)
            except OSError:  # some file systems don't replace; the bytes there are the same
                self.fs.delete_file(final)
                self.fs.move(f"{self.tmp}/{self.name}", final)
            yield {"file": self.name, "shard": self.shard, "records": self.records, "bytes": self.bytes, "sha256": self.sha.hexdigest()}
            self.number += 1


def sampled_keys(rows: DataFrame, count: int) -> DataFrame:
    """A hash sample of about ``SAMPLE`` keys (page_id, spread), one row each with all its stored bytes, however
    many of the ``count`` rows are equal."""
    step = max(1, count // SAMPLE)
    return (rows.filter(F.pmod(F.xxhash64("page_id", "spread"), F.lit(step)) == 0)
            .groupBy("page_id", "spread").agg(F.sum("stored").alias("stored")))


def shard_of(rows: DataFrame, total: int, count: int, shard_bytes: int) -> tuple[Column, int]:
    """The shard of a row by bounds on (page_id, spread) that cut the sampled bytes evenly, and how many there are."""
    shards = max(-(-total // shard_bytes), min(LEAST_SHARDS, -(-total // LEAST_BYTES)), 1)
    sample = sampled_keys(rows, count).toPandas().sort_values(["page_id", "spread"], kind="stable")
    weight = sample["stored"].to_numpy().cumsum()
    wanted = np.arange(1, shards) * (weight[-1] / shards) if len(weight) else np.zeros(0)
    at = np.unique(np.searchsorted(weight, wanted, side="right")) if len(weight) else np.zeros(0, dtype=int)
    at = at[at < len(sample)]
    ids, spreads = sample["page_id"].to_numpy(dtype=np.int64)[at], sample["spread"].to_numpy(dtype=np.int64)[at]

    @F.pandas_udf("int")
    def place(page_id: pd.Series, spread: pd.Series) -> pd.Series:
        page, own = page_id.to_numpy(dtype=np.int64), spread.to_numpy(dtype=np.int64)
        low, high = np.searchsorted(ids, page, "left"), np.searchsorted(ids, page, "right")
        for i in np.unique(low[high > low]):
            mine = (low == i) & (high > low)
            top = high[mine][0]
            low[mine] = i + np.searchsorted(spreads[i:top], own[mine], "right")
        return pd.Series(low.astype(np.int32))

    return place("page_id", "spread"), len(at) + 1


def write_archive(pages: DataFrame, path: str, min_revisit: int = 0, shard_bytes: int = SHARD_BYTES,
                  roll_bytes: int = ROLL_BYTES, page_id: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """Write all rows below ``path`` and return the manifest: file, shard, records, bytes, sha256."""
    payload = F.coalesce(F.col(html).cast("binary"), F.lit("").cast("binary"))
    rows = pages.select(F.col(page_id).cast("bigint").alias("page"), F.col(url).cast("string").alias("url"), payload.alias("payload")
                        ).withColumns({"size": F.octet_length("payload").cast("bigint"), "digest": F.sha1("payload"),
                                       "key": F.sha2("payload", 256)})
    # Sizes and digests are worked out once and written; only the last pass below reads the payloads again.
    heads = written(rows.drop("payload"), "heads")
    copies = written(heads.filter(F.col("size") >= min_revisit).groupBy("key").agg(
        F.min("page").alias("leader"), F.count(F.lit(1)).alias("n")).filter("n > 1").select("key", "leader", F.lit(True).alias("copied")), "copies")
    first = F.col("copied").isNull() | F.col("page").eqNullSafe(F.col("leader"))

    def keyed(df: DataFrame) -> DataFrame:
        return lookup_join(df, copies, ["key"], "left").withColumns({
            "page_id": F.coalesce("page", F.lit(-(1 << 63))), "spread": F.xxhash64("key"),
            "stored": F.when(first, F.col("size")).otherwise(0) + RECORD_BYTES})

    places = keyed(heads).select("page_id", "spread", "stored")
    whole = places.agg(F.sum("stored").alias("total"), F.count(F.lit(1)).alias("count")).first()
    shard, shards = shard_of(places, whole["total"] or 0, whole["count"], shard_bytes)
    dealt = keyed(rows).select(
        "page", "url", "size", "digest", "key", F.when(first, F.col("payload")).alias("payload"),
        F.when(F.col("copied"), F.col("leader")).otherwise(F.col("page")).alias("leader"), F.col("copied").isNotNull().alias("copied"),
        "page_id", "spread").withColumn("shard", shard)
    fields = ["shard", "page", "url", "size", "digest", "key", "payload", "leader", "copied"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        roller, last, turn = Roller(path, roll_bytes), None, 0
        for batch in batches:
            done = []
            for i in range(batch.num_rows):
                row = {f: batch.column(j)[i].as_py() for j, f in enumerate(fields)}
                row["page_id"] = row["page"]
                same = last == (row["page"], row["key"]) and row["copied"]
                turn, last = turn + 1 if same else 0, (row["page"], row["key"])
                done += roller.put(row["shard"], page_record(row, turn))
            if done:
                yield pa.RecordBatch.from_pylist(done, schema=schema)
        if done := list(roller.close()):
            yield pa.RecordBatch.from_pylist(done, schema=schema)
        roller.fs.delete_dir(roller.tmp)

    schema = pa.schema([("file", pa.string()), ("shard", pa.int64()), ("records", pa.int64()), ("bytes", pa.int64()), ("sha256", pa.string())])
    ordered = (dealt.select(*fields, "page_id", "spread").repartitionById(shards, "shard")
               .sortWithinPartitions("shard", "page_id", "spread", "key", "url").select(*fields))
    ordered.mapInArrow(run, FILES).write.parquet(f"{path}/{MANIFEST}")
    return pages.sparkSession.read.schema(FILES).parquet(f"{path}/{MANIFEST}")


def members(stream, size: int = 1 << 20) -> Iterator[bytes]:
    """The gzip members of a file, one at a time."""
    data, reader, parts = b"", zlib.decompressobj(31), []
    while True:
        if not data and not (data := stream.read(size)):
            break
        parts.append(reader.decompress(data))
        data = b""
        if reader.eof:
            yield b"".join(parts)
            data, reader, parts = reader.unused_data, zlib.decompressobj(31), []
    if any(parts):
        raise ValueError("an archive ends within a record")


def parsed(member: bytes) -> tuple[dict[str, str], bytes]:
    head, _, rest = member.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    headers = dict(line.split(": ", 1) for line in lines[1:])
    block = rest[:int(headers["Content-Length"])]
    if lines[0] != "WARC/1.1" or rest[len(block):] != b"\r\n\r\n" or headers["WARC-Block-Digest"] != "sha1:" + base32_sha1(block):
        raise ValueError("a record is damaged")
    return headers, block


def read_archive(spark: SparkSession, path: str, with_payload: bool = True) -> DataFrame:
    """The records of all files in the manifest: page_id, url, payload_bytes, payload_digest, record_type,
    refers_to and, if asked for, payload (null for revisits). Digests and lengths are checked."""
    files = spark.read.schema(FILES).parquet(f"{path}/{MANIFEST}")
    named = [("page_id", pa.int64()), ("url", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()),
             ("record_type", pa.string()), ("refers_to", pa.int64())]
    schema = pa.schema(named + [("payload", pa.binary())] * with_payload)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = file_system(path)
        for name in (n for b in batches for n in b.column(0).to_pylist()):
            out, held = [], 0
            with fs.open_input_stream(f"{base}/{name}", compression=None) as stream:
                for member in members(stream):
                    headers, block = parsed(member)
                    if headers["WARC-Type"] == "warcinfo":
                        continue
                    payload = block.partition(b"\r\n\r\n")[2]
                    digest, response = headers["WARC-Payload-Digest"].removeprefix("sha1:"), headers["WARC-Type"] == "response"
                    size = int(headers["X-Payload-Length"])
                    if response and (len(payload) != size or base32_sha1(payload) != digest):
                        raise ValueError("a payload is damaged")
                    number = lambda k: int(headers[k]) if k in headers else None  # noqa: B023,E731
                    out.append({"page_id": number("X-Page-Id"), "url": headers["WARC-Target-URI"], "payload_bytes": size,
                                "payload_digest": digest, "record_type": headers["WARC-Type"],
                                "refers_to": number("X-Refers-To-Page-Id"), "payload": payload if response else None})
                    held += len(block)
                    if held > 1 << 20 or len(out) >= 1000:
                        yield pa.RecordBatch.from_pylist(out, schema=schema)
                        out, held = [], 0
            if out:
                yield pa.RecordBatch.from_pylist(out, schema=schema)

    count = files.count()
    kinds = "page_id bigint, url string, payload_bytes bigint, payload_digest string, record_type string, refers_to bigint"
    return files.select("file").repartition(max(1, min(count, 10_000)), "file").mapInArrow(
        run, kinds + (", payload binary" if with_payload else ""))

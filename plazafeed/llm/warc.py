"""WARC archives: a deterministic sharded writer and a streaming reader.

Records are range-sorted by page id, then payload. A shard is as many records in this order
as have a given number of bytes, counted from the first record on, so its records and bytes
depend on the rows alone: not on partitions, sampling or retries. Every record is a gzip member of its own with headers and digests made anew; a file
is closed once its compressed size passes the limit. Files are written under names of the
task attempt and renamed; the manifest, a table that Spark's own committer publishes in one
step, lists what belongs to the archive, and the reader opens nothing else.
"""

from __future__ import annotations

import base64
import hashlib
import os
import uuid
import zlib
from collections.abc import Iterator
from datetime import datetime, timezone

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import ranges
from .common import n_partitions, stage, text_or_empty

MANIFEST = "first_page long, last_page long, file string, n_records long, n_bytes long, sha256 string"
RECORDS = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, payload binary"


def _qualified(spark: SparkSession, root: str) -> str:
    """``root`` with the scheme that Spark takes for it, so that records and manifest lie in one file system.

    A path on a local disk is refused where tasks run on other machines, unless it is inside the folder that they share.
    """
    path = spark._jvm.org.apache.hadoop.fs.Path(root)
    whole = path.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(path).toString()
    if whole.startswith("file:"):
        plain = lambda x: "/" + x.removeprefix("file:").strip("/")
        shared, whole = spark.conf.get("spark.checkpoint.dir", None), plain(whole)
        if not spark.sparkContext.master.startswith("local") and not (shared and whole.startswith(f"{plain(shared)}/")):
            raise ValueError(f"{root} is on a local disk; name a folder that driver and executors share")
        return f"file://{whole}"
    return whole


def _open(uri: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(uri if ":/" in uri else f"file://{os.path.abspath(uri)}")


def _record(page: int | None, url: str, payload: bytes, digest: str, refers_to: int | None, date: str) -> bytes:
    """One record's bytes. ``refers_to``: the page whose response holds this payload; such a revisit has no block."""
    sha = base64.b32encode(bytes.fromhex(digest)).decode()
    rid = lambda p: uuid.uuid5(uuid.NAMESPACE_URL, f"page:{p}:{digest}").urn
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http if refers_to is not None else http + payload
    head = {
        "WARC-Type": "response" if refers_to is None else "revisit", "WARC-Record-ID": f"<{rid(page)}>", "WARC-Date": date,
        "WARC-Target-URI": url.replace("\r", "%0D").replace("\n", "%0A"), "WARC-Payload-Digest": f"sha1:{sha}",
        "WARC-Block-Digest": "sha1:" + base64.b32encode(hashlib.sha1(block).digest()).decode(), "Content-Type": "application/http; msgtype=response",
    }
    if refers_to is not None:
        head |= {"WARC-Profile": "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", "WARC-Refers-To": f"<{rid(refers_to)}>", "X-Refers-To-Page": str(refers_to)}
    head |= {"X-Page-Id": "" if page is None else str(page), "X-Payload-Length": str(len(payload)), "Content-Length": str(len(block))}
    return b"WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in head.items()).encode() + b"\r\n" + block + b"\r\n\r\n"


def _gzip(data: bytes, level: int) -> bytes:
    z = zlib.compressobj(level, zlib.DEFLATED, 31)  # no time or name in the header: equal rows, equal bytes
    return z.compress(data) + z.flush()


class _Shard:
    """The files of one task attempt."""

    def __init__(self, root: str, roll_bytes: int, level: int):
        self.fs, self.root = _open(root)
        self.attempt, self.roll, self.level, self.out, self.done = f"{self.root}/_temporary/{uuid.uuid4().hex}", roll_bytes, level, None, []

    def add(self, page: int | None, record: bytes) -> None:
        if self.out is None:
            self.fs.create_dir(self.attempt, recursive=True)
            self.first, self.n, self.size, self.sha = page, 0, 0, hashlib.sha256()
            self.out = self.fs.open_output_stream(f"{self.attempt}/open")
        data = _gzip(record, self.level)
        self.out.write(data)
        self.sha.update(data)
        self.n, self.size, self.last = self.n + 1, self.size + len(data), page
        if self.size >= self.roll:
            self.close()

    def close(self) -> None:
        """Publish the open file under a name that its contents give: a repeated task renames onto the same."""
        if self.out is not None:
            self.out.close()
            name = f"pages-{-1 if self.first is None else self.first:020d}-{self.sha.hexdigest()[:16]}.warc.gz"
            self.fs.move(f"{self.attempt}/open", f"{self.root}/{name}")
            self.done.append((self.first, self.last, name, self.n, self.size, self.sha.hexdigest()))
            self.out = None


def write_archive(pages: DataFrame, root: str, min_revisit_bytes: int = 1000, roll_bytes: int = 4 << 20, level: int = 6, as_of: datetime = datetime(2024, 1, 31, tzinfo=timezone.utc), shard_bytes: int = 64 << 20) -> DataFrame:
    """Write one record per row of ``pages(page_id, url, html)`` under ``root``; returns the manifest.

    Of records with equal payloads of at least ``min_revisit_bytes`` that with the largest
    page_id is the response and the others revisit it; of rows with that same page_id the
    first written is the response. Rows without page_id are responses, as nothing could
    name them; they come first, by url and payload, in as many shards as they need. A null
    html or url is empty; repeated rows are records of their own; an empty table gives an
    empty manifest. A shard takes about ``shard_bytes`` of payload, which one task writes, and
    rolls its file once its compressed size passes ``roll_bytes``. The html itself is shuffled once: a row for each
    revisit is sorted in just before its page. Files that lost attempts left unfinished go at the end.
    """
    spark = pages.sparkSession
    root = _qualified(spark, root)
    src = pages.select(F.col("page_id").cast("long"), text_or_empty("url").alias("url"), text_or_empty("html").alias("html"))
    src = src.withColumn("digest", F.sha1(F.col("html").cast("binary")))
    #: Rows of one page and payload stay together; rows without page_id are spread by all they have.
    of_digest = F.conv(F.substring("digest", 1, 15), 16, 10).cast("long")
    tied = src.withColumn("tie", F.when(F.col("page_id").isNull(), F.xxhash64("url", "digest")).otherwise(of_digest))
    light = stage(tied.select("page_id", "tie", "digest", (F.octet_length("html").cast("long") + F.octet_length("url") + 500).alias("size"), (F.octet_length("html") >= min_revisit_bytes).alias("large")), "warc-digests")
    named = light.where("large and page_id is not null").select("page_id", "tie", "digest")
    last = named.groupBy("digest").agg(F.max("page_id").alias("target"), F.count("*").alias("n")).where("n > 1").drop("n")
    marks = named.join(last, "digest").select("page_id", "tie", F.lit(None).cast("string").alias("url"), F.col("digest").alias("html"), "target", F.lit(0).alias("is_page")).distinct()
    rows = tied.select("page_id", "tie", "url", "html", F.lit(None).cast("long").alias("target"), F.lit(1).alias("is_page")).union(marks)
    shards = spark.sparkContext.broadcast(ranges.cut(light.select(F.col("page_id").alias("key"), "tie", "size"), shard_bytes))

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array(shards.value.of(b.column(0), b.column(1).to_numpy())), *b.columns], names=["shard", *b.schema.names])

    dealt = rows.mapInArrow(deal, "shard long, page_id long, tie long, url string, html string, target long, is_page int")
    ordered = dealt.repartition(max(n_partitions(spark), 1), "shard").sortWithinPartitions("shard", F.col("page_id").asc_nulls_first(), "tie", "is_page", "url", "html").drop("tie")
    date = as_of.strftime("%Y-%m-%dT%H:%M:%SZ")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, now, at, targets, used = _Shard(root, roll_bytes, level), None, None, {}, set()
        for b in batches:
            for shard, page, url, html, target, is_page in zip(*(c.to_pylist() for c in b.columns)):
                if shard != now:
                    out.close()
                    now = shard
                if page != at:
                    at, targets, used = page, {}, set()
                if not is_page:
                    targets[html] = target
                    continue
                payload = html.encode("utf-8", "replace")
                digest = hashlib.sha1(payload).hexdigest()
                to = targets.get(digest)
                if to == page and page is not None and digest not in used:
                    to = None
                    used.add(digest)
                out.add(page, _record(page, url, payload, digest, to, date))
        out.close()
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out.done) if out.done else [()] * 6, (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string()))], names=["first_page", "last_page", "file", "n_records", "n_bytes", "sha256"])

    ordered.mapInArrow(run, MANIFEST).write.parquet(f"{root}/_manifest")
    store, base = _open(root)
    if store.get_file_info(f"{base}/_temporary").type == pafs.FileType.Directory:
        store.delete_dir(f"{base}/_temporary")
    return read_manifest(spark, root)


def read_manifest(spark: SparkSession, root: str) -> DataFrame:
    return spark.read.schema(MANIFEST).parquet(f"{root}/_manifest")


def _members(stream, block: int = 1 << 20) -> Iterator[bytes]:
    """The records of one file: one gzip member at a time."""
    z, parts, data = zlib.decompressobj(31), [], stream.read(block)
    while data:
        parts.append(z.decompress(data))
        if z.eof:
            yield b"".join(parts)
            data, z, parts = z.unused_data, zlib.decompressobj(31), []
            if data:
                continue
        data = stream.read(block)
    if parts:
        raise ValueError("the file ends inside a record")


def read_archive(spark: SparkSession, root: str, payload: bool = True) -> DataFrame:
    """The records of the files that the manifest names; digests and lengths are checked, a mismatch raises.

    One row per record: page_id null where it was, an empty payload where the html was null
    or empty, payload null for revisits (and for all, without ``payload``). An empty archive gives an empty table.
    """

    root = _qualified(spark, root)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, base = _open(root)
        for b in batches:
            for name in b.column(0).to_pylist():
                rows, held = [], 0
                with store.open_input_stream(f"{base}/{name}", compression=None) as f:
                    for data in _members(f):
                        rows.append(_parse(data, payload))
                        held += len(data)
                        if held > 8 << 20:
                            yield _batch(rows)
                            rows, held = [], 0
                yield _batch(rows)

    files = read_manifest(spark, root).select("file")
    return files.repartition(max(n_partitions(spark), 1), "file").mapInArrow(run, RECORDS)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.binary())
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows) if rows else [()] * 7, kinds)], names=["page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to", "payload"])


def _parse(data: bytes, keep: bool) -> tuple:
    top, _, rest = data.partition(b"\r\n\r\n")
    head = dict(line.split(": ", 1) if ": " in line else (line.rstrip(":"), "") for line in top.decode().split("\r\n")[1:])
    block = rest[: int(head["Content-Length"])]
    if "sha1:" + base64.b32encode(hashlib.sha1(block).digest()).decode() != head["WARC-Block-Digest"]:
        raise ValueError(f"block digest of page {head['X-Page-Id']} differs")
    kind, digest = head["WARC-Type"], base64.b32decode(head["WARC-Payload-Digest"][5:]).hex()
    payload = block.partition(b"\r\n\r\n")[2] if kind == "response" else None
    if payload is not None and (hashlib.sha1(payload).hexdigest() != digest or len(payload) != int(head["X-Payload-Length"])):
        raise ValueError(f"payload of page {head['X-Page-Id']} differs")
    page, to = head["X-Page-Id"], head.get("X-Refers-To-Page")
    return int(page) if page else None, head["WARC-Target-URI"], int(head["X-Payload-Length"]), digest, kind, int(to) if to else None, payload if keep else None

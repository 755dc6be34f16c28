"""WARC archives with revisit resolution.

Headers (page_id, payload digest, payload length, url) are shuffled by digest, without payloads; of equal payloads of at
least LEAST_BYTES the record with the largest page_id is the original, the others become revisit records that name it.
While the repeated digests take few bytes, counted before, they are broadcast and payloads stay where they were read.
Beyond that, headers join the originals by digest, hot digests split, and give the revisits, one row each; pages that a
fixed-size bitmap shows not to be among these are written where they were read, and only the others are joined, by
page_id and digest, which no digest makes hot. Archives are written with fresh headers, a gzip member for each record, into the
shared folder: a file is moved to its name, which holds the task's attempt, when it is whole, and only files that a
finished task has listed count. Reading checks every payload against its digest.

Every record has an id of its own and the date of its writing; a revisit names its original by page_id, target and date.

Null html is an empty payload, a null url writes no target, line breaks in a url are percent-encoded. Rows that carry the
largest page_id of their payload are all originals, were that page_id repeated. A null page_id is written without one,
reads back as null, and is an original only if all page_ids of its payload are null. Empty tables give no archive and no
rows. A very long payload is one record, held whole by its task. Other columns are not read.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator
from datetime import UTC, datetime

import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import checkpointed, is_small, possibly_in, spread_join, temporary

LEAST_BYTES, FILE_BYTES, LEVEL, CHUNK = 1000, 16 << 20, 3, 1 << 14
# Fixed value: the profile of revisits by payload.
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
ROWS = "name string, page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, payload binary"


def base32(hexdigest: str) -> str:
    return "sha1:" + base64.b32encode(bytes.fromhex(hexdigest)).decode()


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None, refers_url: str | None, date: str) -> bytes:
    """One WARC/1.1 record as a gzip member."""
    revisit = refers_to is not None
    body = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=UTF-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    body += b"" if revisit else payload
    safe = lambda u: "".join(c if c > " " else f"%{ord(c):02X}" for c in u or "")
    fields = [("WARC-Type", "revisit" if revisit else "response"), ("WARC-Record-ID", f"<urn:uuid:{uuid.uuid4()}>"), ("WARC-Date", date)]
    fields += [("WARC-Target-URI", safe(url))] * (url is not None) + [("WARC-Page-ID", page_id)] * (page_id is not None)
    fields += [("WARC-Payload-Digest", base32(digest)), ("WARC-Payload-Length", len(payload)), ("WARC-Block-Digest", base32(hashlib.sha1(body).hexdigest()))]
    if revisit:
        fields += [("WARC-Profile", PROFILE), ("WARC-Refers-To-Page-ID", refers_to)]
        fields += [("WARC-Refers-To-Target-URI", safe(refers_url))] * (refers_url is not None) + [("WARC-Refers-To-Date", date)]
    fields += [("Content-Type", "application/http; msgtype=response"), ("Content-Length", len(body))]
    head = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields) + "\r\n"
    packer = zlib.compressobj(LEVEL, zlib.DEFLATED, 31)
    return packer.compress(head.encode() + body + b"\r\n\r\n") + packer.flush()


def members(data: bytes) -> Iterator[bytes]:
    """The unpacked gzip members of data, fed CHUNK bytes at a time: what a member leaves unused is less than that."""
    view, at = memoryview(data), 0
    while at < len(view):
        opener, out = zlib.decompressobj(31), []
        while not opener.eof:
            part = view[at : at + CHUNK]
            if not len(part):
                raise ValueError("a record is cut short")
            out.append(opener.decompress(part))
            at += len(part) - len(opener.unused_data)
        yield b"".join(out)


def parse(raw: bytes) -> dict:
    """Fields of one record, its payload checked against length and digest."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
    body = rest[: int(fields["Content-Length"])]
    if base32(hashlib.sha1(body).hexdigest()) != fields["WARC-Block-Digest"]:
        raise ValueError(f"block digest of {fields['WARC-Record-ID']}")
    number = lambda k: int(fields[k]) if k in fields else None
    out = {"page_id": number("WARC-Page-ID"), "url": fields.get("WARC-Target-URI"), "record_type": fields["WARC-Type"], "refers_to": number("WARC-Refers-To-Page-ID")}
    out |= {"payload_bytes": number("WARC-Payload-Length"), "payload_digest": base64.b32decode(fields["WARC-Payload-Digest"][5:]).hex(), "payload": None}
    if fields["WARC-Type"] == "response":
        out["payload"] = body.partition(b"\r\n\r\n")[2]
        if (len(out["payload"]), hashlib.sha1(out["payload"]).hexdigest()) != (out["payload_bytes"], out["payload_digest"]):
            raise ValueError(f"payload digest of {fields['WARC-Record-ID']}")
    return out


def with_originals(pages: DataFrame, most: int | None = None) -> DataFrame:
    """page_id, url, payload, digest, refers_to, refers_url: the last two null for responses. Over `most` bytes, as
    is_small counts them, the originals of repeated payloads are joined by headers."""
    p = pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), F.coalesce(F.col("html").cast("string"), F.lit("")).cast("binary").alias("payload"))
    p = p.withColumn("digest", F.sha1("payload")).withColumn("size", F.octet_length("payload"))
    header = p.where(F.col("size") >= LEAST_BYTES).select("digest", "page_id", "url")
    groups = header.groupBy("digest").agg(F.max("page_id").alias("original"), F.max_by("url", "page_id").alias("original_url"), F.count("*").alias("n"))
    groups = groups.where("n > 1 AND original IS NOT NULL")
    first = checkpointed(groups)
    kept = ["page_id", "url", "payload", "digest"]
    refers = [F.col("original").alias("refers_to"), F.col("original_url").alias("refers_url")]
    again = ~F.col("page_id").eqNullSafe(F.col("original"))
    if is_small(first, most):
        seen = p.join(F.broadcast(first), "digest", "left")
        revisit = F.col("original").isNotNull() & again & (F.col("size") >= LEAST_BYTES)
        return seen.select(*kept, *(F.when(revisit, c).alias(n) for c, n in zip(refers, ("refers_to", "refers_url"))))
    total = first.agg(F.sum("n")).first()[0] or 0
    headers = spread_join(header.select("digest", "page_id"), first, "digest", total, F.xxhash64("page_id")).where(again)
    key = lambda: F.xxhash64("page_id", "digest")
    revisits = checkpointed(headers.distinct().select(F.col("page_id").alias("who"), F.col("digest").alias("what"), *refers).withColumn("doc", F.xxhash64("who", "what")))
    split = possibly_in(p.withColumn("doc", key()), revisits.select(F.col("doc").alias("id")), mark=True)
    here = split.where("NOT possible").select(*kept, F.lit(None).cast("long").alias("refers_to"), F.lit(None).cast("string").alias("refers_url"))
    other = split.where("possible").join(revisits.drop("doc"), F.col("page_id").eqNullSafe(F.col("who")) & (F.col("digest") == F.col("what")), "left")
    return here.union(other.select(*kept, "refers_to", "refers_url"))


def write_archives(pages: DataFrame, folder: str) -> DataFrame:
    """Write pages (page_id, url, html) as deduplicated archives in folder; a row per file: name, records. Evaluate once."""
    date = datetime.now(UTC).strftime("%Y-%m-%dT%H:%M:%SZ")
    store, root = fs.FileSystem.from_uri(folder)
    store.create_dir(root, recursive=True)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, number, held, size = TaskContext.get(), 0, [], 0
        store, path = fs.FileSystem.from_uri(folder)

        def flush() -> pa.RecordBatch:
            name = f"{task.partitionId():06d}-{number:04d}-{task.taskAttemptId()}.warc.gz"
            draft = f"{path}/.{name}"
            with store.open_output_stream(draft, compression=None) as out:
                for x in held:
                    out.write(x)
            store.move(draft, f"{path}/{name}")
            return pa.RecordBatch.from_pydict({"name": [name], "records": [len(held)]})

        for b in batches:
            for i in range(b.num_rows):
                held.append(record(*(b.column(c)[i].as_py() for c in range(6)), date))
                size += len(held[-1])
                if size >= FILE_BYTES:
                    yield flush()
                    number, held, size = number + 1, [], 0
        if held:
            yield flush()

    return with_originals(pages).mapInArrow(run, "name string, records long")


def read_archives(spark: SparkSession, folder: str, payloads: bool = True) -> DataFrame:
    """A row per record in the archives of folder; payload is null for revisits and where payloads are not asked for."""
    names = [x.split()[0] for x in ROWS.split(", ")]
    types = [pa.string(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.binary()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def batch(rows: list[dict]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([r[n] for r in rows], t) for n, t in zip(names, types)], names)

        for b in batches:
            for name, data in zip(b.column(0).to_pylist(), b.column(1)):
                rows, size = [], 0
                for raw in members(data.as_buffer()):
                    rows.append(parse(raw) | {"name": name} | ({} if payloads else {"payload": None}))
                    size += len(raw) if payloads else 200
                    if size > FILE_BYTES:
                        yield batch(rows)
                        rows, size = [], 0
                if rows:
                    yield batch(rows)

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.warc.gz").load(folder)
    return files.select(F.element_at(F.split("path", "/"), -1).alias("name"), "content").mapInArrow(run, ROWS)


def resolve_revisits(records: DataFrame) -> DataFrame:
    """records with every revisit's payload taken from its original response, joined on digest and page_id."""
    r = records.alias("r")
    originals = records.where("record_type = 'response'").select(F.col("page_id").alias("original"), F.col("payload_digest").alias("d"), F.col("payload").alias("full")).dropDuplicates(["original", "d"])
    both = r.join(originals, (F.col("r.refers_to") == F.col("original")) & (F.col("r.payload_digest") == F.col("d")), "left")
    return both.select(*(F.coalesce("r.payload", "full").alias("payload") if c == "payload" else F.col(f"r.{c}") for c in records.columns))


def archive_round_trip(pages: DataFrame) -> DataFrame:
    """Write pages as archives in the shared folder and read them back: a row per page, without payloads."""
    spark = pages.sparkSession
    folder = temporary(spark, "warc")
    written = checkpointed(write_archives(pages, folder))
    kept = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]
    if not written.limit(1).count():
        return spark.createDataFrame([], ROWS).select(kept)
    return read_archives(spark, folder, payloads=False).join(written.select("name"), "name", "left_semi").select(kept)


ORACLE = """
SELECT page_id, strlen(coalesce(html, ''))::BIGINT AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest,
  CASE WHEN strlen(coalesce(html, '')) >= 1000 AND page_id IS DISTINCT FROM m AND m IS NOT NULL THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN strlen(coalesce(html, '')) >= 1000 AND page_id IS DISTINCT FROM m THEN m END AS refers_to
FROM (SELECT *, max(page_id) OVER (PARTITION BY coalesce(html, '')) AS m FROM pages)
"""

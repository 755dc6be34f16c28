"""JSON in any layout: one object a line, pretty-printed, one array, a single object; plain, gzip or inside ZIP members."""

from __future__ import annotations

import gzip
import io
import json
import re
import zipfile
from collections.abc import Iterator
from typing import BinaryIO

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .json_blocks import BLOCK, CHUNK, FAULT, OBJECT, Range, State, read_objects

#: Rows and characters of a batch of records.
ROWS, BATCH_CHARS = 2000, 4 << 20
#: Stores whose files pyarrow opens, and reads piece by piece; of others Spark reads files whole.
STREAMED = ("file", "hdfs", "s3", "gs", "gcs", "abfs", "abfss")
_GAP = re.compile(r"[ \t\r\n,\[\]]*")


def objects(text: io.TextIOBase, chunk: int = 1 << 20) -> Iterator[dict]:
    """Objects of a JSON stream, held one chunk at a time; a malformed tail ends it quietly."""
    decode, held = json.JSONDecoder().raw_decode, ""
    while part := text.read(chunk):
        held, at = held + part, 0
        while (at := _GAP.match(held, at).end()) < len(held):
            try:
                value, at = decode(held, at)
            except json.JSONDecodeError:
                break
            if isinstance(value, dict):
                yield value
        held = held[at:]


def streamed(raw: BinaryIO) -> Iterator[dict]:
    """Objects of JSON in bytes up to its first fault, held one object and one chunk at a time; each byte is looked at once."""
    scan = Range(State(), True)
    while data := raw.read(CHUNK):
        for kind, value, _ in scan.feed(data):
            if kind == FAULT:
                return
            if kind == OBJECT:
                yield value


def file_objects(path: str, raw: BinaryIO) -> Iterator[dict]:
    """Objects of a file, by the ending of its name: .zip (every .json member, unreadable ones skipped), .gz, or plain.

    Files are streamed; of an archive one member is held.
    """
    if path.lower().endswith(".zip"):
        try:
            archive = zipfile.ZipFile(raw)
        except (zipfile.BadZipFile, ValueError, OSError) as e:
            if isinstance(e, OSError) and raw.seek(0, 2) >= 22:  # in a shorter file there is no place where the reader seeks
                raise
            return
        for name in archive.namelist():
            if name.lower().endswith(".json"):
                try:
                    data = json.loads(archive.read(name).decode("utf-8"))
                except (ValueError, zipfile.BadZipFile):
                    continue
                yield from (x for x in (data if isinstance(data, list) else [data]) if isinstance(x, dict))
        return
    yield from streamed(gzip.GzipFile(fileobj=raw) if path.endswith(".gz") else raw)


def opened(path: str) -> BinaryIO:
    from pyarrow import fs

    if path.startswith("file:"):  # the rest is a path as it is, not a URI
        return fs.LocalFileSystem().open_input_file("/" + path.removeprefix("file:").lstrip("/"))
    store, name = fs.FileSystem.from_uri(path)
    return store.open_input_file(name)


def read_records(spark: SparkSession, path: str, keep: tuple[str, ...] | None = None, limit: int | None = None) -> DataFrame:
    """(source_file, position, record): each object as a map of its top-level fields, texts as they are, the rest as JSON.

    keep: the only fields that are read. A file is read by one task, which streams it; read_large_records takes large plain files
    in ranges. limit: objects read from each file. For JSON lines, spark.read.json splits files and is faster.
    """
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    stream = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getUri().getScheme() in STREAMED

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.map_(pa.string(), pa.string())
        names = ["source_file", "position", "record"]
        for b in batches:
            for name, content in zip(b.column(0).to_pylist(), [None] * len(b) if stream else b.column(1)):
                rows, chars = [], 0
                with opened(name) if stream else io.BytesIO(content.as_buffer().to_pybytes()) as raw:
                    for n, x in enumerate(file_objects(name, raw)):
                        if limit is not None and n >= limit:
                            break
                        fields = [(k, v if v is None or isinstance(v, str) else json.dumps(v, ensure_ascii=False)) for k, v in x.items() if keep is None or k in keep]
                        rows.append((name.rsplit("/", 1)[-1], n, fields))
                        chars += sum(len(v) for _, v in fields if v)
                        if len(rows) == ROWS or chars >= BATCH_CHARS:
                            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.string(), pa.int64(), kind))], names)
                            rows, chars = [], 0
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.string(), pa.int64(), kind))], names)

    files = spark.read.format("binaryFile").load(path).select("path", *([] if stream else ["content"]))
    return files.mapInArrow(run, "source_file string, position bigint, record map<string, string>")


def read_large_records(spark: SparkSession, path: str, block: int = BLOCK) -> DataFrame:
    """read_records of plain JSON files of any size, each read by as many tasks as it has ranges of block bytes."""
    found = read_objects(spark, path, block)
    fields = F.from_json("record", "map<string, string>")
    return found.select(F.element_at(F.split("file", "/"), -1).alias("source_file"), "position", fields.alias("record"))


def unexpected_fields(records: DataFrame, known: tuple[str, ...], ignored: tuple[str, ...] = ()) -> DataFrame:
    """(field, records): fields beyond the known ones, with the number of records that have them."""
    new = F.array_except(F.map_keys("record"), F.array(*(F.lit(k) for k in (*known, *ignored))))
    return records.select(F.explode(new).alias("field")).groupBy("field").agg(F.count("*").alias("records")).orderBy("field")

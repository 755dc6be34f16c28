"""ZIP archives by members: directories are read first, then members in tasks of their own, however large their archive is.

A task reads the end of an archive, where its directory is, and gives a row a member. Those that are wanted are dealt by their
place in the archive, so that neighbours are read together, and each task fetches the bytes of its members only. An archive
without a readable directory gives nothing; a member whose bytes do not hold what its directory says is an error.
"""

from __future__ import annotations

import struct
import zipfile
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import stored
from .json_blocks import planned

#: Bytes of an archive whose members are dealt together; rows and bytes of a batch; the fixed part of a member's own header.
SPAN, ROWS, BATCH_BYTES, HEADER = 32 << 20, 200, 8 << 20, 30
MEMBERS = "file string, member string, place long, offset long, packed long, size long, method int, crc long"


def directory(path: str) -> list[dict]:
    """The members of an archive in its directory's order, folders left out; none of an unreadable archive."""
    from pyarrow import fs

    store, name = fs.FileSystem.from_uri(path)
    with store.open_input_file(name) as f:
        try:
            found = zipfile.ZipFile(f).infolist()
        except (zipfile.BadZipFile, ValueError, OSError):
            return []
    return [
        {"file": path, "member": i.filename, "place": n, "offset": i.header_offset, "packed": i.compress_size, "size": i.file_size, "method": i.compress_type, "crc": i.CRC}
        for n, i in enumerate(found) if not i.is_dir()
    ]


def unpacked(f: pa.NativeFile, offset: int, packed: int, method: int, crc: int) -> bytes:
    """The bytes of the member whose header is at offset."""
    f.seek(offset)
    head = f.read(HEADER)
    if head[:4] != b"PK\x03\x04":
        raise zipfile.BadZipFile("no member where the directory says")
    name, extra = struct.unpack("<HH", head[26:30])
    f.seek(offset + HEADER + name + extra)
    data = f.read(packed)
    if method == zipfile.ZIP_DEFLATED:
        data = zlib.decompressobj(-zlib.MAX_WBITS).decompress(data)
    elif method != zipfile.ZIP_STORED:
        raise NotImplementedError(f"members of method {method}")
    if zlib.crc32(data) != crc:
        raise zipfile.BadZipFile("a member's checksum is wrong")
    return data


def members(spark: SparkSession, path: str) -> DataFrame:
    """A row (MEMBERS) a member of the archives of a path, which may have wildcards."""
    files = [(f,) for f, start, _ in planned(spark, path, 1 << 62) if start == 0]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("file", pa.string()), ("member", pa.string()), *((n, pa.int64()) for n in ("place", "offset", "packed", "size")), ("method", pa.int32()), ("crc", pa.int64())])
        for b in batches:
            for file in b.column(0).to_pylist():
                found = directory(file)
                for x in range(0, len(found), 10_000):
                    yield pa.RecordBatch.from_pylist(found[x : x + 10_000], schema)

    return spark.createDataFrame(files, "file string").repartition(max(1, min(len(files), 10_000))).mapInArrow(run, MEMBERS)


def contents(wanted: DataFrame) -> DataFrame:
    """wanted (of members) with content binary."""
    names = ["file", "member", "place", "offset", "packed", "method", "crc"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        schema = pa.schema([("file", pa.string()), ("member", pa.string()), ("place", pa.int64()), ("content", pa.binary())])
        path, f = None, None
        for b in batches:
            rows, size = [], 0
            for file, member, place, offset, packed, method, crc in zip(*(c.to_pylist() for c in b.columns)):
                if file != path:
                    if f:
                        f.close()
                    store, name = fs.FileSystem.from_uri(file)
                    path, f = file, store.open_input_file(name)
                rows.append({"file": file, "member": member, "place": place, "content": unpacked(f, offset, packed, method, crc)})
                size += len(rows[-1]["content"])
                if size >= BATCH_BYTES or len(rows) >= ROWS:
                    yield pa.RecordBatch.from_pylist(rows, schema)
                    rows, size = [], 0
            if rows:
                yield pa.RecordBatch.from_pylist(rows, schema)
        if f:
            f.close()

    # The rows that are dealt are few bytes, so adaptive execution would join tasks: their number follows the bytes to be read.
    chosen = stored(wanted.select(*names), "members")
    tasks = max(1, min(10_000, -(-(chosen.agg(F.sum("packed")).first()[0] or 0) // SPAN)))
    dealt = chosen.repartition(tasks, "file", F.floor(F.col("offset") / SPAN)).sortWithinPartitions("file", "offset")
    return dealt.mapInArrow(run, "file string, member string, place long, content binary")

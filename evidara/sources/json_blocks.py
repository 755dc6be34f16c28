"""Large JSON files in byte ranges: objects of any layout (one a line, pretty-printed, one array), read by several tasks.

Where a range begins, nothing tells whether its first byte is inside a string or how deep it is inside an object. So each range
is first summarised under both readings, in a string or not: where it ends, how much deeper, and how far up it comes in between.
Summaries of a file compose from its first range on, which gives every range its one true beginning. Then tasks parse the
objects that lie inside their range; what is cut by an end of it (the rest of an object, text between objects) comes out as a
fragment, and the fragments between two whole objects are put together in one row by the range in which they begin.

A file's objects count up to its first fault: text between objects that is no JSON value, or an object that is none. All of it is
one pass over the bytes for each step, however damaged a file is. Ranges are planned on the driver, as files' splits are.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import stored

BLOCK, CHUNK, ROWS = 64 << 20, 4 << 20, 2000
#: Bytes of small ranges that one task reads: starting a task takes longer than reading a range of some 100 KB.
TASK_BYTES = 16 << 20
#: Text without braces or unfinished strings; the rest of a string; what may stand between objects.
_PLAIN = re.compile(rb'(?:[^{}"]++|"(?:[^"\\]++|\\.)*+")*+', re.S)
_STRING = re.compile(rb'(?:[^"\\]++|\\.)*+', re.S)
_BETWEEN = re.compile(rb'(?:[ \t\r\n,\[\]]++|"(?:[^"\\]++|\\.)*+"|-?\d[\d.eE+-]*+|true|false|null|NaN|-?Infinity)*+', re.S)
OBJECT, FRAGMENT, FAULT = 0, 1, 2


@dataclass
class State:
    """Where a scan is: in a string, after a backslash there, how deep in braces."""

    in_string: bool = False
    escaped: bool = False
    depth: int = 0

    def braces(self, data: bytes) -> Iterator[tuple[int, int]]:
        """(place, +1 or -1) of each brace outside strings; the state is then that after it, and at last that after data."""
        at, n = 0, len(data)
        while at < n:
            if self.in_string:
                if self.escaped:
                    self.escaped, at = False, at + 1
                    continue
                at = _STRING.match(data, at).end()
                if at < n:
                    self.escaped, self.in_string = data[at] == 0x5C, data[at] == 0x5C
                    at += 1
                continue
            at = _PLAIN.match(data, at).end()
            if at == n:
                return
            if data[at] == 0x22:
                self.in_string = True
            else:
                step = 1 if data[at] == 0x7B else -1
                self.depth += step
                yield at, step
            at += 1


def summary(chunks: list[bytes] | Iterator[bytes], state: State) -> tuple[bool, int, int, bool]:
    """(whether it ends in a string, change of depth, least depth, whether a brace opens) of a range that begins in state, at depth 0."""
    least, opens = 0, False
    for data in chunks:
        for _, step in state.braces(data):
            least, opens = min(least, state.depth), opens or step == 1
    return state.in_string, state.depth, least, opens


def parsed(text: bytes) -> dict | None:
    try:
        value = json.loads(text)
    except ValueError:  # UnicodeDecodeError too
        return None
    return value if isinstance(value, dict) else None


def between(text: bytes) -> bool:
    return _BETWEEN.fullmatch(text) is not None


class Range:
    """Parses a range: (kind, object, text) in order; a fragment with object None begins the range, or ends it."""

    def __init__(self, state: State, first: bool):
        # The first range of a file has nothing before it: its head is complete.
        self.state, self.synced, self.held = state, first, []

    def feed(self, data: bytes) -> Iterator[tuple[int, dict | None, bytes]]:
        start = 0
        for at, step in self.state.braces(data):
            depth = self.state.depth
            if step == 1 and depth == 1:
                text, start = self.take(data[start:at]), at
                if not self.synced:
                    self.synced = True
                    yield FRAGMENT, None, text
                elif not between(text):
                    yield FAULT, None, b""
            elif step == -1 and depth == 0:
                text, start = self.take(data[start : at + 1]), at + 1
                if not self.synced:
                    self.synced = True
                    yield FRAGMENT, None, text
                else:
                    value = parsed(text)
                    yield (OBJECT if value is not None else FAULT), value, b""
            elif depth < 0:
                self.state.depth = 0
                yield FAULT, None, b""
        self.held.append(data[start:])

    def take(self, last: bytes) -> bytes:
        text = b"".join([*self.held, last])
        self.held = []
        return text


def whole(text: bytes) -> tuple[int, dict | None]:
    """What the fragments between two whole objects say together: an object after text between objects, nothing, or a fault."""
    state, begun = State(), None
    for at, step in state.braces(text):
        if step == 1 and state.depth == 1 and begun is None:
            begun = at
            if not between(text[:at]):
                return FAULT, None
        elif state.depth == 0:
            value = parsed(text[begun : at + 1])
            return (OBJECT, value) if value is not None and between(text[at + 1 :]) else (FAULT, None)
        elif state.depth < 0:
            return FAULT, None
    return (FRAGMENT, None) if begun is None and between(text) else (FAULT, None)


def chunks_of(path: str, start: int, end: int) -> Iterator[bytes]:
    from pyarrow import fs

    store, name = fs.FileSystem.from_uri(path)
    with store.open_input_file(name) as f:
        f.seek(start)
        left = end - start
        while left > 0 and (data := f.read(min(CHUNK, left))):
            left -= len(data)
            yield data


def escaped_before(path: str, start: int) -> bool:
    """Whether an odd number of backslashes ends just before start."""
    run = 0
    for end in range(start, 0, -4096):
        data = b"".join(chunks_of(path, max(0, end - 4096), end))
        own = len(data) - len(data.rstrip(b"\\"))
        run += own
        if own < len(data):
            break
    return run % 2 == 1


def planned(spark: SparkSession, path: str, block: int) -> list[tuple[str, int, int]]:
    """(file, start, end) of the ranges of all files of a path: a file, a folder, or either with wildcards."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    store = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    found = [x for f in store.globStatus(at) or [] for x in (store.listStatus(f.getPath()) if f.isDirectory() else [f])]
    out = []
    for f in found:
        if f.isFile() and f.getPath().getName()[0] not in "._":
            size = f.getLen()
            out += [(f.getPath().toString(), a, min(size, a + block)) for a in range(0, size, block)]
    return out


def placed(ranges: list[tuple], summaries: dict[tuple[str, int], tuple]) -> list[tuple]:
    """(file, start, end, in_string, escaped, depth, begun): the state in which each range begins, and the range in which what is cut there began."""
    out, last = [], None
    for file, start, end in ranges:
        if file != last:
            last, in_string, depth, begun = file, False, 0, start
        escaped, *readings = summaries[file, start]
        out.append((file, start, end, in_string, in_string and escaped, depth, begun))
        ends, change, least, opens = readings[in_string]
        if start == 0 or (depth + least <= 0 if depth else opens):
            begun = start
        in_string, depth = ends, max(0, depth + change)
    return out


def read_objects(spark: SparkSession, path: str, block: int = BLOCK) -> DataFrame:
    """(file, position, record) of every JSON object of the files, record as JSON text; position counts a file's objects from 0."""
    ranges = planned(spark, path, block)
    kinds = "file string, start long, end long"
    several = max(-(-sum(end - start for _, start, end in ranges) // TASK_BYTES), 4 * spark.sparkContext.defaultParallelism)
    tasks = max(1, min(len(ranges), several, 10_000))

    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for file, start, end in zip(*(c.to_pylist() for c in b.columns)):
                escaped = escaped_before(file, start)
                held = list(chunks_of(file, start, end)) if end - start <= CHUNK else None  # else it is read twice, not held
                both = [summary(held or chunks_of(file, start, end), State(s, s and escaped)) for s in (False, True)]
                yield pa.RecordBatch.from_pylist([{"file": file, "start": start, "escaped": escaped} | {f"{n}{k}": v for k, own in enumerate(both) for n, v in zip(("ends", "change", "least", "opens"), own)}])

    reading = ", ".join(f"ends{k} boolean, change{k} long, least{k} long, opens{k} boolean" for k in range(2))
    found = spark.createDataFrame(ranges, kinds).repartition(tasks).mapInArrow(describe, f"file string, start long, escaped boolean, {reading}").collect()  # a row a range
    summaries = {(r.file, r.start): (r.escaped, (r.ends0, r.change0, r.least0, r.opens0), (r.ends1, r.change1, r.least1, r.opens1)) for r in found}

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("file", pa.string()), ("start", pa.int64()), ("begun", pa.int64()), ("place", pa.int64()), ("kind", pa.int32()), ("record", pa.string()), ("part", pa.binary())])
        batch = lambda rows: pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)
        for b in batches:
            for file, start, end, in_string, escaped, depth, begun in zip(*(c.to_pylist() for c in b.columns)):
                scan, place, rows = Range(State(in_string, escaped, depth), start == 0), 0, []
                row = lambda kind, value, text, of: (file, start, of, place, kind, None if value is None else json.dumps(value, ensure_ascii=False), text or None)  # noqa: E731, B023
                for data in chunks_of(file, start, end):
                    for kind, value, text in scan.feed(data):
                        rows.append(row(kind, value, text, begun if kind == FRAGMENT else start))
                        place += 1
                    if len(rows) >= ROWS:
                        yield batch(rows)
                        rows = []
                rows.append(row(FRAGMENT, None, scan.take(b""), start if scan.synced else begun))
                yield batch(rows)

    starts = spark.createDataFrame(placed(ranges, summaries), f"{kinds}, in_string boolean, escaped boolean, depth long, begun long")
    rows = stored(starts.repartition(tasks).mapInArrow(parse, "file string, start long, begun long, place long, kind int, record string, part binary"), "json-objects")

    def stitch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("file", pa.string()), ("start", pa.int64()), ("place", pa.int64()), ("kind", pa.int32()), ("record", pa.string())])
        for b in batches:
            for file, begun, parts in zip(*(c.to_pylist() for c in b.columns)):
                kind, value = whole(b"".join(p["part"] for p in parts))
                if kind != FRAGMENT:
                    yield pa.RecordBatch.from_pylist([{"file": file, "start": begun, "place": 1 << 62, "kind": kind, "record": None if value is None else json.dumps(value, ensure_ascii=False)}], schema)

    # Fragments of one begin are consecutive ranges: as many bytes as the object that they are parts of.
    cut = rows.where(f"kind = {FRAGMENT} AND part IS NOT NULL").groupBy("file", "begun").agg(F.array_sort(F.collect_list(F.struct("start", "place", "part"))).alias("parts"))
    joined = cut.mapInArrow(stitch, "file string, start long, place long, kind int, record string")
    every = stored(rows.where(f"kind <> {FRAGMENT}").select("file", "start", "place", "kind", "record").union(joined), "json-records")
    place = F.struct("start", "place")
    faults = every.where(f"kind = {FAULT}").groupBy("file").agg(F.min(place).alias("fault"))
    good = every.where(f"kind = {OBJECT}").join(F.broadcast(faults), "file", "left").where(F.col("fault").isNull() | (place < F.col("fault"))).drop("fault")
    before = Window.partitionBy("file").orderBy("start").rowsBetween(Window.unboundedPreceding, -1)
    counts = good.groupBy("file", "start").agg(F.count("*").alias("n")).select("file", "start", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    inside = Window.partitionBy("file", "start").orderBy("place")
    numbered = good.withColumn("nth", F.row_number().over(inside) - 1).join(F.broadcast(counts), ["file", "start"])  # a row a range, as planned
    return numbered.select("file", (F.col("base") + F.col("nth")).cast("bigint").alias("position"), "record")

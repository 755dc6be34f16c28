"""Helpers that the training-data operators share: shared storage, Arrow text access, word boundaries, components."""

from __future__ import annotations

import ctypes
import re
import sys
import tempfile
import uuid
from collections.abc import Callable, Iterator
from types import ModuleType

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Bytes of text that the numpy kernels take at a time; bounds their memory whatever the Arrow batch holds.
KERNEL_BYTES = 4 << 20


#: Rows of an Arrow batch at most: Spark's default of 10,000 would hold tens of MB of text several times over.
BATCH_ROWS = 1000


def modest_batches(spark: SparkSession) -> None:
    """Bounds the Arrow batches of this session; the operators' texts are long."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key)) <= BATCH_ROWS:
        spark.conf.set(key, str(BATCH_ROWS))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    modest_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir. Where that is unset, a temporary one, which is then set; a local master only,
    as on a cluster each executor would write to a disk of its own."""
    modest_batches(spark)
    sc = spark.sparkContext
    folder = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not folder:
        if not re.fullmatch(r"local(\[[^]]*\])?", sc.master):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="evidara-")
        sc.setCheckpointDir(folder)
    return folder.rstrip("/")


def temporary(spark: SparkSession, name: str) -> str:
    """The path of a new folder in the shared one, to be written by the caller; it goes when the driver's session ends."""
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    store = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    store.mkdirs(at)  # what does not exist is not deleted
    store.deleteOnExit(at)
    return path


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write df as Parquet to the shared folder and read it back: cuts lineage and survives lost executors."""
    path = temporary(df.sparkSession, name)
    df.write.mode("append").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def discard(df: DataFrame) -> None:
    """Delete the files of a materialized df, once what was made of it is itself written."""
    spark = df.sparkSession
    for name in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(name)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def checkpointed(df: DataFrame) -> DataFrame:
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def worker_cache() -> dict:
    """What a Python worker keeps from task to task (functions travel by value, so their modules' globals don't last)."""
    return sys.modules.setdefault("evidara_worker_cache", ModuleType("evidara_worker_cache")).__dict__


def release() -> None:
    """Give memory that was freed back to the system; else a worker or the driver stays as large as it once was."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # of glibc
    if trim:
        trim(0)


#: Bytes of a broadcast table at most, as row_bytes counts them. The driver holds each such table
#: several times over (rows, hash relation, blocks), and a query several such tables at once.
BROADCAST_BYTES = 2 << 20


def row_bytes(df: DataFrame) -> Column:
    """Bytes that a row of df takes about: eight a value and eight more, with the bytes of strings and of nested values."""
    fixed = {"string", "binary"}
    sizes = [F.octet_length(c) if k in fixed else F.octet_length(F.to_json(F.struct(c))) for c, k in df.dtypes if k in fixed or "<" in k]
    return sum((F.coalesce(n, F.lit(0)) for n in sizes), F.lit(8 + 8 * len(df.columns))).cast("long")


def broadcast_if_small(df: DataFrame, most: int | None = None) -> DataFrame:
    """df, evaluated now, and marked for broadcast if all its rows take at most so many bytes; else for a shuffled join."""
    return marked_if_small(checkpointed(df), most)


def marked_if_small(df: DataFrame, most: int | None = None) -> DataFrame:
    """The same for a df that is a written table already."""
    return F.broadcast(df) if is_small(df, most) else df


def is_small(df: DataFrame, most: int | None = None) -> bool:
    """Whether all rows of df, a written table, take at most so many bytes."""
    return (df.agg(F.sum(row_bytes(df))).first()[0] or 0) <= (BROADCAST_BYTES if most is None else most)


#: Keys that hold more than this part of all rows are split in joins, into as many parts.
HEAVY = 4096


def spread_join(many: DataFrame, few: DataFrame, key: str, total: int, by: Column, n: str = "n") -> DataFrame:
    """Inner join on key, where few has a row a key and in column n how many rows of many have it; total is the number of those.

    A key with more than total / HEAVY rows (there are fewer than HEAVY such keys, so they are broadcast) is dealt to
    n * HEAVY / total salts, which rows of many draw by `by`; so no key brings more than about that part to one task.
    """
    share = max(1, total // HEAVY)
    salts = F.when(F.col(n) > share, F.ceil(F.col(n) / share)).otherwise(1).cast("bigint")
    heavy = few.where(F.col(n) > share).select(key, salts.alias("salts"))
    dealt = many.join(F.broadcast(heavy), key, "left")
    dealt = dealt.withColumn("salt", F.when(F.col("salts").isNotNull(), F.pmod(by, F.col("salts"))).otherwise(F.lit(0).cast("bigint"))).drop("salts")
    return dealt.join(few.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("bigint"), salts - 1))), [key, "salt"]).drop("salt")


#: Bits of a bitmap at most: 8 MB, whatever it holds.
MOST_BITS = 1 << 26


def bitmap(ids: DataFrame, count: int, hashed: bool = False) -> np.ndarray:
    """Bits set at the hashes of ids (id long), or at ids that are hashes; of a size that follows their count up to MOST_BITS, a proven bound."""
    bits = min(MOST_BITS, 1 << max(16, (32 * count).bit_length()))
    slot = F.pmod(F.col("id") if hashed else F.xxhash64("id"), F.lit(bits))
    slots = ids.select(slot.alias("slot")).select((F.col("slot") / 64).cast("long").alias("word"), F.expr("shiftleft(1L, cast(slot % 64 as int))").alias("bit"))
    found = slots.groupBy("word").agg(F.bit_or("bit").alias("bits")).toPandas()
    out = np.zeros(bits // 64, np.int64)
    out[found["word"].to_numpy()] = found["bits"].to_numpy()
    return out


def in_bitmap(table: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """For each hash (long) whether its bit is set."""
    slot = hashes % (64 * len(table))
    return (table[slot >> 6] >> (slot & 63)) & 1 == 1


def possibly_in(rows: DataFrame, ids: DataFrame, mark: bool = False) -> DataFrame:
    """rows (with a column doc, long) without most of those whose doc is not in ids (id): spares a join what it would drop.

    Rows pass a fixed-size bitmap where they are read. It never drops a row that the join needs, whatever its load. With
    mark, all rows come, and the boolean possible says which ones the join needs to see.
    """
    ids = checkpointed(ids)
    shared = rows.sparkSession.sparkContext.broadcast(bitmap(ids, ids.count()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = pa.array(in_bitmap(shared.value, b.column(b.num_columns - 1).to_numpy()))
            yield pa.RecordBatch.from_arrays([*b.columns, found], [*b.schema.names, "possible"]) if mark else b.filter(found)

    schema = rows.withColumn("slot", F.lit(0).cast("bigint")).schema
    schema = schema.add("possible", "boolean") if mark else schema
    return rows.withColumn("slot", F.xxhash64("doc")).mapInArrow(run, schema).drop("slot")


def running_totals(df: DataFrame, order: list[Column], sums: dict[str, Column], parts: int = 64) -> DataFrame:
    """df with, for each name, the sum of that column over all rows before this one in order; ties must be broken by order.

    Rows are dealt by ranges of order and summed by range, so one task orders `parts` rows at most, whatever df holds.
    """
    dealt = df.select("*", *(v.alias(f"{k}__own") for k, v in sums.items())).repartitionByRange(parts, *order)
    dealt = checkpointed(dealt.withColumn("range__", F.spark_partition_id()))  # ranges are drawn anew if evaluated twice
    before = Window.rowsBetween(Window.unboundedPreceding, -1)
    ranges = dealt.groupBy("range__").agg(*(F.sum(f"{k}__own").alias(f"{k}__all") for k in sums))
    ranges = ranges.select("range__", *(F.coalesce(F.sum(f"{k}__all").over(before.orderBy("range__")), F.lit(0)).alias(f"{k}__base") for k in sums))
    inside = before.partitionBy("range__").orderBy(*order)
    both = dealt.join(F.broadcast(ranges), "range__")
    totals = {k: F.coalesce(F.sum(f"{k}__own").over(inside), F.lit(0)) + F.col(f"{k}__base") for k in sums}
    return both.withColumns(totals).select(*df.columns, *sums)


def kept_rows(df: DataFrame, run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> DataFrame:
    """df through mapInArrow, whose schema it keeps, whatever its columns are called; run takes columns by place."""
    plain = df.toDF(*(f"c{i}" for i in range(len(df.columns))))
    return plain.mapInArrow(run, plain.schema).toDF(*df.columns)


def as_bytes(column: pa.Array) -> list[bytes | None]:
    """UTF-8 bytes of a string column, without decoding."""
    return column.cast(pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()).to_pylist()


def pieces(column: pa.Array, limit: int = KERNEL_BYTES) -> Iterator[tuple[int, list[bytes]]]:
    """(first row, texts) of consecutive rows with about limit bytes; a longer text comes alone. Null reads as empty."""
    start, size, out = 0, 0, []
    for i in range(len(column)):
        text = column[i].as_py() if not pa.types.is_string(column.type) else column[i].as_buffer()
        text = b"" if text is None else text.to_pybytes() if hasattr(text, "to_pybytes") else text.encode()
        if out and size + len(text) > limit:
            yield start, out
            start, size, out = i, 0, []
        out.append(text)
        size += len(text)
    if out:
        yield start, out


#: Edges that one task may join at once: 8 MB of them.
TASK_EDGES = 1 << 19


def joined_nodes(batches: Iterator[pa.RecordBatch], roots: bool) -> Iterator[pa.RecordBatch]:
    """Of edges (src, dst) a spanning forest, as edges, or with roots each node and the smallest one that it is joined to."""
    parent: dict[int, int] = {}
    out: tuple[list[int], list[int]] = ([], [])

    def root(x: int) -> int:
        while (p := parent.setdefault(x, x)) != x:
            parent[x] = x = parent[p]
        return x

    for batch in batches:
        for src, dst in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            a, b = root(src), root(dst)
            if a != b:
                parent[max(a, b)] = min(a, b)
                if not roots:
                    out[0].append(src)
                    out[1].append(dst)
    if roots:
        out = (list(parent), [root(x) for x in list(parent)])
    names = ["node", "root"] if roots else ["src", "dst"]
    for x in range(0, len(out[0]), 100_000):
        yield pa.RecordBatch.from_arrays([pa.array(c[x : x + 100_000], pa.int64()) for c in out], names)


def spanning(edges: DataFrame) -> DataFrame:
    """edges (src, dst) without those that close a circle among the edges of their task."""
    return checkpointed(edges.select("src", "dst").where("src <> dst").mapInArrow(lambda it: joined_nodes(it, False), "src long, dst long"))


def components(edges: DataFrame) -> DataFrame:
    """Connected components of (src long, dst long) edges as (node, root), root the smallest node reachable.

    Tasks keep a spanning forest of their edges, dealt to fewer tasks as long as that drops edges. TASK_EDGES that are left are joined
    by one task. More of them get minimum labels with pointer jumping, each round checkpointed in the shared folder, until no
    label changes; degrees may be as large as they like, as neighbours only meet in a minimum, which Spark combines first.
    """
    forest = spanning(edges)
    n, tasks = forest.count(), forest.rdd.getNumPartitions()
    while n > TASK_EDGES and tasks > 1:
        tasks = max(1, tasks // 8, -(-n // (4 * TASK_EDGES)))
        fewer = spanning(forest.repartition(tasks, "src"))
        before, n, forest = n, fewer.count(), fewer
        if 10 * n > 9 * before or tasks == -(-n // (4 * TASK_EDGES)):
            break
    if n <= TASK_EDGES:
        return checkpointed(forest.coalesce(1).mapInArrow(lambda it: joined_nodes(it, True), "node long, root long"))
    both = checkpointed(forest.union(forest.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).distinct())
    labels = checkpointed(both.groupBy(F.col("src").alias("node")).agg(F.least(F.min("dst"), F.first("src")).alias("root")))
    while True:
        near = both.join(labels.select(F.col("node").alias("dst"), "root"), "dst").groupBy(F.col("src").alias("node")).agg(F.min("root").alias("near"))
        hooked = near.join(labels, "node").select("node", F.col("root").alias("old"), F.least("root", "near").alias("mid"))
        jump = labels.select(F.col("node").alias("mid"), F.col("root").alias("far"))
        moved = checkpointed(hooked.join(jump, "mid", "left").select("node", F.least("mid", F.coalesce("far", "mid")).alias("root"), "old"))
        labels = moved.select("node", "root")
        if not moved.agg(F.count_if(F.col("root") != F.col("old"))).first()[0]:
            return labels


def with_components(of: DataFrame, roots: DataFrame) -> DataFrame:
    """of (doc_id, fp) with component_id, the smallest doc_id of its fp's component (node, root), or of its fp."""
    least = of.groupBy("fp").agg(F.min("doc_id").alias("least"), F.count("*").alias("n"))
    rooted = checkpointed(least.join(broadcast_if_small(roots.withColumnRenamed("node", "fp")), "fp", "left").withColumn("root", F.coalesce("root", "fp")))
    firsts = checkpointed(rooted.groupBy("root").agg(F.min("least").alias("component_id"), F.count("*").alias("members")))
    of_set = checkpointed(spread_join(rooted, firsts, "root", rooted.count(), F.col("fp"), "members").select("fp", "n", "component_id"))
    return spread_join(of, of_set, "fp", of.count(), F.xxhash64("doc_id")).drop("n")


def polynomial(values: np.ndarray, base: int) -> tuple[np.ndarray, np.ndarray]:
    """Prefix sums of values[i] * base**i and the powers of base's inverse, both modulo 2**64."""
    n = len(values)
    powers = np.empty(n + 1, np.uint64)
    powers[0] = 1
    powers[1:] = base
    np.cumprod(powers, out=powers)
    prefix = np.zeros(n + 1, np.uint64)
    np.cumsum(values.astype(np.uint64) * powers[:n], out=prefix[1:])
    inverse = np.empty(n + 1, np.uint64)
    inverse[0] = 1
    inverse[1:] = pow(base, -1, 1 << 64)
    np.cumprod(inverse, out=inverse)
    return prefix, inverse


def mix64(h: np.ndarray) -> np.ndarray:
    """Finalizer that spreads the bits of polynomial hashes."""
    h = h ^ (h >> np.uint64(31))
    h = h * np.uint64(0x9E3779B97F4A7C15)
    return h ^ (h >> np.uint64(29))


#: Odd multipliers for bytes within a word and for words within a span.
BYTE_BASE, WORD_BASE = 0x5851F42D4C957F2D, 0xD1342543DE82EF95


#: Bytes over which prefix sums are held at a time.
HASH_BYTES = 1 << 18


def span_hashes(raw: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Polynomial hashes of raw[start:end], which do not depend on the place; spans are sorted and do not overlap.

    Prefix sums are held for about HASH_BYTES of text at a time, so that a long text takes no more of them than a short one.
    """
    out, a = np.empty(len(start), np.uint64), 0
    while a < len(start):
        b = max(a + 1, int(np.searchsorted(end, start[a] + HASH_BYTES, side="right")))
        first = int(start[a])
        prefix, inverse = polynomial(raw[first : int(end[b - 1])].astype(np.uint64) + np.uint64(1), BYTE_BASE)
        s, e = start[a:b] - first, end[a:b] - first
        out[a:b] = (prefix[e] - prefix[s]) * inverse[s]
        a = b
    return out


class Words:
    """Words of a list of texts, found all at once: byte starts and ends, document of each, 64-bit hash of each.

    inside: for each byte value whether it belongs to a word. Texts are joined by a byte that is in no word.
    """

    def __init__(self, texts: list[bytes], inside: np.ndarray, gap: bytes = b"\n"):
        sizes = np.fromiter(map(len, texts), np.int64, len(texts))
        self.data = gap.join(texts) + gap
        raw = np.frombuffer(self.data, np.uint8)
        mask = inside[raw]
        edge = np.flatnonzero(np.diff(np.concatenate(([False], mask)).view(np.int8)))
        self.start, self.end = edge[0::2], edge[1::2]
        first_byte = np.concatenate(([0], np.cumsum(sizes + len(gap))[:-1])) if len(texts) else np.zeros(0, np.int64)
        self.first = np.searchsorted(self.start, first_byte)
        self.count = np.diff(np.append(self.first, len(self.start)))
        self.doc = np.repeat(np.arange(len(texts)), self.count)
        self.raw = raw

    def hashes(self) -> np.ndarray:
        return mix64(span_hashes(self.raw, self.start, self.end) + (self.end - self.start).astype(np.uint64))

    def word(self, i: int) -> bytes:
        return self.data[self.start[i] : self.end[i]]


def byte_class(*ranges: tuple[int, int]) -> np.ndarray:
    out = np.zeros(256, bool)
    for a, b in ranges:
        out[a : b + 1] = True
    return out


#: Every byte but ASCII white space.
NOT_SPACE = ~byte_class((0x20, 0x20), (0x09, 0x0D))
#: Digits, lower-case letters and all bytes of characters beyond ASCII.
ALNUM = byte_class((0x30, 0x39), (0x61, 0x7A), (0x80, 0xFF))

"""Exact top-k search by inner product with multi-resolution segment statistics.

Vectors become integers floor(1024 x). Cut into segments, a vector has a mean m and a deviation s for each segment of
length L, and for any two vectors the squared distance is at least the sum of L ((m - m')^2 + (s - s')^2). With the norms
known that lower bound on the distance is an upper bound on the inner product, the sum of L (m m' + s s'), itself the
inner product of two short vectors. Bounds are tried coarse to fine (LEVELS segments); pairs whose bound is under the
query's k-th best score so far are dropped, and exact scores are computed for the survivors. The k-th best starts from
the best scores among the queries themselves, which are candidates too, so it never exceeds the final one.

Queries are the rows whose vec_id is divisible by `step`. They go out in blocks of about QUERY_BYTES, each with the k-th
best scores among its own queries to start from. Up to QUERY_BYTES they are one block and are broadcast. Beyond that,
tasks write blocks to the shared folder, and the search is one job: a task takes its candidates GATHER_BYTES at a time,
and reads one block after another for them. Nothing passes through the driver then. A task returns k rows a query and
gathering at most, and a window with a partial limit merges them.

Vectors that are null, or hold null or non-finite components, and rows without a vec_id take no part. Vectors of different
lengths are never compared; empty ones score 0 with each other. A row never meets rows of its own vec_id; where a vec_id
repeats, each row is a candidate, and the query is its least vector. Scores are exact while they fit 64 bits and stop
at the ends of that range beyond it. A table without queries gives no rows. Other columns are not read.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.core.broadcast import Broadcast
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import checkpointed, temporary

SCALE, LEVELS, QUERY_BYTES, GATHER_BYTES, PAIRS, STRIP = 1024, (4, 16), 4 << 20, 32 << 20, 1 << 19, 65536


def statistics(v: np.ndarray, segments: int) -> np.ndarray:
    """sqrt(L) m and sqrt(L) s of each segment; inner products of two such rows bound those of the vectors."""
    edges = np.linspace(0, v.shape[1], min(segments, v.shape[1]) + 1).astype(int)
    out = []
    for a, b in zip(edges, edges[1:]):
        part = v[:, a:b]
        mean = part.mean(axis=1)
        out += [mean * (b - a) ** 0.5, np.sqrt(((part - mean[:, None]) ** 2).sum(axis=1))]
    return np.column_stack(out)


def products(a: np.ndarray, b: np.ndarray, rows: np.ndarray, columns: np.ndarray) -> np.ndarray:
    """Inner products of rows of a and of b, pair by pair; of all pairs at once where an eighth of them is asked for."""
    if len(rows) * 8 > len(a) * len(b):
        return (a @ b.T)[rows, columns]
    strips = [np.einsum("ij,ij->i", a[rows[x : x + STRIP]], b[columns[x : x + STRIP]]) for x in range(0, len(rows), STRIP)]
    return np.concatenate(strips) if strips else np.zeros(0)


def exact(a: np.ndarray, b: np.ndarray, rows: np.ndarray, columns: np.ndarray) -> np.ndarray:
    """products as longs, without rounding."""
    reach = (np.abs(a).max(initial=0) * np.abs(b).max(initial=0)) * max(1, a.shape[1])
    if reach < 1 << 53:
        return products(a, b, rows, columns).astype(np.int64)
    whole = [sum(int(x) * int(y) for x, y in zip(a[i], b[j])) for i, j in zip(rows, columns)]
    return np.array([max(-(1 << 63), min((1 << 63) - 1, s)) for s in whole], np.int64)


class Search:
    """The best k of each query of one length over all candidates given to add."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, k: int):
        self.ids, self.v, self.k = ids, vectors, k
        self.stats = [statistics(vectors, n) for n in LEVELS] if vectors.shape[1] else []
        self.least = np.full(len(ids), -np.inf)
        self.q, self.c, self.s = (np.zeros(0, np.int64) for _ in range(3))

    def add(self, ids: np.ndarray, v: np.ndarray) -> None:
        step = max(16, PAIRS // max(1, len(self.ids)))
        for a in range(0, len(ids), step):
            self._add(ids[a : a + step], v[a : a + step])

    def _add(self, ids: np.ndarray, v: np.ndarray) -> None:
        if self.stats:
            size = np.abs(self.v).max(initial=0) * np.abs(v).max(initial=0) * v.shape[1]
            floor = self.least - 1e-9 * size - 1e-6  # rounding never drops a pair
            q, c = np.nonzero(self.stats[0] @ statistics(v, LEVELS[0]).T >= floor[:, None])
            for own, n in zip(self.stats[1:], LEVELS[1:]):
                keep = products(own, statistics(v, n), q, c) >= floor[q]
                q, c = q[keep], c[keep]
        else:
            q, c = (x.ravel() for x in np.indices((len(self.ids), len(ids))))
        other = self.ids[q] != ids[c]
        q, c = q[other], c[other]
        score = exact(self.v, v, q, c)
        good = score >= self.least[q]
        q, c, score = np.concatenate((self.q, q[good])), np.concatenate((self.c, ids[c[good]])), np.concatenate((self.s, score[good]))
        order = np.lexsort((c, np.invert(score), q))
        q, c, score = q[order], c[order], score[order]
        place = np.arange(len(q)) - np.searchsorted(q, q)
        self.q, self.c, self.s = (x[place < self.k] for x in (q, c, score))
        full = place == self.k - 1
        self.least[q[full]] = np.maximum(self.least[q[full]], score[full])


def by_length(ids: list, vectors: list) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    out: dict[int, tuple[list, list]] = {}
    for i, v in zip(ids, vectors):
        a, b = out.setdefault(len(v), ([], []))
        a.append(i)
        b.append(v)
    return {n: (np.array(a, np.int64), np.array(b, float).reshape(len(a), n)) for n, (a, b) in out.items()}


#: ids, integer vectors and k-th best scores so far of the queries of each length.
Block = dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]


def block_of(ids: list, vectors: list, k: int) -> Block:
    out = {}
    for n, (own, x) in by_length(ids, vectors).items():
        s = Search(own, np.floor(SCALE * x), k)
        s.add(own, s.v)
        out[n] = (s.ids, s.v, s.least)  # not the rows themselves, which come again as candidates
    return out


def written_blocks(queries: DataFrame, blocks: int, k: int, folder: str) -> list[str]:
    """Paths of the block files of queries (vec_id, v), which tasks write; a file counts if a finished task lists it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, path = fs.FileSystem.from_uri(folder)

        def put(block: int, ids: list, vectors: list) -> pa.RecordBatch:
            name = f"{block:08d}-{TaskContext.get().taskAttemptId()}.block"
            with store.open_output_stream(f"{path}/.{name}") as out:
                out.write(pickle.dumps(block_of(ids, vectors, k)))
            store.move(f"{path}/.{name}", f"{path}/{name}")
            return pa.RecordBatch.from_pydict({"name": [name]})

        rows = (row for b in batches for row in zip(*(b.column(i).to_pylist() for i in range(3))))
        for block, group in groupby(rows, lambda row: row[0]):
            _, ids, vectors = zip(*group)
            yield put(block, list(ids), list(vectors))

    dealt = queries.select(F.pmod(F.xxhash64("vec_id"), F.lit(blocks)).alias("block"), "vec_id", "v").repartition(blocks, "block").sortWithinPartitions("block")
    return [f"{folder}/{r.name}" for r in checkpointed(dealt.mapInArrow(run, "name string")).toLocalIterator()]


def searched(v: DataFrame, names: list[str], one: Broadcast | None, k: int) -> DataFrame:
    """(query_id, vec_id, score) of candidates v that may be among the best k of a query of the block files, or of the one block."""

    def load(name: str) -> Block:
        store, path = fs.FileSystem.from_uri(name)
        with store.open_input_stream(path) as f:
            return pickle.loads(f.read())

    def gathered(batches: Iterator[pa.RecordBatch]) -> Iterator[dict[int, list[tuple[np.ndarray, np.ndarray]]]]:
        held, size = {}, 0
        for b in batches:
            lists, ids = b.column(1), b.column(0).to_numpy()
            sizes, flat = np.diff(lists.offsets.to_numpy()), lists.flatten().to_numpy()
            begin = np.cumsum(sizes) - sizes
            for n in np.unique(sizes).tolist():
                at = np.flatnonzero(sizes == n)
                held.setdefault(n, []).append((ids[at], np.floor(SCALE * flat[begin[at][:, None] + np.arange(n)])))
            size += flat.nbytes + ids.nbytes
            if one or size > GATHER_BYTES:
                yield held
                held, size = {}, 0
        if held:
            yield held

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[int, Search] = {}

        def result() -> Iterator[pa.RecordBatch]:
            for s in found.values():
                yield pa.RecordBatch.from_arrays([pa.array(s.ids[s.q]), pa.array(s.c), pa.array(s.s)], ["query_id", "vec_id", "score"])

        for held in gathered(batches):
            for name in names or [""]:
                block = one.value if one else load(name)
                for n, parts in held.items():
                    if n in block:
                        if n not in found:
                            own, vectors, least = block[n]
                            found[n] = Search(own, vectors, k)
                            found[n].least = least.copy()
                        for ids, x in parts:
                            found[n].add(ids, x)
                if not one:
                    yield from result()
                    found.clear()
        yield from result()

    return v.mapInArrow(run, "query_id long, vec_id long, score long")


def top_k(rows: DataFrame, k: int = 10, step: int = 100) -> DataFrame:
    """query_id, rank (from 1), vec_id, score for every query of rows (vec_id, embedding)."""
    spark = rows.sparkSession
    doubles = F.col("embedding").cast("array<double>")
    v = rows.select(F.col("vec_id").cast("long").alias("vec_id"), doubles.alias("v")).where(F.col("vec_id").isNotNull() & F.col("v").isNotNull())
    v = v.where(F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))))
    queries = v.where(F.col("vec_id") % step == 0).groupBy("vec_id").agg(F.min("v").alias("v"))
    total = queries.agg(F.sum(F.size("v") * 8 + 8)).first()[0] or 0
    if total <= QUERY_BYTES:
        chosen = queries.collect()
        out = searched(v, [], spark.sparkContext.broadcast(block_of([r.vec_id for r in chosen], [r.v for r in chosen], k)), k)
    else:
        out = searched(v, written_blocks(queries, -(-total // QUERY_BYTES), k, temporary(spark, "queries")), None, k)
    best = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    return out.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


ORACLE = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)::BIGINT) AS v FROM embeddings
           WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, list_sum(list_transform(list_zip(q.v, c.v), lambda z: z[1] * z[2]))::BIGINT AS score
      FROM v q, v c WHERE q.vec_id % 100 = 0 AND q.vec_id <> c.vec_id)
SELECT query_id, rank::INT AS rank, vec_id, score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s) WHERE rank <= 10
"""

"""SimHash near-duplicates: pivot distance tables inside pigeonhole buckets, then connected components.

A fingerprint has 64 bits; two fingerprints link at BITS or fewer differing bits. Cut into five blocks, linked
fingerprints (at most two differing bits) agree on at least three of them, so each fingerprint is put into ten buckets,
one for each choice of three blocks. Inside a bucket the table of Hamming distances to PIVOTS fixed reference
fingerprints rejects a pair as soon as one coordinate differs by more than BITS (triangle inequality), and only the
survivors are compared bit by bit. Only edges that join two sets of a bucket leave it, so a bucket of m fingerprints
yields at most m - 1 edges. Buckets of more than BUCKET fingerprints take an exact way without any pair: fingerprints
within two bits share a value at distance one or less from both, so each lists its 65 such values and meets the others
there, at most 65 at one value.

Copies collapse to one row a fingerprint before anything is compared. Null text has no words; no words give
fingerprint zero, which links like any other. A null doc_id is kept in the output and never names a component unless
every doc_id of it is null. Repeated rows are all returned; a table without rows gives none; a very long text is hashed
in strips of LONGEST words. Other columns of the input are not read; one_of_each keeps them as they are.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import as_bytes, broadcast_if_small, checkpointed, components, materialize, spread_join, with_components

PIVOTS, BUCKET, BLOCKS = 16, 512, (13, 13, 13, 13, 12)
SEED, LONGEST = 42, 1 << 20
#: Differing bits at which fingerprints link; five blocks, three of them kept, and balls of radius one are exact for two.
BITS = 2


def fingerprint(text: bytes | None, shingle: int = 3) -> int:
    """Unsigned 64-bit SimHash of a text's word shingles, repeats included."""
    words = (text or b"").lower().split()  # bytes: A-Z only, ASCII white space only
    if not words:
        return 0
    digest = xxhash.xxh64_intdigest
    if len(words) < shingle:
        return digest(b" ".join(words), SEED)
    total, n = np.zeros(64, np.int64), len(words) - shingle + 1
    for a in range(0, n, LONGEST):
        part = words[a : a + LONGEST + shingle - 1]
        h = np.fromiter((digest(b" ".join(x), SEED) for x in zip(*(part[i:] for i in range(shingle)))), np.uint64)
        total += np.unpackbits(h.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * total > n).tobytes(), "big")


def fingerprints(docs: DataFrame, shingle: int = 3) -> DataFrame:
    """(doc_id, fp): fp is the fingerprint as a signed long."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fps = np.fromiter((fingerprint(t, shingle) for t in as_bytes(b.column(1))), np.uint64, b.num_rows)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fps.view(np.int64))], ["doc_id", "fp"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, fp long")


def masks() -> list[int]:
    """The bits that each bucket choice keeps, as signed longs."""
    ends = np.cumsum((0, *BLOCKS))
    block = [((1 << int(b - a)) - 1) << int(a) for a, b in zip(ends, ends[1:])]
    kept = [sum(block[i] for i in c) for c in combinations(range(len(BLOCKS)), 3)]
    return [int(np.uint64(m).view(np.int64)) for m in kept]


def pivot_table(fps: np.ndarray) -> np.ndarray:
    pivots = np.random.default_rng(20).integers(0, 1 << 64, PIVOTS, dtype=np.uint64)
    return np.bitwise_count(fps[:, None] ^ pivots[None, :]).astype(np.int8)


def bucket_edges(group: np.ndarray, fps: np.ndarray) -> list[tuple[int, int]]:
    """Edges that connect the linked fingerprints of each group; group is sorted, fps unsigned."""
    n = len(fps)
    stop = np.searchsorted(group, group, side="right")
    near, parent, out = pivot_table(fps), {}, []

    def root(x: int) -> int:
        while parent.get(x, x) != x:
            parent[x] = x = parent.get(parent[x], parent[x])
        return x

    at = np.arange(n)
    for step in range(1, n):
        at = at[stop[at] > at + step]
        if not len(at):
            break
        pairs = at[np.abs(near[at] - near[at + step]).max(axis=1) <= BITS]
        for i in pairs[np.bitwise_count(fps[pairs] ^ fps[pairs + step]) <= BITS].tolist():
            a, b = root(i), root(i + step)
            if a != b:
                parent[max(a, b)] = min(a, b)
                out.append((i, i + step))
    return out


def links(fps: DataFrame) -> DataFrame:
    """(src, dst) edges between the distinct fingerprints of fps (fp long) that span the graph of all links."""
    fps = checkpointed(fps)
    key: list[Column] = [F.xxhash64(F.lit(i), F.col("fp").bitwiseAND(F.lit(m))) for i, m in enumerate(masks())]
    dealt = fps.select("fp", F.explode(F.array(*key)).alias("k"))
    sizes = checkpointed(dealt.groupBy("k").agg(F.count("*").alias("n")).where("n > 1"))
    shared = checkpointed(spread_join(dealt, sizes, "k", len(key) * fps.count(), F.col("fp")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def found(t: pa.Table) -> pa.RecordBatch:
            fp = t.column("fp").to_numpy().view(np.uint64)
            k = t.column("k").to_numpy()
            group = np.concatenate(([0], np.cumsum(k[1:] != k[:-1]))) if len(fp) else np.zeros(0, int)
            e = np.array(bucket_edges(group, fp), np.int64).reshape(-1, 2)
            return pa.RecordBatch.from_arrays([pa.array(fp[e[:, 0]].view(np.int64)), pa.array(fp[e[:, 1]].view(np.int64))], ["src", "dst"])

        held = None
        for b in batches:
            t = pa.Table.from_batches([b]) if held is None else pa.concat_tables([held, pa.Table.from_batches([b])])
            if not t.num_rows:
                continue
            k = t.column("k").to_numpy()
            other = np.flatnonzero(k != k[-1])
            cut = int(other[-1]) + 1 if len(other) else 0  # the last group may go on; it has BUCKET rows at most
            if cut:
                yield found(t.slice(0, cut))
            held = t.slice(cut)
        if held is not None and held.num_rows:
            yield found(held)

    usual = shared.where(F.col("n") <= BUCKET).select("k", "fp").repartition("k").sortWithinPartitions("k", "fp").mapInArrow(run, "src long, dst long")
    balls = F.array(F.col("fp"), *(F.col("fp").bitwiseXOR(F.lit(int(np.uint64(1 << i).view(np.int64)))) for i in range(64)))
    hot = shared.where(F.col("n") > BUCKET).select("fp").distinct().select("fp", F.explode(balls).alias("ball"))
    met = hot.groupBy("ball").agg(F.collect_set("fp").alias("fps")).where(F.size("fps") > 1)
    stars = met.select(F.array_min("fps").alias("src"), F.explode("fps").alias("dst")).where("src <> dst")
    return usual.union(stars)


def simhash_groups(docs: DataFrame, shingle: int = 3) -> DataFrame:
    """One row per row of docs: doc_id, fingerprint (16 hex digits), component_id (smallest doc_id reachable)."""
    of = materialize(fingerprints(docs, shingle), "simhash")
    named = with_components(of, components(links(of.select("fp").distinct())))
    return named.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def one_of_each(docs: DataFrame, groups: Callable[[DataFrame], DataFrame] = simhash_groups) -> DataFrame:
    """One row of docs for each component: of smallest doc_id (null last), then of smallest text hash.

    groups gives the component_id of each doc_id. It is given hashes of the texts as ids, so rows are told apart by doc_id
    and text: null or repeated doc_ids with other texts stay. Of rows that repeat both, one stays. Only ids and hashes that
    go are joined, so texts move only where that list outgrows a broadcast or such rows are repeated.
    """
    text = F.xxhash64(F.col("text").cast("string"))
    named = groups(docs.select(text.alias("doc_id"), "text")).select(F.col("doc_id").alias("h"), "component_id").distinct()
    rows = checkpointed(docs.select(F.col("doc_id").alias("id"), text.alias("h")).groupBy("id", "h").agg(F.count("*").alias("n")))
    total, salt = rows.count(), F.xxhash64("id")
    of_text = checkpointed(rows.groupBy("h").agg(F.count("*").alias("rows")).join(named, "h"))
    rows = checkpointed(spread_join(rows, of_text, "h", total, salt, "rows").drop("rows"))
    order = F.struct(F.col("id").isNull().alias("last"), "id", "h")
    firsts = checkpointed(rows.groupBy("component_id").agg(F.min(order).alias("first"), F.count("*").alias("rows")))
    judged = spread_join(rows, firsts, "component_id", total, salt, "rows").select("id", "h", "n", (order == F.col("first")).alias("stays"))
    judged = checkpointed(judged)
    same = lambda other: docs.doc_id.eqNullSafe(other.id) & (text == other.h)
    out = broadcast_if_small(judged.where("n > 1 OR NOT stays").select("id", "h"))
    kept = docs.join(out, same(out), "left_anti")
    twice = broadcast_if_small(judged.where("n > 1 AND stays").select("id", "h"))
    return kept.union(docs.join(twice, same(twice), "left_semi").dropDuplicates(["doc_id", "text"])) if twice.limit(1).count() else kept

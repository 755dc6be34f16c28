"""MinHash near-duplicates: an inverted join of signature coordinates, then exact similarity inside what it joins.

A text's set of word shingles has a signature of COORDINATES minima. Sets of similarity 0.8 agree on each coordinate with
probability 0.8, so fewer than MATCHES agree for 3 pairs in ten million. Signatures that agree on MATCHES coordinates have,
under any fixed order of coordinate values, one of the first COORDINATES - MATCHES + 1 in common (the prefix): only those are
posted, values that a sample shows to be common last, so the common ones are skipped. Documents that meet at a posting count
all their collisions on the signatures themselves, of which a byte a coordinate travels (other values then agree once in 256
times, which lets a few more pairs pass and stops none); pairs of MATCHES and more join candidate groups, without listing pairs:
a bucket gives links that span it. Inside each candidate group whole sets are compared, which decides.

Texts with the same set are one member. Buckets and groups of any size are taken in parts of bounded weight (`grouping`).
Sets are told apart, and intersected, by 64-bit hashes of shingles.

Words are lower-cased (A-Z) and parted by ASCII white space; fewer words than a shingle are one shingle; a text without words,
or null, has an empty set and is linked with nothing. Repeated rows are all returned, with the component of their doc_id's
texts; a null doc_id never names a component unless all its doc_ids are null. A table without rows gives none. A very long
text is hashed a few shingles at a time, its set is held whole. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import grouping
from .common import components, materialize, mix64, pieces, release, with_components
from .near import in_common, lists, one_a_set, paired, row_hashes, set_names, several, shingle_sets, whole_sets

SHINGLE, COORDINATES, MATCHES = 2, 64, 34
PREFIX = COORDINATES - MATCHES + 1
#: Texts of the sample that orders coordinate values, and the common ones of it; shingles hashed at a time; weight of a bucket's part and of a group's part.
SAMPLE, COMMON, STRIP, BUCKET_BYTES, GROUP_BYTES = 2000, 100_000, 1 << 14, 1 << 16, 16 << 20
FACTORS = np.random.default_rng(13).integers(0, 1 << 63, COORDINATES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def signatures(n: int, doc: np.ndarray, h: np.ndarray) -> np.ndarray:
    """The minima of n sets of (text, shingle), sorted by text; of an empty set the largest value."""
    out = np.full((n, COORDINATES), 0xFFFFFFFF, np.uint32)
    for x in range(0, len(h), STRIP):
        d, s = doc[x : x + STRIP], h[x : x + STRIP]
        first = np.flatnonzero(np.concatenate(([True], d[1:] != d[:-1])))
        for k, factor in enumerate(FACTORS):
            least = np.minimum.reduceat((s * factor) >> np.uint64(32), first).astype(np.uint32)
            out[d[first], k] = np.minimum(out[d[first], k], least)
    return out


def posting_keys(signature: np.ndarray) -> np.ndarray:
    """A 64-bit name of each coordinate and its value."""
    return mix64((signature.astype(np.uint64) << np.uint64(8)) + np.arange(COORDINATES, dtype=np.uint64) + np.uint64(1))


def prefix_keys(keys: np.ndarray, common: np.ndarray, rank: np.ndarray) -> np.ndarray:
    """The PREFIX first keys of each row in the common order; common is sorted, rank says how often the sample has it."""
    late = np.zeros(keys.shape, np.uint64)
    if len(common):
        at = np.minimum(np.searchsorted(common, keys), len(common) - 1)
        late = np.where(common[at] == keys, rank[at], 0).astype(np.uint64)
    order = np.lexsort((keys, late), axis=1)[:, :PREFIX]
    return np.take_along_axis(keys, order, axis=1)


def common_keys(docs: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Coordinate values of several texts of a sample of SAMPLE texts or so, sorted, and how many have each; any answer gives a valid order."""
    every = max(1, docs.count() // SAMPLE)
    some = docs.select(F.col("text").cast("string").alias("text")).where(F.pmod(F.xxhash64("text"), F.lit(every)) == 0).distinct()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for _, texts in pieces(b.column(0)):
                doc, h = shingle_sets(texts, SHINGLE)
                keys = posting_keys(signatures(len(texts), doc, h)[np.unique(doc)])
                yield pa.RecordBatch.from_arrays([pa.array(keys.ravel().view(np.int64))], ["h"])

    found = some.mapInArrow(run, "h long").groupBy("h").agg(F.count("*").alias("n")).where("n > 2").orderBy(F.desc("n"), "h").limit(COMMON).toArrow()
    h, n = (found.column(c).to_numpy().astype(np.int64) for c in ("h", "n"))
    h = h.view(np.uint64)
    order = np.argsort(h)
    return h[order], n[order]


def described(docs: DataFrame) -> DataFrame:
    """(doc_id, h, fp, size, signature, prefix) of each row: h names the doc_id and text, fp the set."""
    shared = docs.sparkSession.sparkContext.broadcast(common_keys(docs))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for first, texts in pieces(b.column(2)):
                n, (doc, h) = len(texts), shingle_sets(texts, SHINGLE)
                sign = signatures(n, doc, h)
                size = np.bincount(doc, minlength=n)
                has = size > 0
                keys = prefix_keys(posting_keys(sign[has]), *shared.value)
                offsets = pa.array(np.concatenate(([0], np.cumsum(np.where(has, PREFIX, 0)))), pa.int32())
                prefix = pa.ListArray.from_arrays(offsets, pa.array(keys.ravel().view(np.int64)))
                yield pa.RecordBatch.from_arrays(
                    [b.column(0).slice(first, n), b.column(1).slice(first, n), pa.array(set_names(n, doc, h).view(np.int64)), pa.array(size, pa.int64()), pa.array(last_bytes(sign), pa.binary()), prefix],
                    ["doc_id", "h", "fp", "size", "signature", "prefix"],
                )
        release()

    return row_hashes(docs).mapInArrow(run, "doc_id long, h long, fp long, size long, signature binary, prefix array<long>")


def last_bytes(signature: np.ndarray) -> list[bytes]:
    """The last byte of each coordinate, for each row."""
    return [s.tobytes() for s in signature.astype(np.uint8)]


def matrix(table: pa.Table) -> np.ndarray:
    """The bytes of the signatures of a table's rows."""
    return np.frombuffer(b"".join(table.column("signature").to_pylist()), np.uint8).reshape(-1, COORDINATES)


def matching(table: pa.Table):
    """Tests by counted collisions."""
    sign = matrix(table)

    def linked(i: int, j: np.ndarray) -> np.ndarray:
        return (sign[j] == sign[i]).sum(axis=1) >= MATCHES

    return linked


def similar(table: pa.Table):
    """Tests by whole sets, of those whose collisions allow it."""
    size, agree, shared = table.column("size").to_numpy(), matching(table), in_common(table)

    def linked(i: int, j: np.ndarray) -> np.ndarray:
        out = agree(i, j)
        at = j[out]
        out[out] = 9 * shared(i, at) >= 4 * (size[i] + size[at])
        return out

    return linked


def candidates(once: DataFrame) -> DataFrame:
    """(fp, root) of the groups that signatures join, of once (fp, size, signature, prefix)."""
    dealt = once.select(F.explode("prefix").alias("key"), "fp", F.col("size").cast("int").alias("size"), F.lit(0).alias("pos"))
    rows = paired(several(dealt)).select("key", "fp", "size")
    signed = rows.join(once.select("fp", "signature"), "fp").withColumn("weight", F.lit(COORDINATES).cast("bigint"))
    return components(grouping.links(materialize(signed, "postings"), matching, BUCKET_BYTES)).withColumnRenamed("node", "fp")


def minhash_groups(docs: DataFrame) -> DataFrame:
    """A row per row of docs: doc_id, n_shingles, component_id (smallest doc_id reachable), kept (whether that is its own)."""
    of = materialize(described(docs).withColumn("row", F.monotonically_increasing_id()), "minhash")
    full = of.where("size > 0")
    near = candidates(materialize(one_a_set(full), "minhash-sets"))
    sets = whole_sets(docs, full, near, SHINGLE, "signature", lambda n, doc, h: last_bytes(signatures(n, doc, h)))
    named = with_components(full.select("doc_id", "fp", "size"), components(grouping.links(sets, similar, GROUP_BYTES))).select("doc_id", "size", "component_id")
    found = named.union(of.where("size = 0").select("doc_id", "size", F.col("doc_id").alias("component_id")))
    return found.select("doc_id", F.col("size").alias("n_shingles"), "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))

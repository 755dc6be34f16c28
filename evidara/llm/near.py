"""Near-duplicates: texts whose sets of five-word shingles have a Jaccard similarity of 0.8 or more.

SimHash comes first: the fingerprints of `simhash`, of five-word shingles, are linked through pivot distance tables inside
pigeonhole buckets. Links at two differing bits are the nearest copies only: at a similarity of 0.8 some 10 to 18 of 64 bits
differ, a radius at which neither blocks nor pivots reject anything. So an exact search adds the other candidates.

No pair is missed by chance. Sets x and y of similarity 4/5 share 4/5 of the larger one, so under any fixed order of all
shingles the first |x| - ceil(4|x|/5) + 1 of x and those of y have one in common (prefix filtering). The order puts shingles
that a sample shows to be common last, so few unrelated texts meet. Each shingle of a prefix is a bucket; buckets with the
same members are one. Two sets that first meet at places i and j share at most min(|x| - i, |y| - j) shingles, which
drops most rows before anything else of them is moved.

Pairs of a bucket then pass a bound on Hamming distance: a sketch has the parity of the shingles hashed to each of its bits,
so two sketches differ in no more bits than the sets differ in shingles, at most (|x| + |y|) / 9. Sketches have four bits or
more a shingle, so few other pairs pass. What passes is joined to candidate groups, without listing pairs, and inside each
group whole sets are compared, which decides. Buckets and groups of any size are taken in parts (`grouping`).

Words are lower-cased (A-Z) and parted by ASCII white space; fewer than five words are one shingle, no words none, and texts
without words are copies of each other. Shingles and sets are told apart by 64-bit hashes. A null text has no words; a table
without rows gives none; repeated rows are all returned; a very long text is held whole by the task that reads it. Other
columns are not read.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import grouping
from .common import NOT_SPACE, Words, broadcast_if_small, checkpointed, components, discard, materialize, mix64, pieces, possibly_in, release, spread_join, with_components
from .decontaminate import Grams
from .simhash import fingerprint
from .simhash import links as fingerprint_links

SHINGLE, SAMPLE, COMMON = 5, 2000, 100_000
#: 64-bit words of a sketch, for small and for large sets; rows that a grouping pass takes and holds at most; weight of a bucket's part and of a group's part.
LEAST_WORDS, MOST_WORDS, STRIP, HELD, BUCKET_BYTES, GROUP_BYTES = 8, 512, 1 << 14, 100_000, 1 << 18, 16 << 20


def shingle_sets(texts: list[bytes], shingle: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """(text, shingle) of the distinct shingles of each text, sorted."""
    words = Words([t.lower() for t in texts], NOT_SPACE)
    grams = Grams(words)
    whole = grams.inside(shingle)
    short = np.flatnonzero((words.count > 0) & (words.count < shingle))
    brief = [grams.at(words.first[i : i + 1], int(words.count[i])) for i in short]
    doc = np.concatenate([words.doc[: len(whole)][whole], short]).astype(np.int64)
    h = np.concatenate([grams.all(shingle)[whole], *brief]).astype(np.uint64)
    order = np.lexsort((h, doc))
    doc, h = doc[order], h[order]
    new = np.concatenate(([True], (doc[1:] != doc[:-1]) | (h[1:] != h[:-1]))) if len(h) else np.zeros(0, bool)
    return doc[new], h[new]


def set_names(n: int, doc: np.ndarray, h: np.ndarray) -> np.ndarray:
    """A hash of each of n sets; of an empty one zero."""
    sums = np.zeros(n, np.uint64)
    np.add.at(sums, doc, mix64(h * np.uint64(0x2545F4914F6CDD1D) + np.uint64(1)))
    return mix64(sums)


def sketches(n: int, doc: np.ndarray, h: np.ndarray) -> list[bytes]:
    """The parity of the shingles at each bit, for sets of text and shingle; a power of two of words, by size."""
    size = np.bincount(doc, minlength=n)
    words = np.maximum(LEAST_WORDS, np.minimum(MOST_WORDS, 1 << np.ceil(np.log2(np.maximum(size, 1) / 16)).clip(0).astype(np.int64)))
    first = np.cumsum(words) - words
    out = np.zeros(int(words.sum()), np.uint64)
    at = first[doc] + ((h >> np.uint64(6)).astype(np.int64) & (words[doc] - 1))
    np.bitwise_xor.at(out, at, np.uint64(1) << (h & np.uint64(63)))
    return [out[a : a + w].tobytes() for a, w in zip(first.tolist(), words.tolist())]


def prefixes(n: int, doc: np.ndarray, h: np.ndarray, common: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, shingle) of the prefixes and the sizes of the sets; common is sorted, rank says which of it comes later."""
    size = np.bincount(doc, minlength=n)
    late = np.zeros(len(h), np.int64)
    if len(common):
        at = np.minimum(np.searchsorted(common, h), len(common) - 1)
        late = np.where(common[at] == h, rank[at], 0)
    order = np.lexsort((h, late, doc))
    doc, h = doc[order], h[order]
    place = np.arange(len(h)) - (np.cumsum(size) - size)[doc]
    first = place < (size - (4 * size + 4) // 5 + 1)[doc]
    return doc[first], h[first], size


def lists(n: int, doc: np.ndarray, h: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(np.bincount(doc, minlength=n)))).astype(np.int32)), pa.array(h.view(np.int64)))


def common_shingles(docs: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Shingles of several texts of a sample, sorted, and how many: any answer gives a valid order."""
    every = max(1, docs.count() // SAMPLE)
    some = docs.select(F.col("text").cast("string").alias("text")).where(F.pmod(F.xxhash64("text"), F.lit(every)) == 0).distinct()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for _, texts in pieces(b.column(0)):
                yield pa.RecordBatch.from_arrays([pa.array(shingle_sets(texts)[1].view(np.int64))], ["h"])

    counts = some.mapInArrow(run, "h long").groupBy("h").agg(F.count("*").alias("n")).where("n > 2")
    rows = counts.orderBy(F.desc("n"), "h").limit(COMMON).toArrow()
    h, n = (rows.column(c).to_numpy().astype(np.int64) for c in ("h", "n"))
    h = h.view(np.uint64)
    order = np.argsort(h)
    return h[order], n[order]


def described(docs: DataFrame) -> DataFrame:
    """(doc_id, h, fp, size, simhash, sketch, prefix) of each row: h is a hash of doc_id and text, fp one of its set of shingles, simhash
    its fingerprint; the prefix is in order."""
    shared = docs.sparkSession.sparkContext.broadcast(common_shingles(docs))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for first, texts in pieces(b.column(2)):
                n, (doc, h) = len(texts), shingle_sets(texts)
                at, key, size = prefixes(n, doc, h, *shared.value)
                sketch = pa.array(sketches(n, doc, h), pa.binary())
                print_ = np.fromiter((fingerprint(t, SHINGLE) for t in texts), np.uint64, n)
                yield pa.RecordBatch.from_arrays(
                    [b.column(0).slice(first, n), b.column(1).slice(first, n), pa.array(set_names(n, doc, h).view(np.int64)), pa.array(size, pa.int64()), pa.array(print_.view(np.int64)), sketch, lists(n, at, key)],
                    ["doc_id", "h", "fp", "size", "simhash", "sketch", "prefix"],
                )
        release()

    return row_hashes(docs).mapInArrow(run, "doc_id long, h long, fp long, size long, simhash long, sketch binary, prefix array<long>")


def whole_groups(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Table, bool]]:
    """Tables of whole groups and True; a group is the rows of one key, column 0, in ascending order of which they come.
    A group of more than HELD rows comes in parts, with False."""
    held: list[pa.RecordBatch] = []
    rows, long = 0, None
    for b in batches:
        if b.num_rows and long is not None:
            n = int(np.searchsorted(b.column(0).to_numpy(), long, side="right"))
            if n:
                yield pa.Table.from_batches([b.slice(0, n)]), False
            b = b.slice(n)
        if not b.num_rows:
            continue
        long = None
        held.append(b)
        rows += b.num_rows
        if rows >= STRIP:
            t = pa.Table.from_batches(held)
            key = t.column(0).to_numpy()
            cut = int(np.searchsorted(key, key[-1]))
            if cut:
                yield t.slice(0, cut).combine_chunks(), True
            held, rows = t.slice(cut).to_batches(), len(key) - cut
            if rows > HELD:
                yield t.slice(cut).combine_chunks(), False
                held, rows, long = [], 0, int(key[-1])
    if held:
        yield pa.Table.from_batches(held).combine_chunks(), True


def arrays(t: pa.Table, *names: str) -> list[np.ndarray]:
    return [t.column(n).to_numpy() for n in names]


ROW = "key long, fp long, size int, pos int"


def batch(key: np.ndarray, fp: np.ndarray, size: np.ndarray, pos: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(fp), pa.array(size, pa.int32()), pa.array(pos, pa.int32())], ["key", "fp", "size", "pos"])


def several(dealt: DataFrame) -> DataFrame:
    """Rows (key, fp, size, pos) of keys that several sets have, under a new key that keys with the same sets share."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t, whole in whole_groups(batches):
            key, fp, size, pos = arrays(t, "key", "fp", "size", "pos")
            if not whole:
                yield batch(mix64(mix64(key.view(np.uint64))), fp, size, pos)
                continue
            same = key[1:] == key[:-1]
            keep = np.append(same, False) | np.append(False, same)
            if keep.any():
                key, fp, size, pos = key[keep], fp[keep], size[keep], pos[keep]
                first = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
                names = mix64(np.add.reduceat(mix64(fp.view(np.uint64)), first))
                yield batch(np.repeat(names, np.diff(np.append(first, len(key)))), fp, size, pos)
        release()

    return dealt.repartition("key").sortWithinPartitions("key").mapInArrow(run, ROW)


def paired(rows: DataFrame) -> DataFrame:
    """Rows, once each key and set, at its first place, that have another of their key whose size their own size and place allow."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t, whole in whole_groups(batches):
            key, fp, size, pos = arrays(t, "key", "fp", "size", "pos")
            new = np.concatenate(([True], (key[1:] != key[:-1]) | (fp[1:] != fp[:-1])))
            key, fp, size, pos = key[new], fp[new], size[new], pos[new]
            if whole:
                place = np.cumsum(np.concatenate(([0], (key[1:] != key[:-1]).astype(np.int64)))) << 32
                n, i = size.astype(np.int64), pos.astype(np.int64)
                least, most = -(-4 * n // 5), (5 * n - 9 * i) // 4
                others = np.searchsorted(place + n, place + most, side="right") - np.searchsorted(place + n, place + least) - (most >= n)
                keep = others > 0
                key, fp, size, pos = key[keep], fp[keep], size[keep], pos[keep]
            if len(key):
                yield batch(key, fp, size, pos)
        release()

    return rows.repartition("key").sortWithinPartitions("key", "size", "fp", "pos").mapInArrow(run, ROW)


def distances(table: pa.Table) -> Callable[[int, np.ndarray], np.ndarray]:
    """Gives the Hamming distances of a row's sketch to others', each pair folded to the smaller of both."""
    sketch = [np.frombuffer(x, np.uint64) for x in table.column("sketch").to_pylist()]
    words, folds = np.array([len(x) for x in sketch], np.int64), {}

    def folded(w: int) -> np.ndarray:
        """Sketches of at least w words, folded to w."""
        if w not in folds:
            folds[w] = out = np.zeros((len(sketch), w), np.uint64)
            for i in np.flatnonzero(words >= w).tolist():
                out[i] = np.bitwise_xor.reduce(sketch[i].reshape(-1, w), axis=0)
        return folds[w]

    def apart(i: int, j: np.ndarray) -> np.ndarray:
        out, least = np.zeros(len(j), np.int64), np.minimum(words[j], words[i])
        for w in np.unique(least).tolist():
            k = np.flatnonzero(least == w)
            out[k] = np.bitwise_count(folded(w)[j[k]] ^ folded(w)[i]).sum(axis=1, dtype=np.int64)
        return out

    return apart


def within_bound(table: pa.Table) -> Callable[[int, np.ndarray], np.ndarray]:
    """Tests by sizes, places in the bucket's prefixes, and sketches."""
    size, pos = (table.column(c).to_numpy().astype(np.int64) for c in ("size", "pos"))
    apart = distances(table)

    def linked(i: int, j: np.ndarray) -> np.ndarray:
        out = 9 * np.minimum(size[i] - pos[i], size[j] - pos[j]) >= 4 * (size[i] + size[j])
        at = j[out]
        out[out] = 9 * apart(i, at) <= size[i] + size[at]
        return out

    return linked


def similar(table: pa.Table) -> Callable[[int, np.ndarray], np.ndarray]:
    """Tests by whole sets, of those whose sketches allow it."""
    size, apart, shared = table.column("size").to_numpy(), distances(table), in_common(table)

    def linked(i: int, j: np.ndarray) -> np.ndarray:
        out = 9 * apart(i, j) <= size[i] + size[j]
        at = j[out]
        out[out] = 9 * shared(i, at) >= 4 * (size[i] + size[at])
        return out

    return linked


def in_common(table: pa.Table) -> Callable[[int, np.ndarray], np.ndarray]:
    """Gives how many shingles a row's set shares with others'."""
    column = table.column("shingles").combine_chunks()
    begin, flat = column.offsets.to_numpy().astype(np.int64), column.values.to_numpy().view(np.uint64)

    def shared(i: int, j: np.ndarray) -> np.ndarray:
        own, out = flat[begin[i] : begin[i + 1]], np.zeros(len(j), np.int64)
        if not len(own):
            return out
        for k, other in enumerate(flat[begin[x] : begin[x + 1]] for x in j.tolist()):
            at = np.minimum(np.searchsorted(own, other), len(own) - 1)
            out[k] = np.count_nonzero(own[at] == other)
        return out

    return shared


def row_hashes(docs: DataFrame) -> DataFrame:
    """(doc_id, h, text): h is a hash of both, nulls told apart."""
    text, doc_id = F.col("text").cast("string"), F.col("doc_id").cast("long")
    return docs.select(doc_id.alias("doc_id"), F.xxhash64(doc_id, doc_id.isNull(), text).alias("h"), text.alias("text"))


def one_a_set(of: DataFrame) -> DataFrame:
    """One of the rows (row, fp) of each fp."""
    first = checkpointed(of.groupBy("fp").agg(F.min("row").alias("first"), F.count("*").alias("n")).where("n > 1"))
    copies = spread_join(of.select("fp", "row"), first, "fp", of.count(), F.col("row")).where("row <> first").select("row")
    return of.join(broadcast_if_small(copies), "row", "left_anti")


def whole_sets(docs: DataFrame, of: DataFrame, near: DataFrame, shingle: int, name: str, summary: Callable[[int, np.ndarray, np.ndarray], list[bytes]]) -> DataFrame:
    """(key, fp, size, weight, shingles, and under name what summary says of a set) of the sets that near (fp, root) joins.

    Texts are read again, and a bitmap of fixed size drops most of those that are not needed where they are read. of has fp and h.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for first, texts in pieces(b.column(1)):
                n, (doc, h) = len(texts), shingle_sets(texts, shingle)
                yield pa.RecordBatch.from_arrays([b.column(0).slice(first, n), pa.array(np.bincount(doc, minlength=n), pa.int64()), lists(n, doc, h), pa.array(summary(n, doc, h), pa.binary())], ["h", "size", "shingles", name])
        release()

    wanted = checkpointed(near.join(one_a_set(of).select("fp", "h"), "fp").select("h", "fp", F.col("root").alias("key")))
    some = possibly_in(row_hashes(docs).select(F.col("h").alias("doc"), "text"), wanted.select(F.col("h").alias("id")))
    sets = some.mapInArrow(run, f"h long, size long, shingles array<long>, {name} binary")
    if of.groupBy("h").agg(F.count("*").alias("n")).where("n > 1").limit(1).count():
        sets = sets.dropDuplicates(["h"])  # rows that repeat doc_id and text
    weight = 8 * F.col("size") + F.octet_length(name)
    return materialize(sets.join(broadcast_if_small(wanted), "h").select("key", "fp", "size", weight.cast("bigint").alias("weight"), "shingles", name), "whole-sets")


def simhash_links(sets: DataFrame) -> DataFrame:
    """(src, dst) pairs of sets (fp, simhash) that span those of linked fingerprints: each set of a fingerprint with the least one,
    and the least ones of fingerprints that op10's links join."""
    least = checkpointed(sets.groupBy("simhash").agg(F.min("fp").alias("least"), F.count("*").alias("n")))
    shared = checkpointed(least.where("n > 1"))
    same = spread_join(sets.select("simhash", "fp"), shared, "simhash", sets.count(), F.col("fp")).select(F.col("least").alias("src"), F.col("fp").alias("dst"))
    edges = checkpointed(fingerprint_links(least.select(F.col("simhash").alias("fp"))))
    of = lambda c, k: least.select(F.col("simhash").alias(c), F.col("least").alias(k))
    near = edges.select(F.col("src").alias("a"), F.col("dst").alias("b")).join(of("a", "src"), "a").join(of("b", "dst"), "b").select("src", "dst")
    return same.union(near).where("src <> dst")


def near_groups(docs: DataFrame) -> DataFrame:
    """A row per row of docs: doc_id, component_id (smallest doc_id reachable). Null ids as in simhash_groups."""
    release()  # what the driver held for stages before this one
    of = materialize(described(docs).withColumn("row", F.monotonically_increasing_id()), "near")
    once = one_a_set(of)
    dealt = once.select(F.posexplode("prefix").alias("pos", "key"), "fp", F.col("size").cast("int").alias("size")).select("key", "fp", "size", "pos")
    rows = paired(several(dealt)).join(once.select("fp", "sketch"), "fp").withColumn("weight", F.octet_length("sketch").cast("bigint") + 32)
    rows = materialize(rows, "near-shared")  # most shingles are in one set only
    edges = grouping.links(rows, within_bound, BUCKET_BYTES).union(simhash_links(once.select("fp", "simhash")))
    near = components(edges).withColumnRenamed("node", "fp")
    sets = whole_sets(docs, of, near, SHINGLE, "sketch", sketches)
    named = checkpointed(with_components(of.select("doc_id", "fp"), components(grouping.links(sets, similar, GROUP_BYTES))).select("doc_id", "component_id"))
    for used in (of, rows, sets):
        discard(used)
    return named

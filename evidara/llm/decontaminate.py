"""Benchmark decontamination by winnowing.

Texts lower-case A-Z and take words [^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+ . A window is WINDOW = 10 consecutive item words;
an item of fewer words, but not none, is one window. Of the 5-word grams in a 10-word window the one with the least hash
is its fingerprint. A document keeps the fingerprint of each of its own windows, so whatever it shares with an item over
ten or more words shares a fingerprint too. Fingerprints are joined to the benchmark's; every hit is extended to the
document windows around it, which are compared to the item windows first by hash and then word for word. Items under ten
words have no window to thin: all grams of their length are compared.

A benchmark of up to BLOCK_BYTES of text is indexed once and broadcast; documents are scanned where they are read, their
words found and hashed for a whole batch at once. A larger one is never held by one task: its windows are rows (mark,
digest, item), the fingerprints of documents that pass a fixed-size bitmap of its marks are joined to them, and only
documents with a joint fingerprint are read again, to give the digests (128 bits) of the windows around it, which are
joined to the item windows. Both joins split marks and passages that a large part of all documents share.

A null text has no words, nor has an empty one; a null item_id is no item; items that repeat an item_id count once.
A document row gives one row, repeated rows too, in any order; a table without rows gives none, a benchmark without items
no hits. A very long text is held whole by the task that reads it, at some ten bytes of tables for each of its own. Other
columns are not read; clean_documents keeps them as they are.
"""

from __future__ import annotations

import hashlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.core.broadcast import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ALNUM, WORD_BASE, Words, bitmap, broadcast_if_small, checkpointed, in_bitmap, kept_rows, materialize, mix64, pieces, polynomial, possibly_in, release, spread_join

WINDOW, GRAM, BLOCK_BYTES = 10, 5, 1 << 20
#: Bytes of text that clean_documents scans at a time: workers of a pipeline hold what earlier stages left.
STAGE_BYTES = 1 << 20


class Grams:
    """Hashes of all runs of words, from one pair of prefix sums."""

    def __init__(self, words: Words):
        self.doc, self.n = words.doc, len(words.doc)
        self.prefix, self.inverse = polynomial(words.hashes(), WORD_BASE)

    def at(self, first: np.ndarray, length: int) -> np.ndarray:
        return mix64((self.prefix[first + length] - self.prefix[first]) * self.inverse[first])

    def all(self, length: int) -> np.ndarray:
        n = max(0, self.n - length + 1)
        return mix64((self.prefix[length : length + n] - self.prefix[:n]) * self.inverse[:n])

    def inside(self, length: int) -> np.ndarray:
        """For each first word whether the run stays in its document."""
        n = max(0, self.n - length + 1)
        return self.doc[:n] == self.doc[length - 1 : length - 1 + n]


def least(hashes: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each `width` consecutive hashes."""
    have, out = 1, hashes
    while have < width:
        step = min(have, width - have)
        out = np.minimum(out[: len(out) - step], out[step:])
        have += step
    return out


def member(sorted_values: np.ndarray, x: np.ndarray) -> np.ndarray:
    if not len(sorted_values):
        return np.zeros(len(x), bool)
    return sorted_values[np.minimum(np.searchsorted(sorted_values, x), len(sorted_values) - 1)] == x


def build_index(items: list[tuple[str, bytes]]) -> dict:
    """Windows of the items by length, their hashes, and the fingerprints of those of full length."""
    words = Words([t.lower() for _, t in items], ALNUM)
    grams, windows = Grams(words), defaultdict(lambda: defaultdict(set))
    starts: dict[int, list[int]] = defaultdict(list)
    for i, (item, _) in enumerate(items):
        first, n = int(words.first[i]), int(words.count[i])
        length = min(n, WINDOW)
        text = [words.word(j) for j in range(first, first + n)]
        for s in range(n - length + 1 if n else 0):
            windows[length][b" ".join(text[s : s + length])].add(item)
            starts[length].append(first + s)
    hashes = {n: np.unique(grams.at(np.array(s), n)) for n, s in starts.items()}
    full = np.array(starts.get(WINDOW, []), np.int64)
    marks = np.unique(least(grams.all(GRAM), WINDOW - GRAM + 1)[full]) if len(full) else np.zeros(0, np.uint64)
    return {"windows": {n: {w: sorted(i) for w, i in found.items()} for n, found in windows.items()}, "hashes": hashes, "marks": marks}


def matches(words: Words, grams: Grams, index: dict) -> Iterator[tuple[int, int, list[str]]]:
    """(first word, length, items) of each window of the index that occurs in words."""
    for length, known in index["hashes"].items():
        inside = grams.inside(length)
        if length == WINDOW:
            mark = least(grams.all(GRAM), WINDOW - GRAM + 1)[: len(inside)]
            change = np.flatnonzero(np.concatenate(([True], mark[1:] != mark[:-1]))) if len(mark) else np.zeros(0, int)
            run = member(index["marks"], mark[change])
            first = np.flatnonzero(np.repeat(run, np.diff(np.append(change, len(mark)))) & inside)
        else:
            first = np.flatnonzero(inside)
        first = first[member(known, grams.at(first, length))]
        for s in first.tolist():
            found = index["windows"][length].get(b" ".join(words.word(j) for j in range(s, s + length)))
            if found:
                yield s, length, found


def scan(texts: list[bytes], index: dict) -> tuple[np.ndarray, np.ndarray, list[set[str]]]:
    """Words, hit words and items of each text."""
    words = Words([t.lower() for t in texts], ALNUM)
    grams, items = Grams(words), [set() for _ in texts]
    cover = np.zeros(len(words.doc) + 1, np.int64)
    for s, length, found in matches(words, grams, index):
        cover[s] += 1
        cover[s + length] -= 1
        items[words.doc[s]].update(found)
    hit = np.concatenate(([0], np.cumsum(np.cumsum(cover[:-1]) > 0)))
    return words.count, hit[words.first + words.count] - hit[words.first], items


def items_of(benchmark: DataFrame) -> tuple[DataFrame, int]:
    """Distinct (item_id, text) without nulls, and the bytes of their texts."""
    chosen = benchmark.select(F.col("item_id").cast("string").alias("item_id"), F.col("text").cast("string").alias("text")).dropna().distinct()
    return chosen, chosen.agg(F.sum(F.octet_length("text"))).first()[0] or 0


def shared_index(items: DataFrame) -> Broadcast:
    """The index of items of BLOCK_BYTES of text at most, which bounds it, as a broadcast."""
    return items.sparkSession.sparkContext.broadcast(build_index([(r.item_id, r.text.encode()) for r in items.collect()]))


def marked(words: Words, grams: Grams, length: int) -> tuple[np.ndarray, np.ndarray]:
    """First word and mark of each run of `length` words: the fingerprint of a window, or the hash of a shorter run."""
    first = np.flatnonzero(grams.inside(length))
    if length == WINDOW:
        return first, least(grams.all(GRAM), WINDOW - GRAM + 1)[first].view(np.int64)
    return first, mix64(grams.at(first, length) + np.uint64(length)).view(np.int64)


def digest_of(words: Words, first: int, length: int) -> bytes:
    return hashlib.blake2b(b"%d:" % length + b" ".join(words.word(i) for i in range(first, first + length)), digest_size=16).digest()


def item_windows(items: DataFrame) -> DataFrame:
    """(mark, length, digest, item_id) of the windows of items."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.int64(), pa.int32(), pa.binary(), pa.string()]
        for b in batches:
            names = b.column(0).to_pylist()
            for row, texts in pieces(b.column(1)):
                words, out = Words([t.lower() for t in texts], ALNUM), []
                grams = Grams(words)
                length_of = np.minimum(words.count, WINDOW)
                for n in np.unique(length_of[length_of > 0]).tolist():
                    first, mark = marked(words, grams, n)
                    own = length_of[words.doc[first]] == n
                    out += [(m, n, digest_of(words, f, n), names[row + words.doc[f]]) for f, m in zip(first[own].tolist(), mark[own].tolist())]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out) if out else [()] * 4, kinds)], ["mark", "length", "digest", "item_id"])

    return items.mapInArrow(run, "mark long, length int, digest binary, item_id string")


def joined_hits(rows: DataFrame, items: DataFrame) -> DataFrame:
    """(doc, h, n_hit, items) of the rows (doc, h, text) with a window of items, by a join of fingerprints."""
    spark = rows.sparkSession
    windows = materialize(item_windows(items).distinct(), "benchmark")
    marks = checkpointed(windows.select(F.col("mark").alias("id")).distinct())
    lengths = [r.length for r in windows.select("length").distinct().collect()]  # WINDOW at most
    bits = spark.sparkContext.broadcast(bitmap(marks, marks.count(), hashed=True))

    def fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for row, texts in pieces(b.column(2)):
                words = Words([t.lower() for t in texts], ALNUM)
                grams = Grams(words)
                for n in lengths:
                    first, mark = marked(words, grams, n)
                    some = in_bitmap(bits.value, mark)
                    pairs = np.unique(np.column_stack([words.doc[first[some]], mark[some]]), axis=0)
                    at = pa.array(pairs[:, 0] + row)
                    yield pa.RecordBatch.from_arrays([b.column(0).take(at), b.column(1).take(at), pa.array(pairs[:, 1])], ["doc", "h", "mark"])

    def around(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.binary()]
        for b in batches:
            docs, hs = b.column(0).to_pylist(), b.column(1).to_pylist()
            for row, texts in pieces(b.column(2)):
                words, out = Words([t.lower() for t in texts], ALNUM), []
                grams = Grams(words)
                for n in lengths:
                    first, mark = marked(words, grams, n)
                    stops = np.searchsorted(words.doc[first], np.arange(len(texts) + 1))
                    for d in range(len(texts)):
                        own = slice(stops[d], stops[d + 1])
                        wanted = b.column(3)[row + d].values.to_numpy()
                        for f in first[own][np.isin(mark[own], wanted)].tolist():
                            out.append((docs[row + d], hs[row + d], f - int(words.first[d]), n, digest_of(words, f, n)))
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out) if out else [()] * 5, kinds)], ["doc", "h", "first", "length", "digest"])

    by = F.xxhash64("doc", "h")
    found = materialize(rows.mapInArrow(fingerprints, "doc long, h long, mark long"), "fingerprints")
    shared = checkpointed(found.groupBy("mark").agg(F.count("*").alias("n")).join(marks.withColumnRenamed("id", "mark"), "mark", "left_semi"))
    known = spread_join(found, shared, "mark", found.count(), by).groupBy("doc", "h").agg(F.collect_set("mark").alias("marks"))
    known = checkpointed(known)
    some = possibly_in(rows, known.select(F.col("doc").alias("id")))
    places = materialize(some.dropDuplicates(["doc", "h"]).join(known, ["doc", "h"]).select("doc", "h", "text", "marks").mapInArrow(around, "doc long, h long, first int, length int, digest binary"), "places")
    counts = places.groupBy("digest").agg(F.count("*").alias("n"))
    listed = checkpointed(windows.groupBy("digest").agg(F.collect_set("item_id").alias("ids")).join(counts, "digest"))
    hits = checkpointed(spread_join(places, listed, "digest", places.count(), by).select("doc", "h", "first", "length", "ids"))
    merged = "aggregate(array_sort(spans), named_struct('stop', 0, 'n', 0L), (a, s) -> named_struct('stop', greatest(a.stop, s.first + s.length), 'n', a.n + greatest(0, s.first + s.length - greatest(a.stop, s.first))), a -> a.n)"
    spans = hits.groupBy("doc", "h").agg(F.collect_set(F.struct("first", "length")).alias("spans")).select("doc", "h", F.expr(merged).alias("n_hit"))
    names = hits.select("doc", "h", F.explode("ids").alias("item")).distinct().groupBy("doc", "h").agg(F.array_sort(F.collect_list("item")).alias("items"))
    return checkpointed(spans.join(names, ["doc", "h"]))


def keyed(docs: DataFrame) -> DataFrame:
    """(doc_id, doc, h, text): equal rows have equal keys, rows with other texts or, but for null, other ids have other ones."""
    text, doc_id = F.coalesce(F.col("text").cast("string"), F.lit("")), F.col("doc_id").cast("long")
    h = F.when(doc_id.isNull(), F.xxhash64(text, F.lit("null"))).otherwise(F.xxhash64(text))
    return docs.select(doc_id.alias("doc_id"), F.coalesce(doc_id, h).alias("doc"), h.alias("h"), text.alias("text"))


#: The words of a text as it is, before it is lower-cased.
WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"


def decontaminate(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """A row per row of docs: doc_id, n_words, n_hit, n_items, items_sha256, contaminated, and the item_ids themselves."""
    chosen, size = items_of(benchmark)
    if size > BLOCK_BYTES:
        rows = keyed(docs)
        hits = joined_hits(rows.select("doc", "h", "text"), chosen)
        names = F.coalesce("items", F.expr("cast(array() as array<string>)"))
        n_hit = F.coalesce("n_hit", F.lit(0).cast("bigint"))
        sizes = rows.select("doc_id", "doc", "h", F.regexp_count("text", F.lit(WORD)).cast("bigint").alias("n_words"))
        return sizes.join(broadcast_if_small(hits), ["doc", "h"], "left").select(
            "doc_id", "n_words", n_hit.alias("n_hit"), F.size(names).cast("bigint").alias("n_items"),
            F.sha2(F.array_join(names, ",").cast("binary"), 256).alias("items_sha256"), (n_hit > 0).alias("contaminated"), names.alias("items"),
        )
    index = shared_index(chosen)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for first, texts in pieces(b.column(1)):
                n, hit, items = scan(texts, index.value)
                names = [sorted(i) for i in items]
                yield pa.RecordBatch.from_arrays(
                    [
                        b.column(0).slice(first, len(texts)), pa.array(n, pa.int64()), pa.array(hit, pa.int64()), pa.array(list(map(len, names)), pa.int64()),
                        pa.array([hashlib.sha256(",".join(i).encode()).hexdigest() for i in names]), pa.array(hit > 0), pa.array(names, pa.list_(pa.string())),
                    ],
                    ["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated", "items"],
                )

    chosen = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return chosen.mapInArrow(run, "doc_id long, n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean, items array<string>")


def clean_documents(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """docs without those that hold a benchmark window; judged row by row, in place, or by a join of fingerprints."""
    items, size = items_of(benchmark)
    if size > BLOCK_BYTES:
        hits = broadcast_if_small(joined_hits(keyed(docs).select("doc", "h", "text"), items).select("doc", "h"))
        own, text = F.col("doc_id").cast("long"), F.coalesce(F.col("text").cast("string"), F.lit(""))
        h = F.when(own.isNull(), F.xxhash64(text, F.lit("null"))).otherwise(F.xxhash64(text))
        return docs.join(hits, (F.coalesce(own, h) == hits.doc) & (h == hits.h), "left_anti")
    index, at = shared_index(items), docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keep = [not h for _, texts in pieces(b.column(at), STAGE_BYTES) for h in scan(texts, index.value)[1]]
            yield b.filter(pa.array(keep, pa.bool_()))
        release()

    return kept_rows(docs, run)


ORACLE = r"""
WITH di AS (SELECT doc_id, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) AS w FROM documents),
iw AS (SELECT item_id::VARCHAR AS item, w, least(10, len(w)) AS n FROM (SELECT item_id, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) AS w FROM benchmark) WHERE len(w) > 0 AND item_id IS NOT NULL),
win AS (SELECT DISTINCT item, n, array_to_string(w[s:s + n - 1], ' ') AS t FROM (SELECT item, n, w, unnest(range(1, len(w) - n + 2)) AS s FROM iw)),
dw AS (SELECT doc_id, s, n, array_to_string(w[s:s + n - 1], ' ') AS t FROM (SELECT doc_id, w, l.n, unnest(range(1, len(w) - l.n + 2)) AS s FROM di, (SELECT DISTINCT n FROM iw) l)),
hit AS (SELECT doc_id, s, dw.n, item FROM dw JOIN win ON dw.n = win.n AND dw.t = win.t),
words AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(s, s + n)) AS p FROM hit) GROUP BY doc_id),
items AS (SELECT doc_id, list_sort(list(DISTINCT item)) AS items FROM hit GROUP BY doc_id)
SELECT di.doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(len(items), 0)::BIGINT AS n_items,
       sha256(array_to_string(coalesce(items, []::VARCHAR[]), ',')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM di LEFT JOIN words ON di.doc_id = words.doc_id LEFT JOIN items ON di.doc_id = items.doc_id
"""

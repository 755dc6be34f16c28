"""Exact substring deduplication with suffix automata over reference shards.

A window is WINDOW consecutive words [^\\x20\\x09-\\x0D]+ of one document. A word is removed if a window that covers it also
starts earlier: in a document of smaller doc_id, or in the same one before. Windows are judged on the input.

1. Rows with equal texts (SHA-256) collapse to their smallest doc_id: of a copy with a window every word is removed.
2. A window's anchor is the least hash among its GRAM-word grams, so equal windows have equal anchors. Each run of
   windows with one anchor gives a row (anchor, doc_id); anchors with one run in all documents, where the run
   has its anchor once, hold nothing repeated.
3. The other runs are the reference. Their texts are dealt by anchor, which makes a shard of the few runs that can share
   a window at all. A suffix automaton of the shard's distinct runs is built in document order; the length of the suffix
   link of its newest state is the matching statistic of the stream at that word: the longest suffix seen before. Where
   it reaches WINDOW, the window that ends there is a repeat.
4. Anchors of more than SHARD runs, or more than SHARD_WORDS words, go another exact way: equal runs collapse to the earliest, and the different windows
   of what is left are dealt by a 128-bit digest, combined to the first position before the shuffle, and compared to it.

The method's automata would be broadcast; a reference as large as the corpus has no size bound, and every document would
stream through every shard. Dealing both by anchor gives each document exactly the shards that it can match, once.

Null texts have no words, and a table without rows gives none. A null doc_id counts as larger than any other; rows
without one are documents of their own, in order of a hash of their text. Rows that share a doc_id but not the text are
ordered by start, then by hash of text; rows that share both give equal results. Very long texts: a text is held whole by
the task that reads it, at some ten bytes of tables for each of its own. Other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import KERNEL_BYTES, NOT_SPACE, Words, as_bytes, checkpointed, discard, materialize, pieces, possibly_in, spread_join
from .decontaminate import Grams, least

WINDOW, GRAM, EMIT = 20, 10, 50_000
#: Runs, and words of these runs, that a shard has at most.
SHARD, SHARD_WORDS = 2000, 1 << 17


class SuffixAutomaton:
    """Online suffix automaton over integers; add gives the length of the longest suffix that occurred before."""

    def __init__(self):
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length, self.last = [-1], [0], 0

    def add(self, c: int) -> int:
        nxt, link, length = self.next, self.link, self.length
        cur, p = len(nxt), self.last
        nxt.append({})
        length.append(length[p] + 1)
        link.append(0)
        while p >= 0 and c not in nxt[p]:
            nxt[p][c] = cur
            p = link[p]
        if p >= 0:
            q = nxt[p][c]
            if length[q] != length[p] + 1:
                copy = len(nxt)
                nxt.append(dict(nxt[q]))
                length.append(length[p] + 1)
                link.append(link[q])
                link[q] = copy
                while p >= 0 and nxt[p].get(c) == q:
                    nxt[p][c] = copy
                    p = link[p]
                q = copy
            link[cur] = q
        self.last = cur
        return length[link[cur]]


def repeats(shard: list[tuple[int, int, int, bytes]]) -> Iterator[tuple[int, int, int, int]]:
    """(doc, text hash, first word, end) of repeated windows of runs (doc, start, text hash, words) in order."""
    automaton, ids, seen, before = SuffixAutomaton(), {}, set(), None
    for n, (doc_id, start, text, words) in enumerate(shard):
        if (doc_id, start, text) == before:
            continue  # the same row again
        before = (doc_id, start, text)
        tokens = words.split(b" ")
        if words in seen:
            yield doc_id, text, start, start + len(tokens)
            continue
        seen.add(words)
        automaton.add(-1 - n)  # nothing matches across runs
        first = stop = -1
        for i, token in enumerate(tokens):
            if automaton.add(ids.setdefault(token, len(ids))) >= WINDOW:
                if stop < i - WINDOW + 1:
                    if stop > 0:
                        yield doc_id, text, start + first, start + stop
                    first = i - WINDOW + 1
                stop = i + 1
        if stop > 0:
            yield doc_id, text, start + first, start + stop


class Runs:
    """Runs of windows with one anchor: text, first word in it, number of windows, anchor."""

    def __init__(self, texts: list[bytes]):
        self.words = w = Words(texts, NOT_SPACE)
        grams = Grams(w)
        at = np.flatnonzero(grams.inside(WINDOW))
        hashes, span = grams.all(GRAM), WINDOW - GRAM + 1
        anchor, doc = least(hashes, span)[at], w.doc[at]
        new = np.flatnonzero(np.concatenate(([True], (anchor[1:] != anchor[:-1]) | (doc[1:] != doc[:-1])))) if len(at) else np.zeros(0, np.int64)
        self.at, self.doc, self.anchor = at[new], doc[new], anchor[new].view(np.int64)
        self.windows = np.diff(np.append(new, len(at)))
        last, offsets = self.at + self.windows - 1, np.arange(span)
        one = (hashes[self.at[:, None] + offsets] == anchor[new][:, None]).argmax(axis=1)
        two = (hashes[last[:, None] + offsets[::-1]] == anchor[new][:, None]).argmax(axis=1)
        #: Whether the anchor stands in the run more than once, so that the run may repeat itself.
        self.loops = self.at + one < last + span - 1 - two

    def text(self, i: int) -> bytes:
        a, b = self.at[i], self.at[i] + self.windows[i] + WINDOW - 2
        return b" ".join(self.words.data[self.words.start[a] : self.words.end[b]].split())


def anchors(rows: DataFrame) -> DataFrame:
    """(anchor, doc, words) of each run of rows (doc, text); twice where the run may repeat itself."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            docs = b.column(0).to_numpy()
            for first, texts in pieces(b.column(1)):
                r = Runs(texts)
                times = 1 + r.loops
                columns = (r.anchor, docs[first + r.doc], (r.windows + WINDOW - 1).astype(np.int32))
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(c, times)) for c in columns], ["anchor", "doc", "words"])

    return rows.mapInArrow(run, "anchor long, doc long, words int")


RUN = "anchor long, hot boolean, nul boolean, doc long, start long, h long, words binary"


def reference(joined: DataFrame) -> DataFrame:
    """Runs of rows (nul, doc, h, text, cold, hot, copies) whose anchor is in cold or hot, unless h is in copies."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, kinds = [x.split()[0] for x in RUN.split(", ")], [pa.int64(), pa.bool_(), pa.bool_(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]
        for b in batches:
            nul, docs, h = (b.column(i).to_pylist() for i in range(3))
            for first, texts in pieces(b.column(3)):
                r, out, size = Runs(texts), [], 0
                stops = np.searchsorted(r.doc, np.arange(len(texts) + 1))
                for d in range(len(texts)):
                    row = first + d
                    if h[row] in (b.column(6)[row].as_py() or ()):
                        continue
                    own = r.anchor[stops[d] : stops[d + 1]]
                    for kind, column in ((False, 4), (True, 5)):
                        wanted = b.column(column)[row].values
                        if wanted is not None and len(wanted):
                            for i in (np.flatnonzero(np.isin(own, wanted.to_numpy())) + stops[d]).tolist():
                                out.append((int(r.anchor[i]), kind, nul[row], docs[row], int(r.at[i] - r.words.first[d]), h[row], r.text(i)))
                                size += len(out[-1][-1])
                                if size > KERNEL_BYTES:
                                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), kinds)], names)
                                    out, size = [], 0
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), kinds)], names)

    return joined.mapInArrow(run, RUN)


RANGE = "doc long, h long, first long, stop long"


def ranges(found: list[tuple[int, int, int, int]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in (zip(*found) if found else [()] * 4)], ["doc", "h", "first", "stop"])


def shard_repeats(runs: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = (row for b in batches for row in zip(*(b.column(i).to_pylist() for i in range(5))))
        found: list[tuple[int, int, int, int]] = []
        for _, shard in groupby(rows, lambda row: row[0]):
            members = [row[1:] for row in shard]  # SHARD runs and SHARD_WORDS words at most
            found += repeats(members)
            if len(found) > EMIT:
                yield ranges(found)
                found = []
        yield ranges(found)

    ordered = runs.repartition("anchor").sortWithinPartitions("anchor", "nul", "doc", "start", "h")
    return ordered.select("anchor", "doc", "start", "h", "words").mapInArrow(run, RANGE)


def windows_once(words: bytes) -> Iterator[tuple[int, int, bytes | None]]:
    """(first, stop, digest) of each different window of a run, where it comes first, and (first, stop, None) of the word
    ranges that its repeats inside the run cover."""
    tokens, seen, a, b = words.split(b" "), set(), 0, 0
    for i in range(len(tokens) - WINDOW + 1):
        digest = hashlib.blake2b(b" ".join(tokens[i : i + WINDOW]), digest_size=16).digest()
        if digest not in seen:
            seen.add(digest)
            yield i, i + WINDOW, digest
            continue
        if b < i:
            if b:
                yield a, b, None
            a = i
        b = i + WINDOW
    if b:
        yield a, b, None


def window_repeats(runs: DataFrame) -> DataFrame:
    """Ranges of runs whose anchor is too common for a shard.

    Equal runs first: all but the earliest are repeats from end to end. Of the others each different window is dealt by
    its digest once, however often the run holds it. Joins split what is common.
    """
    place = F.struct("nul", "doc", "start", "h")
    stop = F.size(F.split(F.col("words").cast("string"), " ")) + F.col("start")
    keyed = checkpointed(runs.select(F.unhex(F.sha2("words", 256)).alias("run"), "nul", "doc", "start", "h", stop.alias("stop")))
    earliest = checkpointed(keyed.groupBy("run").agg(F.min(place).alias("p"), F.count("*").alias("n")))
    equal = spread_join(keyed, earliest.where("n > 1"), "run", keyed.count(), F.xxhash64("doc", "start"))
    equal = equal.where(place > F.col("p")).select("doc", "h", F.col("start").alias("first"), "stop")
    firsts = runs.join(earliest.select("p.*"), ["nul", "doc", "start", "h"], "left_semi").select("nul", "doc", "h", "start", "words")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.bool_(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]
        batch = lambda out: pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out) if out else [()] * 6, kinds)], ["nul", "doc", "h", "first", "stop", "digest"])
        out: list[tuple] = []
        for b in batches:
            for nul, doc, h, start, words in zip(*(b.column(i).to_pylist() for i in range(5))):
                for first, stop, digest in windows_once(words):
                    out.append((nul, doc, h, start + first, start + stop, digest))
                    if len(out) >= EMIT:
                        yield batch(out)
                        out = []
        yield batch(out)

    every = materialize(firsts.mapInArrow(run, f"nul boolean, {RANGE}, digest binary"), "windows")
    at = F.struct("nul", "doc", "first", "h")
    once = every.where("digest IS NOT NULL")
    shared = checkpointed(once.groupBy("digest").agg(F.min(at).alias("p"), F.max(at).alias("q"), F.count("*").alias("n")).where("p <> q").drop("q"))
    later = spread_join(once, shared, "digest", every.count(), F.xxhash64("doc", "first")).where(at > F.col("p")).select("doc", "h", "first", "stop")
    return equal.union(every.where("digest IS NULL").select("doc", "h", "first", "stop")).union(later)


def repeated_ranges(rows: DataFrame, copies: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(doc, h, gone: array of first and stop) for rows (nul, doc, h, text), the rows that may have such, and their runs; copies (doc, copies)."""
    found = materialize(anchors(rows.select("doc", "text")), "anchors")
    counts = found.groupBy("anchor").agg(F.count("*").alias("n"), F.sum("words").alias("words")).where("n > 1")
    counts = checkpointed(counts.select("anchor", "n", ((F.col("n") > SHARD) | (F.col("words") > SHARD_WORDS)).alias("common")))
    known = spread_join(found.select("anchor", "doc"), counts, "anchor", found.count(), F.xxhash64("doc")).groupBy("doc")
    known = known.agg(*(F.collect_set(F.when(F.col("common") == hot, F.col("anchor"))).alias(name) for name, hot in (("cold", False), ("hot", True))))
    known = materialize(known, "known")
    discard(found)
    some = possibly_in(rows, known.select(F.col("doc").alias("id")))
    joined = some.join(known, "doc").join(copies, "doc", "left").select("nul", "doc", "h", "text", "cold", "hot", "copies")
    joined = materialize(joined, "referenced")
    discard(known)
    runs = materialize(reference(joined), "runs")
    ranges = shard_repeats(runs.where("NOT hot")).union(window_repeats(runs.where("hot")))
    ranges = ranges.groupBy("doc", "h").agg(F.collect_list(F.struct("first", "stop")).alias("gone"))
    return materialize(ranges, "ranges"), joined, runs


def digests(rows: DataFrame) -> DataFrame:
    """(nul, doc, h, digest of the text, n_words, kept_sha256 of all words) for rows (nul, doc, h, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = [(hashlib.sha256(t).digest(), len(w := t.split()), hashlib.sha256(b" ".join(w)).hexdigest()) for t in as_bytes(b.column(3))]
            columns = [pa.array(c, t) for c, t in zip(zip(*out) if out else [()] * 3, (pa.binary(), pa.int64(), pa.string()))]
            yield pa.RecordBatch.from_arrays([*b.columns[:3], *columns], ["nul", "doc", "h", "digest", "n_words", "kept_sha256"])

    return rows.mapInArrow(run, "nul boolean, doc long, h long, digest binary, n_words long, kept_sha256 string")


def shortened(rows: DataFrame) -> DataFrame:
    """(doc, h, n_kept, kept_sha256, kept) of rows (doc, h, text, gone)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for text, gone in zip(as_bytes(b.column(2)), b.column(3)):
                words = text.split()
                keep = np.ones(len(words), bool)
                for r in gone.as_py():
                    keep[r["first"] : r["stop"]] = False
                left = [words[k] for k in np.flatnonzero(keep).tolist()]
                joined = b" ".join(left)
                out.append((len(left), hashlib.sha256(joined).hexdigest(), joined.decode()))
            columns = [pa.array(c, t) for c, t in zip(zip(*out) if out else [()] * 3, (pa.int64(), pa.string(), pa.string()))]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), *columns], ["doc", "h", "n_kept", "kept_sha256", "kept"])

    return rows.mapInArrow(run, "doc long, h long, n_kept long, kept_sha256 string, kept string")


def remove_repeats(docs: DataFrame, texts: bool = False) -> DataFrame:
    """A row per row of docs: doc_id, n_words, n_removed, kept_sha256, and kept (the text that is left) if asked for."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    doc_id = F.col("doc_id").cast("long")
    h = F.when(doc_id.isNull(), F.xxhash64(text, F.lit("null"))).otherwise(F.xxhash64(text))
    rows = docs.select(doc_id.isNull().alias("nul"), F.coalesce(doc_id, h).alias("doc"), h.alias("h"), text.alias("text"))
    whole = materialize(digests(rows), "digests")
    who = F.struct("nul", "doc")
    first = whole.groupBy("digest").agg(F.min(who).alias("original"), F.max(who).alias("latest"), F.count("*").alias("n")).where("original <> latest").drop("latest")
    copied = spread_join(whole.select("nul", "doc", "h", "digest"), checkpointed(first), "digest", whole.count(), F.xxhash64("doc"))
    copied = checkpointed(copied.where(who > F.col("original")).select("doc", "h").distinct())
    copies = checkpointed(copied.groupBy("doc").agg(F.collect_set("h").alias("copies")))
    gone, referenced, runs = repeated_ranges(rows, copies)
    discard(runs)
    some = possibly_in(referenced.select("doc", "h", "text"), gone.select(F.col("doc").alias("id")).distinct())
    short = shortened(some.join(gone, ["doc", "h"]).select("doc", "h", "text", "gone"))
    short = materialize(short if texts else short.drop("kept").dropDuplicates(["doc", "h"]), "shortened")
    discard(referenced)
    discard(gone)
    short = short.dropDuplicates(["doc", "h"]) if texts else short
    own = short.select("doc", "h", "n_kept", F.col("kept_sha256").alias("short_sha256"), *(["kept"] if texts else []))
    both = whole.join(copied.withColumn("copy", F.lit(True)), ["doc", "h"], "left").join(own, ["doc", "h"], "left")
    empty = F.col("copy").isNotNull() & (F.col("n_words") >= WINDOW)
    left = F.when(empty, 0).otherwise(F.coalesce("n_kept", "n_words"))
    columns = [
        F.when(~F.col("nul"), F.col("doc")).alias("doc_id"), "n_words", (F.col("n_words") - left).alias("n_removed"),
        F.when(empty, F.sha2(F.lit(b""), 256)).otherwise(F.coalesce("short_sha256", "kept_sha256")).alias("kept_sha256"),
    ]
    if not texts:
        return both.select(*columns)
    once = rows.dropDuplicates(["doc", "h"]).select("doc", "h", F.col("text").alias("whole"))
    words = F.array_join(F.regexp_extract_all("whole", F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0)), " ")
    return both.join(once, ["doc", "h"]).select(*columns, F.when(empty, "").otherwise(F.coalesce("kept", words)).alias("kept"))


ORACLE = r"""
WITH d AS (SELECT doc_id, coalesce(regexp_extract_all(text, '[^\x20\x09-\x0D]+'), []) AS w FROM documents),
win AS (SELECT doc_id, s, sha256(array_to_string(w[s:s + 19], ' ')) AS t FROM (SELECT doc_id, w, unnest(range(1, len(w) - 18)) AS s FROM d)),
rep AS (SELECT doc_id, s FROM (SELECT doc_id, s, row_number() OVER (PARTITION BY t ORDER BY doc_id, s) AS k FROM win) WHERE k > 1),
gone AS (SELECT DISTINCT doc_id, unnest(range(s, s + 20)) AS p FROM rep),
kept AS (SELECT doc_id, array_agg(word ORDER BY p) AS k FROM (SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS p FROM d) x
         WHERE NOT EXISTS (SELECT 1 FROM gone g WHERE g.doc_id = x.doc_id AND g.p = x.p) GROUP BY doc_id)
SELECT d.doc_id, len(w)::BIGINT AS n_words, (len(w) - coalesce(len(k), 0))::BIGINT AS n_removed, sha256(array_to_string(coalesce(k, []), ' ')) AS kept_sha256
FROM d LEFT JOIN kept ON d.doc_id = kept.doc_id
"""

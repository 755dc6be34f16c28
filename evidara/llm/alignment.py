"""Cross-tokenizer alignment through a dictionary of token groups.

A text is encoded by two tokenizers, A (byte-level BPE) and B (pieces with byte fallback). Byte offsets at which tokens of both
end cut it into groups; an A token and a B token whose byte ranges overlap are linked, always inside one group. Which links a
group has depends on its ids alone, so groups are interned: a worker numbers each different one it meets, expands its links
once, and describes a document by the numbers of its groups and how often each occurs. Documents that hold a linked pair are
counted in the task from the distinct groups of each document, and summed by pair. Groups are then a table of their own
(`groups`), whose links are expanded once each and joined to the counts of pairs; what a group adds to a document (the sum of
counts, the links that are the best of their A id) comes back to documents by group key.

The HEAD groups that most documents hold come back as a broadcast of fixed size; the others, none of which can hold more than
one in HEAD of all rows, by a shuffled join. Keys are 64-bit hashes of the ids; a collision is found and raised as an error.

Texts are parted before spaces that follow a character which is no white space: both tokenizers always end a token there (A's
pattern starts a match at it, no piece of B has a space after another character), so each different part is encoded once by a
worker. The rules of both files are compared with those that this holds for; with others whole texts are encoded.

Null and empty texts, texts that are not UTF-8, and texts whose tokens' bytes are not the text itself have no tokens: zeros and
an empty digest. Repeated rows and doc_ids are rows of their own, and each counts as a document; a null doc_id is kept. A table
without rows gives none. A very long text is taken alone. Other columns are not read.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import as_bytes, broadcast_if_small, checkpointed, materialize, release, spread_join, worker_cache

#: Groups whose sums are broadcast; bytes of text taken at a time; parts, groups and bytes of parts that a worker keeps; rows of a batch of counts.
HEAD, TEXT_BYTES, KEPT_PARTS, KEPT_GROUPS, KEPT_BYTES, COUNT_ROWS = 65_536, 1 << 20, 300_000, 300_000, 16 << 20, 50_000
WORD_START = "▁"
#: Parts of a text: spaces, what follows, and further spaces where the character before them is white space itself.
NO_SPACE_BEFORE = rb"(?:(?<=[\t-\r\x1c-\x1f])|(?<=\xc2[\x85\xa0])|(?<=\xe1\x9a\x80)|(?<=\xe1\xa0\x8e)|(?<=\xe2\x80[\x80-\x8a\xa8\xa9\xaf])|(?<=\xe2\x81\x9f)|(?<=\xe3\x80\x80))"
PARTS = re.compile(rb" +[^ ]*(?:" + NO_SPACE_BEFORE + rb" +[^ ]*)*")
DOCUMENT, GROUP, PAIR = 0, 1, 2
SCHEMA = "kind int, doc_id long, n_a long, n_b long, n_groups long, n_links long, digest string, keys array<long>, times array<int>, key long, ids string, n long"


def byte_alphabet() -> dict[str, int]:
    """The byte that each character of a byte-level vocabulary stands for: printable ones for themselves, others from 256 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(others)}


def entry_bytes(tokenizer) -> list[bytes]:
    """The bytes of each id of a byte-level tokenizer."""
    alphabet, out = byte_alphabet(), [b""] * tokenizer.get_vocab_size(with_added_tokens=True)
    for entry, i in tokenizer.get_vocab().items():
        out[i] = bytes(alphabet[c] for c in entry) if all(c in alphabet for c in entry) else entry.encode()
    return out


def piece_bytes(processor) -> list[bytes]:
    """The bytes of each id of a piece model."""
    pieces = [processor.id_to_piece(i) for i in range(processor.get_piece_size())]
    return [bytes([int(p[3:5], 16)]) if processor.is_byte(i) else p.replace(WORD_START, " ").encode() for i, p in enumerate(pieces)]


def parts_end_at_spaces(path: str, processor) -> bool:
    """Whether both files have the rules under which PARTS are encoded one by one."""
    with open(path, encoding="utf-8") as f:
        rules = json.load(f)
    model, split = rules["model"], rules.get("pre_tokenizer") or {}
    plain = not any(model.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "fuse_unk", "byte_fallback", "ignore_merges"))
    a = plain and model.get("type") == "BPE" and rules.get("normalizer") is None and split.get("type") == "ByteLevel" and split.get("use_regex") and not split.get("add_prefix_space")
    pieces = (processor.id_to_piece(i) for i in range(processor.get_piece_size()))
    b = not any(WORD_START in p.lstrip(WORD_START) for p in pieces)
    probe, data = "  x ﬁ① ", piece_bytes(processor)
    return bool(a and b and b"".join(data[i] for i in processor.encode(probe)) == (" " + probe).encode())


def spread(begin: np.ndarray, count: np.ndarray) -> np.ndarray:
    """Positions begin[i] .. begin[i] + count[i] - 1 of all i, in turn."""
    ends = np.cumsum(count)
    return np.repeat(begin - (ends - count), count) + np.arange(ends[-1] if len(ends) else 0)


class Numbers(dict):
    """Numbers keys as they are first looked up; fresh lists those that came since it was last emptied."""

    def __init__(self):
        self.fresh: list = []

    def __missing__(self, key) -> int:
        self.fresh.append(key)
        self[key] = n = len(self)
        return n


class Ragged:
    """Lists of numbers that grow by whole blocks."""

    def __init__(self):
        self.flat, self.begin, self.count = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)

    def add(self, flat: np.ndarray, count: np.ndarray) -> None:
        self.begin = np.concatenate((self.begin, len(self.flat) + np.cumsum(count) - count))
        self.count, self.flat = np.concatenate((self.count, count)), np.concatenate((self.flat, flat))

    def of(self, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The lists of which, in turn, and how long each is."""
        count = self.count[which]
        return self.flat[spread(self.begin[which], count)], count


def ends_of(ids: np.ndarray, size: np.ndarray) -> np.ndarray:
    return np.cumsum(size[ids], dtype=np.int64)


class Aligner:
    """Two tokenizers with the parts, groups and pairs that a worker has met; counts of documents are those of a task."""

    def __init__(self, a: str, b: str):
        os.environ.setdefault("RAYON_NUM_THREADS", "1")
        import sentencepiece
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(a)
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_file=b)
        self.a_bytes, self.b_bytes = entry_bytes(self.a), piece_bytes(self.b)
        self.a_size, self.b_size = (np.array(list(map(len, x)), np.int64) for x in (self.a_bytes, self.b_bytes))
        self.space = self.b.piece_to_id(WORD_START)
        self.parted = parts_end_at_spaces(a, self.b)
        self.forget()

    def forget(self) -> None:
        self.parts, self.groups, self.pairs = Numbers(), Numbers(), Numbers()
        self.kept = 0
        self.facts = np.zeros((0, 5), np.int64)  # of parts: ids of A, ids of B, groups, links, whether the bytes are the text's
        self.text: list[str] = []
        self.part_groups, self.group_pairs = Ragged(), Ragged()
        self.keys, self.uses = np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.begin()

    def full(self) -> bool:
        return len(self.groups) > KEPT_GROUPS or self.kept > KEPT_BYTES

    def trim(self) -> None:
        """Keep the half of the parts that were looked up most; groups and pairs stay."""
        keep = np.sort(np.argsort(self.uses, kind="stable")[-(KEPT_PARTS // 2) :])
        names, text, (flat, count) = list(self.parts), self.text, self.part_groups.of(keep)
        self.parts, self.part_groups = Numbers(), Ragged()
        self.parts.update((names[i], n) for n, i in enumerate(keep.tolist()))
        self.part_groups.add(flat, count)
        self.text, self.facts, self.uses = [text[i] for i in keep.tolist()], self.facts[keep], self.uses[keep] // 2
        self.kept = sum(map(len, self.parts))

    def begin(self) -> None:
        """A task begins: no document is counted yet."""
        self.group_n, self.pair_n = np.zeros(len(self.groups), np.int64), np.zeros(len(self.pairs), np.int64)

    def learn(self) -> None:
        """Encode the fresh parts, and expand the links of the groups that are new."""
        fresh, self.parts.fresh = self.parts.fresh, []
        self.kept += sum(map(len, fresh))
        text = [p.decode() for p in fresh]
        a = [e.ids for e in self.a.encode_batch_fast(text, add_special_tokens=False)]
        b = [ids or [self.space] for ids in self.b.encode([t[1:] for t in text], num_threads=1)]
        good = [b"".join([self.a_bytes[i] for i in x]) == p == b"".join([self.b_bytes[i] for i in y]) for x, y, p in zip(a, b, fresh)]
        kept = np.flatnonzero(good)
        a, b = [a[i] for i in kept], [b[i] for i in kept]
        n_a, n_b = (np.fromiter(map(len, x), np.int64, len(x)) for x in (a, b))
        a_ids, b_ids = (np.fromiter((i for ids in x for i in ids), np.int64, int(n.sum())) for x, n in ((a, n_a), (b, n_b)))
        a_end, b_end = ends_of(a_ids, self.a_size), ends_of(b_ids, self.b_size)
        part_end = np.cumsum(np.fromiter((len(fresh[i]) for i in kept), np.int64, len(kept)))
        common, every = np.intersect1d(a_end, b_end, assume_unique=True), np.union1d(a_end, b_end)
        # Between two ends that follow each other lie bytes of one token of A and one of B: a link.
        links = (a_ids[np.searchsorted(a_end, every)] << 32) | b_ids[np.searchsorted(b_end, every)]
        stop_a, stop_b, stop_link = (np.searchsorted(x, common, side="right") for x in (a_end, b_end, every))
        a_text, b_text = list(map(str, a_ids.tolist())), list(map(str, b_ids.tolist()))
        names, i, j = [], 0, 0
        for p, q in zip(stop_a.tolist(), stop_b.tolist()):
            names.append(f"{','.join(a_text[i:p])}|{','.join(b_text[j:q])}")
            i, j = p, q
        which = np.fromiter(map(self.groups.__getitem__, names), np.int64, len(names))
        self.expand(which, links, stop_link)
        stop = np.searchsorted(common, part_end, side="right")
        groups = np.diff(stop, prepend=0)
        n_links = np.diff(np.searchsorted(every, part_end, side="right"), prepend=0)
        facts, count = np.zeros((len(fresh), 5), np.int64), np.zeros(len(fresh), np.int64)
        facts[kept] = np.stack((n_a, n_b, groups, n_links, np.ones(len(kept), np.int64)), axis=1)
        count[kept] = groups
        self.facts = np.concatenate((self.facts, facts))
        self.part_groups.add(which, count)
        text, begin = [""] * len(fresh), 0
        for i, n in zip(kept.tolist(), stop.tolist()):
            text[i] = ";".join(names[begin:n])
            begin = n
        self.text += text

    def expand(self, which: np.ndarray, links: np.ndarray, stop: np.ndarray) -> None:
        """Number the pairs of the fresh groups; which has the group of each occurrence, links end at stop of each."""
        new, self.groups.fresh = self.groups.fresh, []
        if not new:
            return
        first = len(self.groups) - len(new)
        at = np.full(len(new), -1, np.int64)
        seen = np.flatnonzero(which >= first)[::-1]
        at[which[seen] - first] = seen  # the first occurrence of each
        begin = np.concatenate(([0], stop))[at]
        count = stop[at] - begin
        code, group = links[spread(begin, count)], np.repeat(np.arange(len(new)), count)
        order = np.lexsort((code, group))
        code, group = code[order], group[order]
        once = np.concatenate(([True], (code[1:] != code[:-1]) | (group[1:] != group[:-1])))
        pairs = np.fromiter(map(self.pairs.__getitem__, code[once].tolist()), np.int64, int(once.sum()))
        self.group_pairs.add(pairs, np.bincount(group[once], minlength=len(new)))
        self.keys = np.concatenate((self.keys, np.fromiter((xxhash.xxh3_64_intdigest(x) for x in new), np.uint64, len(new)).view(np.int64)))
        grown = lambda x, n: np.concatenate((x, np.zeros(n - len(x), np.int64)))
        self.group_n, self.pair_n = grown(self.group_n, len(self.groups)), grown(self.pair_n, len(self.pairs))

    def documents(self, doc_ids: pa.Array, texts: list[bytes | None]) -> pa.RecordBatch:
        """A row a text, whose groups and pairs are counted."""
        found = []
        for t in texts:
            try:
                (t or b"").decode()
                found.append(PARTS.findall(b" " + t) if t and self.parted else [b" " + t] if t else [])
            except UnicodeDecodeError:
                found.append([])
        size = np.fromiter(map(len, found), np.int64, len(found))
        which = np.fromiter(map(self.parts.__getitem__, (p for x in found for p in x)), np.int64, int(size.sum()))
        if self.parts.fresh:
            self.learn()
        uses = np.bincount(which, minlength=len(self.parts))
        uses[: len(self.uses)] += self.uses
        self.uses = uses
        doc = np.repeat(np.arange(len(texts)), size)
        bad = np.unique(doc[self.facts[which, 4] == 0])
        good = ~np.isin(doc, bad)
        sums = np.zeros((len(texts), 4), np.int64)
        for k in range(4):
            sums[:, k] = np.bincount(doc[good], weights=self.facts[which[good], k], minlength=len(texts))
        digests, begin, listed = [], 0, which.tolist()
        for n, used in zip(size.tolist(), (sums[:, 0] > 0).tolist()):
            digests.append(hashlib.sha256(";".join([self.text[i] for i in listed[begin : begin + n]]).encode()).hexdigest() if used else "")
            begin += n
        group, count = self.part_groups.of(which[good])
        wide = max(1, len(self.groups))
        code, times = np.unique(np.repeat(doc[good], count) * wide + group, return_counts=True)
        doc, group = code // wide, code % wide
        self.group_n += np.bincount(group, minlength=len(self.group_n))
        pair, count = self.group_pairs.of(group)
        wide = max(1, len(self.pairs))
        self.pair_n += np.bincount(np.unique(np.repeat(doc, count) * wide + pair) % wide, minlength=len(self.pair_n))
        offsets = pa.array(np.searchsorted(doc, np.arange(len(texts) + 1)), pa.int32())
        keys, often = pa.ListArray.from_arrays(offsets, pa.array(self.keys[group])), pa.ListArray.from_arrays(offsets, pa.array(times.astype(np.int32)))
        return rows(len(texts), kind=pa.array([DOCUMENT] * len(texts), pa.int32()), doc_id=doc_ids, n_a=sums[:, 0], n_b=sums[:, 1], n_groups=sums[:, 2], n_links=sums[:, 3], digest=digests, keys=keys, times=often)

    def counts(self) -> Iterator[pa.RecordBatch]:
        """The groups and pairs of the documents since begin, with how many hold them."""
        names, codes = list(self.groups), np.fromiter(self.pairs, np.int64, len(self.pairs))
        for kind, n in ((GROUP, self.group_n), (PAIR, self.pair_n)):
            held = np.flatnonzero(n)
            for x in range(0, len(held), COUNT_ROWS):
                at = held[x : x + COUNT_ROWS]
                ids = [names[i] for i in at.tolist()] if kind == GROUP else [None] * len(at)
                yield rows(len(at), kind=pa.array([kind] * len(at), pa.int32()), key=self.keys[at] if kind == GROUP else codes[at], ids=pa.array(ids, pa.string()), n=n[at])
        self.begin()


FIELDS = pa.schema([("kind", pa.int32()), ("doc_id", pa.int64()), ("n_a", pa.int64()), ("n_b", pa.int64()), ("n_groups", pa.int64()), ("n_links", pa.int64()), ("digest", pa.string()), ("keys", pa.list_(pa.int64())), ("times", pa.list_(pa.int32())), ("key", pa.int64()), ("ids", pa.string()), ("n", pa.int64())])


def rows(size: int, **columns) -> pa.RecordBatch:
    """A batch of FIELDS; columns that are not given are null."""
    filled = [pa.array(columns[f.name], f.type) if isinstance(columns.get(f.name), np.ndarray | list) else columns.get(f.name, pa.nulls(size, f.type)) for f in FIELDS]
    return pa.RecordBatch.from_arrays(filled, schema=FIELDS)


def kept_aligner(a: str, b: str) -> Aligner:
    """This worker's aligner, with what it met in earlier tasks."""
    kept = worker_cache().setdefault("aligners", {})
    if (a, b) not in kept:
        kept[a, b] = Aligner(a, b)
    kept[a, b].begin()
    return kept[a, b]


def described(docs: DataFrame, a: str, b: str) -> DataFrame:
    """Rows of SCHEMA: documents, and for each task its groups and pairs with the documents that hold them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligner = None
        for batch in batches:
            aligner = aligner or kept_aligner(a, b)
            first, size, texts = 0, 0, []
            for i, t in enumerate(as_bytes(batch.column(1))):
                if texts and size + len(t or b"") > TEXT_BYTES:
                    yield aligner.documents(batch.column(0).slice(first, len(texts)), texts)
                    first, size, texts = i, 0, []
                texts.append(t)
                size += len(t or b"")
            if texts:
                yield aligner.documents(batch.column(0).slice(first, len(texts)), texts)
            if len(aligner.parts) > KEPT_PARTS:
                aligner.trim()
            if aligner.full():
                yield from aligner.counts()
                aligner.forget()
        if aligner:
            yield from aligner.counts()
        release()

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, SCHEMA)


def group_links(ids: str, a_size: np.ndarray, b_size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The id pairs that a group links, a << 32 | b, and how often each."""
    a, b = (np.array(x.split(","), np.int64) for x in ids.split("|"))
    a_end, b_end = ends_of(a, a_size), ends_of(b, b_size)
    every = np.union1d(a_end, b_end)
    return np.unique((a[np.searchsorted(a_end, every)] << 32) | b[np.searchsorted(b_end, every)], return_counts=True)


def expanded(groups: DataFrame, sizes: tuple[np.ndarray, np.ndarray]) -> DataFrame:
    """(key, pair, times): the links of each group (key, ids)."""
    shared = groups.sparkSession.sparkContext.broadcast(sizes)  # a number for each entry of the vocabularies

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [group_links(x, *shared.value) for x in batch.column(1).to_pylist()]
            count = np.fromiter((len(p) for p, _ in found), np.int64, len(found))
            pair, times = (np.concatenate([x[i] for x in found]) if found else np.zeros(0, np.int64) for i in range(2))
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(batch.column(0).to_numpy(), count)), pa.array(pair), pa.array(times)], ["key", "pair", "times"])

    return groups.select("key", "ids").mapInArrow(run, "key long, pair long, times long")


@dataclass
class Alignment:
    """documents: a row per row of the input (see align); groups: key, ids, documents; pairs: a, b, documents, best."""

    documents: DataFrame
    groups: DataFrame
    pairs: DataFrame


def align(docs: DataFrame, a: str, b: str, head: int = HEAD) -> Alignment:
    """Align docs (doc_id, text) under a byte-level tokenizer file and a piece model.

    documents has doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256. The count of a pair is the number of
    documents that hold it linked; n_best are links whose count is the highest of their A id, count_sum adds up the counts of
    all links, groups_sha256 is the digest of the groups' ids in order.
    """
    import sentencepiece
    from tokenizers import Tokenizer

    sizes = tuple(np.array(list(map(len, x)), np.int64) for x in (entry_bytes(Tokenizer.from_file(a)), piece_bytes(sentencepiece.SentencePieceProcessor(model_file=b))))
    found = materialize(described(docs, a, b).withColumn("row", F.monotonically_increasing_id()), "alignment")
    counted = found.where(f"kind = {PAIR}").groupBy(F.col("key").alias("pair")).agg(F.sum("n").alias("documents"))
    of_a = Window.partitionBy("a")  # an A id has no more pairs than B has ids
    pairs = counted.withColumn("a", F.shiftright("pair", 32)).withColumn("best", F.col("documents") == F.max("documents").over(of_a))
    pairs = materialize(pairs, "pairs")
    named = found.where(f"kind = {GROUP}").groupBy("key").agg(F.min("ids").alias("ids"), F.max("ids").alias("other"), F.sum("n").alias("documents"))
    one = F.when(F.col("ids") == F.col("other"), F.col("ids")).otherwise(F.raise_error(F.lit("two groups have the same 64-bit key")))
    groups = materialize(named.select("key", one.alias("ids"), "documents"), "groups")
    links = materialize(expanded(groups, sizes), "group-links")
    few = checkpointed(links.groupBy("pair").agg(F.count("*").alias("n")).join(pairs, "pair").select("pair", "n", "documents", "best"))
    valued = spread_join(links, few, "pair", links.count(), F.xxhash64("key"))
    valued = valued.groupBy("key").agg(F.sum(F.col("times") * F.col("documents")).alias("sum"), F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).cast("bigint").alias("best"))
    valued = materialize(valued, "group-sums")
    top = groups.orderBy(F.desc("documents"), "key").limit(head).select("key")
    common = valued.join(F.broadcast(top), "key").orderBy("key").toArrow()  # `head` rows at most
    shared = docs.sparkSession.sparkContext.broadcast(tuple(common.column(c).to_numpy() for c in ("key", "sum", "best")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, total, best = shared.value
        for batch in batches:
            keys, times = batch.column(1), batch.column(2)
            flat, often = keys.flatten().to_numpy(), times.flatten().to_numpy().astype(np.int64)
            doc = np.repeat(np.arange(batch.num_rows), keys.value_lengths().fill_null(0).to_numpy())
            at = np.minimum(np.searchsorted(known, flat), max(0, len(known) - 1))
            has = known[at] == flat if len(known) else np.zeros(len(flat), bool)
            sums = [np.zeros(batch.num_rows, np.int64) for _ in range(2)]
            for out, value in zip(sums, (best, total)):
                np.add.at(out, doc[has], value[at[has]] * often[has])
            offsets = pa.array(np.searchsorted(doc[~has], np.arange(batch.num_rows + 1)), pa.int32())
            rest = [pa.ListArray.from_arrays(offsets, pa.array(x[~has])) for x in (flat, often)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *map(pa.array, sums), *rest], ["row", "n_best", "count_sum", "keys", "times"])

    documents = found.where(f"kind = {DOCUMENT}")
    facts = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "digest"]
    summed = documents.select("row", "keys", "times", F.struct(*facts).alias("facts"))
    summed = with_column(summed, run)
    if groups.count() > head:
        summed = materialize(summed, "alignment-sums")
        rest = summed.select("row", F.explode(F.arrays_zip("keys", "times")).alias("g")).select("row", F.col("g.keys").alias("key"), F.col("g.times").alias("times"))
        rest = rest.join(valued, "key").groupBy("row").agg(F.sum(F.col("times") * F.col("best")).alias("more_best"), F.sum(F.col("times") * F.col("sum")).alias("more_sum"))
        summed = summed.join(broadcast_if_small(rest), "row", "left").withColumns({"n_best": F.col("n_best") + F.coalesce("more_best", F.lit(0)), "count_sum": F.col("count_sum") + F.coalesce("more_sum", F.lit(0))})
    out = summed.select("facts.doc_id", "facts.n_a", "facts.n_b", "facts.n_groups", "facts.n_links", "n_best", "count_sum", F.col("facts.digest").alias("groups_sha256"))
    return Alignment(out, groups, pairs.select("a", F.col("pair").bitwiseAND(0xFFFFFFFF).alias("b"), "documents", "best"))


def with_column(summed: DataFrame, run) -> DataFrame:
    """summed (row, keys, times, facts) through run, which gives row, n_best, count_sum and the keys and times that are left; with facts."""

    def both(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for out in run(iter([batch])):
                yield pa.RecordBatch.from_arrays([*out.columns, batch.column(3)], [*out.schema.names, "facts"])

    return summed.mapInArrow(both, f"row long, n_best long, count_sum long, keys array<long>, times array<long>, facts {summed.schema['facts'].dataType.simpleString()}")

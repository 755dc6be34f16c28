"""Token files: each id in the minimum bits of the vocabulary, with block offsets for vectorised unpacking.

A file is, all little-endian: MAGIC; the header (bits, ids a block, documents, ids, blocks) as five unsigned 64-bit
integers; the byte offset of each block and of the end; each document's doc_id; the position of each document's first
id and of the end; a byte for each document, 1 if it has no doc_id (which then stands as 0); the blocks. A block packs
its ids with the lowest bit first and ends on a whole byte, so any range of ids is unpacked from its own blocks alone.

Documents are dealt by ranges of (doc_id, hash of text), MOST_RANGES at most, and each task writes its range in order, as
one or more files of about FILE_IDS ids named by partition, number and attempt. A file is moved to its name when it is
whole, and only files that a finished task has listed count, so tasks may fail, run again or run twice. The files are in
the shared folder, reached through pyarrow's filesystems. Order is that of partition and number, as integers.

Null texts are empty and give the end id alone. Repeated doc_ids, and repeated rows, are neighbours, ordered by hash and
then by text; a null doc_id sorts first. A table without rows gives no file and no rows. Very long texts are encoded
whole, one at a time. Bytes that are not UTF-8 are encoded as U+FFFD. Other columns are not read.
"""

from __future__ import annotations

import json
import os
import struct
import zlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import KERNEL_BYTES, broadcast_if_small, checkpointed, pieces, release, temporary, worker_cache

MAGIC, BLOCK_IDS, FILE_IDS, RANGE_BYTES, MOST_RANGES = b"EVIDTOK2", 4096, 2 << 20, 8 << 20, 50_000
END_ID, CACHE_WORDS, ENCODE_BYTES, GROUP = 1, 150_000, 1 << 20, 500
#: A word that ends a text: a byte that UTF-8 never has.
TEXT_END = b"\xff"
GAP = b" " + TEXT_END + b" "
SPACE, LETTER, MARK = 1, 2, 3
KIND = np.zeros(256, np.uint8)
KIND[list(b" \t\n\v\f\r")], KIND[list(b"abcdefghijklmnopqrstuvwxyz")], KIND[list(b"!\"#$%&()*+,./:;=?@|_-")] = SPACE, LETTER, MARK

# The rules of a tokenizer file under which a text's ids are those of its words, lower-cased and parted at marks.
NORMALIZER = {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]}
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
PRE_TOKENIZER = {
    "type": "Sequence",
    "pretokenizers": [
        {"type": "Split", "pattern": {"Regex": SPLIT}, "behavior": "Removed", "invert": True},
        {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
    ],
}


def bits_for(vocabulary: int) -> int:
    return max(1, (vocabulary - 1).bit_length())


def pack(ids: np.ndarray, bits: int) -> bytes:
    if bits in (8, 16, 32):
        return ids.astype(f"<u{bits // 8}").tobytes()
    spread = np.unpackbits(ids.astype("<u4").view(np.uint8).reshape(-1, 4), axis=1, bitorder="little")[:, :bits]
    return np.packbits(spread.ravel(), bitorder="little").tobytes()


def unpack(data: bytes, bits: int, n: int) -> np.ndarray:
    if bits in (8, 16, 32):
        return np.frombuffer(data, f"<u{bits // 8}", n).astype(np.uint32)
    flat = np.unpackbits(np.frombuffer(data, np.uint8), bitorder="little", count=n * bits).reshape(n, bits)
    return np.packbits(np.pad(flat, ((0, 0), (0, 32 - bits))), axis=1, bitorder="little").view("<u4").ravel()


def to_file(doc_ids: list[int | None], counts: list[int], ids: np.ndarray, bits: int) -> bytes:
    blocks = [pack(ids[a : a + BLOCK_IDS], bits) for a in range(0, len(ids), BLOCK_IDS)]
    offsets = np.concatenate(([0], np.cumsum([len(b) for b in blocks], dtype=np.int64)))
    starts = np.concatenate(([0], np.cumsum(counts, dtype=np.int64)))
    unnamed = np.array([i is None for i in doc_ids], np.uint8)
    head = MAGIC + struct.pack("<5Q", bits, BLOCK_IDS, len(doc_ids), len(ids), len(blocks))
    return b"".join([head, offsets.astype("<u8").tobytes(), np.array([i or 0 for i in doc_ids], "<i8").tobytes(), starts.astype("<u8").tobytes(), unnamed.tobytes(), *blocks])


class TokenFile:
    """Reads a file's bytes: doc_ids, unnamed (without a doc_id), starts, and ids(a, b) for any range of positions."""

    def __init__(self, data: bytes):
        if data[:8] != MAGIC:
            raise ValueError("not a token file")
        self.data = data
        self.bits, self.block, docs, self.n, blocks = struct.unpack_from("<5Q", data, 8)
        at = 48
        self.offsets = np.frombuffer(data, "<u8", blocks + 1, at).astype(np.int64)
        at += 8 * (blocks + 1)
        self.doc_ids = np.frombuffer(data, "<i8", docs, at)
        at += 8 * docs
        self.starts = np.frombuffer(data, "<u8", docs + 1, at).astype(np.int64)
        at += 8 * (docs + 1)
        self.unnamed = np.frombuffer(data, np.uint8, docs, at) == 1
        self.payload = at + docs

    def ids(self, a: int, b: int) -> np.ndarray:
        if a >= b:
            return np.zeros(0, np.uint32)
        first, last = a // self.block, (b - 1) // self.block
        out = []
        for k in range(first, last + 1):
            n = min(self.block, self.n - k * self.block)
            out.append(unpack(self.data[self.payload + self.offsets[k] : self.payload + self.offsets[k + 1]], self.bits, n))
        return np.concatenate(out)[a - first * self.block : b - first * self.block]


class WordIndex(dict):
    """Numbers words as they are first looked up; fresh lists those that came since it was last emptied."""

    def __init__(self):
        self.fresh: list[bytes] = []

    def __missing__(self, word: bytes) -> int:
        self.fresh.append(word)
        self[word] = n = len(self)
        return n


def by_words(path: str) -> bool:
    """Whether the tokenizer file has the rules under which WordEncoder gives a whole text's ids; it holds for no other."""
    with open(path, encoding="utf-8") as f:
        rules = json.load(f)
    model = rules["model"]
    plain = not any(model.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "fuse_unk", "byte_fallback", "ignore_merges"))
    special = all(t["content"].startswith("<|") and not t["normalized"] for t in rules.get("added_tokens") or [])
    return (
        rules.get("normalizer") == NORMALIZER and rules.get("pre_tokenizer") == PRE_TOKENIZER and special
        and model.get("type") == "BPE" and plain and model.get("end_of_word_suffix") == "</w>" and not rules.get("truncation") and not rules.get("padding")
    )


class WholeEncoder:
    """Encodes whole texts, with any tokenizer."""

    def __init__(self, path: str):
        os.environ.setdefault("RAYON_NUM_THREADS", "1")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)

    def encode(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, each followed by END_ID, and their number for each text."""
        found = [[*e.ids, END_ID] for e in self.tokenizer.encode_batch_fast([t.decode() for t in texts], add_special_tokens=False)]
        sizes = np.fromiter(map(len, found), np.int64, len(found))
        return np.fromiter(chain.from_iterable(found), np.uint32, int(sizes.sum())), sizes


class WordEncoder:
    """Encodes texts with a tokenizer that never joins across ASCII white space: each different word is encoded once.

    White space ends a match of the tokenizer's split pattern, and its normaliser changes no character by one beyond
    white space, so a text's ids are those of its words in turn. Words are parted for all texts at once, and each
    different one of a call is looked up once.
    """

    def __init__(self, path: str):
        os.environ.setdefault("RAYON_NUM_THREADS", "1")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.ends = np.zeros(self.tokenizer.get_vocab_size(with_added_tokens=True), bool)
        for piece, i in self.tokenizer.get_vocab().items():
            self.ends[i] = piece.endswith("</w>")
        self.forget()

    def forget(self) -> None:
        """Without words but TEXT_END, which is always the first."""
        self.at = WordIndex()
        self.at[TEXT_END] = 0
        self.flat, self.begin, self.length = np.array([END_ID], np.uint32), np.zeros(1, np.int64), np.ones(1, np.int32)
        self.uses = np.zeros(1, np.int64)

    def trim(self) -> None:
        """Keep the half of the words that were looked up most."""
        self.uses[0] = np.iinfo(np.int64).max
        keep = np.sort(np.argsort(self.uses, kind="stable")[-max(1, CACHE_WORDS // 2) :])
        words, sizes = list(self.at), self.length[keep]
        ends = np.cumsum(sizes, dtype=np.int64)
        self.flat = self.flat[np.repeat(self.begin[keep] - (ends - sizes), sizes) + np.arange(ends[-1])]
        self.begin, self.length, self.uses, self.at = ends - sizes, sizes, self.uses[keep] // 2, WordIndex()
        self.uses[0] = 0
        self.at.update(zip((words[i] for i in keep.tolist()), range(len(keep))))

    def learn(self) -> None:
        text = b" ".join(self.at.fresh).decode().split(" ")
        plain = [i for i, w in enumerate(text) if w.isalpha()]
        groups = [plain[a : a + GROUP] for a in range(0, len(plain), GROUP)]
        joined = self.tokenizer.encode_batch_fast([" ".join([text[i] for i in g]) for g in groups], add_special_tokens=False)
        begin, sizes = np.zeros(len(text), np.int64), np.full(len(text), -1, np.int32)
        held, upto = [self.flat], len(self.flat)
        for g, e in zip(groups, joined):
            ids = np.array(e.ids, np.uint32)
            stops = np.flatnonzero(self.ends[ids]) + 1
            if len(stops) == len(g):  # each word is one match and ends once
                begin[g] = upto + np.concatenate(([0], stops[:-1]))
                sizes[g] = np.diff(stops, prepend=0)
                held.append(ids)
                upto += len(ids)
        rest = np.flatnonzero(sizes < 0).tolist()
        for i, e in zip(rest, self.tokenizer.encode_batch_fast([text[i] for i in rest], add_special_tokens=False)):
            begin[i], sizes[i] = upto, len(e.ids)
            held.append(np.array(e.ids, np.uint32))
            upto += len(e.ids)
        self.begin, self.length, self.flat = np.concatenate((self.begin, begin)), np.concatenate((self.length, sizes)), np.concatenate(held)
        self.at.fresh = []

    def words(self, texts: list[bytes]) -> pa.DictionaryArray:
        """The words of all texts, and TEXT_END after each text.

        Lower-casing A-Z beforehand changes no id, nor does parting a letter from a mark that follows it, where the split
        pattern always ends a match; a text that could spell a special token is left as it is.
        """
        whole = [b"<|" in t for t in texts]
        raw = np.frombuffer(b"".join([x for t, w in zip(texts, whole) for x in (t if w else t.lower(), GAP)]), np.uint8)
        if np.count_nonzero(raw == TEXT_END[0]) > len(texts):
            raise ValueError("a text is not UTF-8")
        kind = KIND[raw]
        inside = kind != SPACE
        new = (kind[1:] == MARK) & (kind[:-1] == LETTER)
        if any(whole):
            ends = np.cumsum(np.fromiter(map(len, texts), np.int64, len(texts)) + len(GAP))
            for i in np.flatnonzero(whole).tolist():
                new[ends[i] - len(GAP) - len(texts[i]) : ends[i] - len(GAP)] = False
        new |= ~inside[:-1]
        start = np.flatnonzero(np.append(True, new)[inside])
        data, offsets = raw[inside], np.append(start, np.count_nonzero(inside)).astype(np.int64)
        return pa.Array.from_buffers(pa.large_binary(), len(start), [None, pa.py_buffer(offsets), pa.py_buffer(data)]).dictionary_encode()

    def encode(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, each followed by END_ID, and their number for each text."""
        if len(self.at) > CACHE_WORDS:
            self.trim()
        words = self.words(texts)
        known = words.dictionary.to_numpy(zero_copy_only=False).tolist()
        which = np.fromiter(map(self.at.__getitem__, known), np.int64, len(known))[words.indices.to_numpy()]
        if self.at.fresh:
            self.learn()
        uses = np.bincount(which, minlength=len(self.at))
        uses[: len(self.uses)] += self.uses
        self.uses = uses
        sizes = self.length[which]
        ends = np.cumsum(sizes, dtype=np.int64)
        ids = self.flat[np.repeat(self.begin[which] - (ends - sizes), sizes) + np.arange(ends[-1] if len(ends) else 0)]
        return ids, np.diff(ends[which == 0], prepend=0)


def kept_encoder(path: str) -> WordEncoder | WholeEncoder:
    """This worker's encoder for the tokenizer file, with the words that it met in earlier tasks."""
    kept = worker_cache().setdefault("encoders", {})
    if path not in kept:
        kept[path] = WordEncoder(path) if by_words(path) else WholeEncoder(path)
    return kept[path]


def forget_encoders() -> None:
    """Free what kept_encoder keeps."""
    worker_cache().pop("encoders", None)
    release()


def write_files(docs: DataFrame, folder: str, tokenizer: str) -> DataFrame:
    """Write docs (doc_id, text) to folder; a row per file: name, part, number, documents, ids. Evaluate it once."""
    from tokenizers import Tokenizer

    bits = bits_for(Tokenizer.from_file(tokenizer).get_vocab_size(with_added_tokens=True))
    chosen = docs.select(F.col("doc_id").cast("long"), F.make_valid_utf8(F.col("text").cast("string")).alias("text"))
    size = chosen.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    where, root = fs.FileSystem.from_uri(folder)
    where.create_dir(root, recursive=True)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, number, attempt = TaskContext.get().partitionId(), 0, TaskContext.get().taskAttemptId()
        encoder, doc_ids, counts, held, total = None, [], [], [], 0
        store, path = fs.FileSystem.from_uri(folder)

        def flush() -> pa.RecordBatch:
            name = f"{part:06d}-{number:04d}-{attempt}.ids"
            draft = f"{path}/.{name}"
            with store.open_output_stream(draft) as out:
                out.write(to_file(doc_ids, counts, np.concatenate(held), bits))
            store.move(draft, f"{path}/{name}")
            return pa.RecordBatch.from_pydict({"name": [name], "part": [part], "number": [number], "documents": [len(doc_ids)], "ids": [total]})

        for b in batches:
            for first, texts in pieces(b.column(1), ENCODE_BYTES):
                encoder = encoder or kept_encoder(tokenizer)
                ids, n = encoder.encode(texts)
                doc_ids += b.column(0).slice(first, len(texts)).to_pylist()
                counts += n.tolist()
                held.append(ids.astype(np.uint16 if bits <= 16 else np.uint32))
                total += len(ids)
                if total >= FILE_IDS:
                    yield flush()
                    number, doc_ids, counts, held, total = number + 1, [], [], [], 0
        if doc_ids:
            yield flush()
        del doc_ids, counts, held
        release()

    salt = F.xxhash64("text")
    dealt = chosen.repartitionByRange(min(MOST_RANGES, max(1, -(-size // RANGE_BYTES))), F.col("doc_id").asc_nulls_first(), salt)
    dealt = dealt.sortWithinPartitions(F.col("doc_id").asc_nulls_first(), salt, "text")
    return dealt.mapInArrow(run, "name string, part long, number long, documents long, ids long")


def read_files(spark: SparkSession, folder: str) -> DataFrame:
    """A row per document in the files of folder: name, doc_id, local_start, n_tokens, ids_crc32. Workers forget their encoders."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget_encoders()
        for b in batches:
            for name, data in zip(b.column(0), b.column(1)):
                f = TokenFile(data.as_buffer().to_pybytes())
                crcs, a = np.empty(len(f.doc_ids), np.int64), 0
                while a < len(crcs):
                    stop = max(a + 1, int(np.searchsorted(f.starts, f.starts[a] + KERNEL_BYTES // 4, side="right")) - 1)
                    ids = f.ids(int(f.starts[a]), int(f.starts[stop])).astype("<u4")
                    for i in range(a, stop):
                        crcs[i] = zlib.crc32(ids[f.starts[i] - f.starts[a] : f.starts[i + 1] - f.starts[a]])
                    a = stop
                yield pa.RecordBatch.from_pydict({"name": [name.as_py()] * len(crcs), "doc_id": pa.array(f.doc_ids, mask=f.unnamed), "local_start": f.starts[:-1], "n_tokens": np.diff(f.starts), "ids_crc32": crcs})

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.ids").load(folder)
    named = files.select(F.element_at(F.split("path", "/"), -1).alias("name"), "content")
    return named.mapInArrow(run, "name string, doc_id long, local_start long, n_tokens long, ids_crc32 long")


def file_bases(written: DataFrame) -> DataFrame:
    """(name, base: ids of all files before it) of written files; a part's files in one task, and the parts, MOST_RANGES at most."""
    before = Window.rowsBetween(Window.unboundedPreceding, -1)
    parts = written.groupBy("part").agg(F.sum("ids").alias("all"))
    parts = parts.select("part", F.coalesce(F.sum("all").over(before.orderBy("part")), F.lit(0)).alias("from"))
    inside = F.coalesce(F.sum("ids").over(before.partitionBy("part").orderBy("number")), F.lit(0))
    return written.withColumn("inside", inside).join(F.broadcast(parts), "part").select("name", (F.col("from") + F.col("inside")).alias("base"))


def token_output(docs: DataFrame, tokenizer: str) -> DataFrame:
    """Write docs as token files in the shared folder and read them back: doc_id, start, n_tokens, ids_crc32."""
    spark = docs.sparkSession
    folder = temporary(spark, "tokens")
    written = checkpointed(write_files(docs, folder, tokenizer))
    if not written.limit(1).count():
        return spark.createDataFrame([], "doc_id long, start long, n_tokens long, ids_crc32 long")
    base = broadcast_if_small(file_bases(written))
    return read_files(spark, folder).join(base, "name").select("doc_id", (F.col("base") + F.col("local_start")).alias("start"), "n_tokens", "ids_crc32")

"""Quality classifier: a byte-level convolutional network in numpy.

FILTERS learned filters, each WIDTH bytes wide, slide over every byte of the document. Blocks of BLOCK positions are
max-pooled, and two neighbouring blocks make a chunk, so chunks overlap by half and cover the whole text; the mean and
the maximum over a document's chunks, and the logarithm of its length, go through a hidden layer into one probability. Bytes are embedded, so a filter's
products are a table by place and byte, and scoring adds table rows for all documents of a batch at once.

It is fitted on the driver by Adam, seeded, on at most FIT_DOCS labelled documents a class, of texts over FIT_CHARS
characters on a window of so many; scores are of whole texts. Without labels of both classes the score is the share of
label 1, or 0.5. Null texts are empty; an empty text is a single padded block. Repeated rows get equal scores, a row
each; a table without rows gives none; a very long text is scored alone, in strips of STRIP blocks. Columns other than
doc_id and text are not read, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import kept_rows, pieces, release
from .fitting import base_rate, fold, labelled_sample, sigmoid

FIT_DOCS, FILTERS, WIDTH, BLOCK, EMBED, HIDDEN = 1500, 16, 6, 128, 12, 12
EPOCHS, BATCH, RATE, STRIP = 14, 64, 0.004, 128
#: Bytes of text that are laid out at a time; a layout takes six times as many.
PIECE_BYTES = 1 << 20


class Layout:
    """Bytes of texts, each padded with zeros to whole blocks; shifted[w] has at each position the byte w places on, and
    zero beyond the text's own blocks, so that no text sees the next one."""

    def __init__(self, texts: list[bytes]):
        size = np.fromiter(map(len, texts), np.int64, len(texts))
        self.length = np.log1p(size) / 8
        self.blocks = np.maximum(1, -(-size // BLOCK))
        self.first = np.concatenate(([0], np.cumsum(self.blocks)[:-1]))
        data = np.frombuffer(b"".join(t.ljust(int(n) * BLOCK, b"\0") for t, n in zip(texts, self.blocks)), np.uint8)
        self.n, self.shifted, ends = int(self.blocks.sum()), [data], (self.first + self.blocks) * BLOCK
        for w in range(1, WIDTH):
            self.shifted.append(np.append(self.shifted[-1][1:], np.uint8(0)))
            self.shifted[w][ends - 1] = 0


def convolve(table: np.ndarray, lay: Layout, a: int, b: int) -> np.ndarray:
    """Activations at the positions of blocks a .. b - 1, by block."""
    lo, hi = a * BLOCK, b * BLOCK
    out = table[0].take(lay.shifted[0][lo:hi], axis=0)
    for w in range(1, WIDTH):
        out += table[w].take(lay.shifted[w][lo:hi], axis=0)
    return out.reshape(b - a, BLOCK, FILTERS)


def pooled(table: np.ndarray, lay: Layout, where: bool = False) -> tuple[np.ndarray, np.ndarray | None]:
    """Maximum of each block and filter, and its position."""
    top, at = np.empty((lay.n, FILTERS), np.float32), np.empty((lay.n, FILTERS), np.int64) if where else None
    for a in range(0, lay.n, STRIP):
        b = min(lay.n, a + STRIP)
        act = convolve(table, lay, a, b)
        if where:
            at[a:b] = act.argmax(axis=1)
            top[a:b] = np.take_along_axis(act, at[a:b, None, :], axis=1)[:, 0]
        else:
            top[a:b] = act.max(axis=1)
    return top, at


def chunked(top: np.ndarray, lay: Layout) -> tuple[np.ndarray, np.ndarray]:
    """Maximum of each chunk (a block and the next of its document), and whether the next block has it."""
    last = np.zeros(lay.n, bool)
    last[lay.first + lay.blocks - 1] = True
    after = np.vstack([top[1:], top[-1:]])
    use = (after > top) & ~last[:, None]
    return np.where(use, after, top), use


def document_features(chunk: np.ndarray, lay: Layout) -> np.ndarray:
    mean = np.add.reduceat(chunk, lay.first, axis=0) / lay.blocks[:, None]
    return np.hstack([mean, np.maximum.reduceat(chunk, lay.first, axis=0), lay.length[:, None]])


class Network:
    def __init__(self, seed: int = 7):
        r = np.random.default_rng(seed)
        self.p = {
            "embed": r.normal(0, 1, (256, EMBED)), "kernel": r.normal(0, (WIDTH * EMBED) ** -0.5, (WIDTH, EMBED, FILTERS)), "shift": np.zeros(FILTERS),
            "in": r.normal(0, (2 * FILTERS) ** -0.5, (2 * FILTERS + 1, HIDDEN)), "in0": np.zeros(HIDDEN), "out": r.normal(0, HIDDEN**-0.5, HIDDEN), "out0": np.zeros(1),
        }

    def table(self) -> np.ndarray:
        t = np.einsum("be,wef->wbf", self.p["embed"], self.p["kernel"])
        t[0] += self.p["shift"]
        return t.astype(np.float32)

    def head(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        h = np.maximum(np.tanh(x) @ self.p["in"] + self.p["in0"], 0)
        return sigmoid(h @ self.p["out"] + self.p["out0"]), h

    def score(self, texts: list[bytes], table: np.ndarray) -> np.ndarray:
        lay = Layout(texts)
        return self.head(document_features(chunked(pooled(table, lay)[0], lay)[0], lay))[0]

    def gradients(self, texts: list[bytes], y: np.ndarray, weight: np.ndarray) -> dict[str, np.ndarray]:
        lay, p = Layout(texts), self.p
        top, at = pooled(self.table(), lay, where=True)
        chunk, nxt = chunked(top, lay)
        x = document_features(chunk, lay)
        score, h = self.head(x)
        d = weight * (score - y) / len(y)
        g = {"out": h.T @ d, "out0": d.sum(keepdims=True)}
        dh = np.outer(d, p["out"]) * (h > 0)
        g |= {"in": np.tanh(x).T @ dh, "in0": dh.sum(0)}
        dx = (dh @ p["in"].T) * (1 - np.tanh(x) ** 2)
        doc = np.repeat(np.arange(len(texts)), lay.blocks)
        dchunk = (dx[:, :FILTERS] / lay.blocks[:, None])[doc]
        best = chunk == x[:, FILTERS:-1].astype(np.float32)[doc]
        share = best / np.maximum(np.add.reduceat(best.astype(float), lay.first, axis=0), 1)[doc]
        dchunk = dchunk + dx[:, FILTERS:-1][doc] * share
        dtop = np.where(nxt, 0, dchunk)
        dtop[1:] += np.where(nxt, dchunk, 0)[:-1]
        position = at + (np.arange(lay.n) * BLOCK)[:, None]
        columns = np.broadcast_to(np.arange(FILTERS), position.shape)
        g["embed"], g["kernel"], g["shift"] = np.zeros_like(p["embed"]), np.zeros_like(p["kernel"]), dtop.sum(0)
        for w in range(WIDTH):
            key = lay.shifted[w][position].astype(np.int64) * FILTERS + columns
            t = np.bincount(key.ravel(), dtop.ravel(), 256 * FILTERS).reshape(256, FILTERS)
            g["kernel"][w] = p["embed"].T @ t
            g["embed"] += t @ p["kernel"][w].T
        return g


def fit(texts: list[bytes], y: np.ndarray, weight: np.ndarray, seed: int = 7) -> Network | None:
    """The fitted network, or None without labels of both classes."""
    if len(set(y.tolist())) < 2:
        return None
    net, r = Network(seed), np.random.default_rng(seed)
    m, v, t = {k: np.zeros_like(x) for k, x in net.p.items()}, {k: np.zeros_like(x) for k, x in net.p.items()}, 0
    batch = max(8, min(BATCH, len(y) // 16))
    rounds = max(EPOCHS, -(-40 * 16 // max(1, len(y) // batch)) if len(y) < 2000 else 0)
    for epoch in range(rounds):
        order = r.permutation(len(y))
        for a in range(0, len(y), batch):
            pick, t = order[a : a + batch], t + 1
            for k, g in net.gradients([texts[i] for i in pick], y[pick], weight[pick]).items():
                g = g + 1e-4 * net.p[k]
                m[k] += 0.1 * (g - m[k])
                v[k] += 0.001 * (g * g - v[k])
                rate = RATE * min(1.0, 2 * (1 - epoch / rounds))
                net.p[k] = net.p[k] - rate * (m[k] / (1 - 0.9**t)) / (np.sqrt(v[k] / (1 - 0.999**t)) + 1e-8)
    return net


def quality_scores(docs: DataFrame, labels: DataFrame, folds: int = 3, held: int = 1) -> DataFrame:
    """A row per row of docs: doc_id, held_out, score, predicted."""
    texts, y, weight = labelled_sample(docs, labels, "quality", folds, held, {0: FIT_DOCS, 1: FIT_DOCS})
    net, rate = fit(texts, y, weight), base_rate(y, weight)
    table = net.table() if net else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for first, part in pieces(b.column(1), PIECE_BYTES):
                score = net.score(part, table) if net else np.full(len(part), rate)
                yield pa.RecordBatch.from_arrays([b.column(0).slice(first, len(part)), pa.array(np.asarray(score, float))], ["doc_id", "score"])

    scored = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, score double")
    return scored.select("doc_id", (fold("doc_id", folds) == held).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def good_documents(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """docs without those that the classifier rejects (score under 0.5); judged in place, without a shuffle."""
    texts, y, weight = labelled_sample(docs, labels, "quality", 3, 1, {0: FIT_DOCS, 1: FIT_DOCS})
    net, at = fit(texts, y, weight), docs.columns.index("text")
    if net is None:
        return docs
    table = net.table()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keep = [bool(s >= 0.5) for _, part in pieces(b.column(at), PIECE_BYTES) for s in net.score(part, table)]
            yield b.filter(pa.array(keep, pa.bool_()))
        release()

    return kept_rows(docs, run)

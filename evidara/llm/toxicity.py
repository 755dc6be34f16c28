"""Toxic spans by a linear-chain conditional random field.

Tokens are the words [0-9a-z] and beyond ASCII of the lower-cased text. Labelled tokens come from labelled documents: a
word, or a word's first PREFIX bytes, that occurs in toxic documents far beyond its share (log-likelihood ratio G2 and
lift) marks its tokens in those documents as toxic; all other tokens are clean. The field has a weight for each hashed
word and prefix, a bias and transition weights, and is fitted by Adagrad on the exact gradient of its log-likelihood.

Forward and backward messages of a chain of two labels are ratios, and each step maps a ratio x to (a + b x) / (c + d x).
Such maps compose like 2 x 2 matrices, so all documents of a batch are cut into rows of COLUMNS tokens, all rows advance
together, and a scan over the rows' composed maps links them: exact, whatever the lengths. Marginals over SPAN are
merged into spans (code point offsets), and a logistic regression on the expected number of toxic tokens and on their summed
log-odds gives the document's score.

It is fitted on the driver on at most FIT_TOXIC toxic and FIT_CLEAN other documents, of texts over FIT_CHARS characters on
a window of so many; scores are of whole texts. Without labels of both classes the score is the share of label 1, or 0.5,
and there are no spans. Null texts are empty; texts without words have no spans and the score of no evidence. Repeated
rows get equal scores, a row each; a table without rows gives none; a very long text is scored alone. Columns other than
doc_id and text are not read, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ALNUM, Words, mix64, pieces, span_hashes
from .fitting import base_rate, fold, labelled_sample, logistic, sigmoid

FIT_TOXIC, FIT_CLEAN, PREFIX, BUCKETS = 1200, 3000, 6, 1 << 18
LEAST_G2, LEAST_LIFT, STEPS, RATE, RIDGE, COLUMNS, SPAN = 18.0, 5.0, 40, 1.0, 0.001, 64, 0.5
#: Marginals that words without evidence may have; a long text must not gather them into a score.
PIECE_BYTES, NOISE = 1 << 20, 0.1


class Tokens:
    """Words of texts with the buckets of each word and of its prefix."""

    def __init__(self, texts: list[bytes]):
        self.words = w = Words([t.lower() for t in texts], ALNUM)
        whole = span_hashes(w.raw, w.start, w.end) + (w.end - w.start).astype(np.uint64)
        short = span_hashes(w.raw, w.start, np.minimum(w.end, w.start + PREFIX)) + np.uint64(97)
        self.word = (mix64(whole) >> np.uint64(46)).astype(np.int64)
        self.prefix = (mix64(short) >> np.uint64(46)).astype(np.int64)
        self.doc, self.n, self.texts = w.doc, len(w.doc), len(texts)
        self.starts = np.zeros(self.n, bool)
        self.starts[w.first[w.count > 0]] = True


def gathered(texts: list[bytes]) -> Tokens:
    """Tokens of many texts, hashed a piece at a time; without their words."""
    parts, first, size = [], 0, 0
    for i, text in enumerate(texts):
        size += len(text)
        if size >= PIECE_BYTES or i == len(texts) - 1:
            parts.append((first, Tokens(texts[first : i + 1])))
            parts[-1][1].words, first, size = None, i + 1, 0
    out = parts[0][1]
    for name in ("word", "prefix", "starts"):
        setattr(out, name, np.concatenate([getattr(t, name) for _, t in parts]))
    out.doc, out.n, out.texts = np.concatenate([t.doc + a for a, t in parts]), len(out.word), len(texts)
    return out


def chain(a: np.ndarray, b: np.ndarray, c: np.ndarray, d: np.ndarray) -> np.ndarray:
    """x[t] = (a + b x[t-1]) / (c + d x[t-1]) for all t; the first map must not depend on x."""
    n = len(a)
    rows = max(1, -(-n // COLUMNS))
    grid = lambda v, fill: np.append(v, np.full(rows * COLUMNS - n, fill)).reshape(rows, COLUMNS).T.copy()
    a, b, c, d = grid(a, 0.0), grid(b, 1.0), grid(c, 1.0), grid(d, 0.0)
    p, q, r, s = np.zeros(rows), np.ones(rows), np.ones(rows), np.zeros(rows)
    for t in range(COLUMNS):
        p, q, r, s = a[t] * r + b[t] * p, a[t] * s + b[t] * q, c[t] * r + d[t] * p, c[t] * s + d[t] * q
        if t % 4 == 3:
            size = np.maximum(np.maximum(p, q), np.maximum(r, s))
            p, q, r, s = p / size, q / size, r / size, s / size
    entry, x = np.empty(rows), 1.0
    for i, (pi, qi, ri, si) in enumerate(zip(p.tolist(), q.tolist(), r.tolist(), s.tolist())):
        entry[i] = x
        x = (pi + qi * x) / (ri + si * x)
    out = np.empty((COLUMNS, rows))
    for t in range(COLUMNS):
        entry = (a[t] + b[t] * entry) / (c[t] + d[t] * entry)
        out[t] = entry
    return out.T.ravel()[:n]


class Field:
    """States 0 clean, 1 toxic. move[i][j] is the log weight of i followed by j; first is that of starting toxic."""

    def __init__(self, bias: float):
        self.word, self.prefix = np.zeros(BUCKETS), np.zeros(BUCKETS)
        self.bias, self.move, self.first = np.array([bias]), np.zeros((2, 2)), np.zeros(1)

    def marginals(self, t: Tokens) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """P(toxic), and the forward ratio, backward ratio and emission odds of each token."""
        odds = np.exp(np.clip(self.word[t.word] + self.prefix[t.prefix] + self.bias[0], -12, 12))
        (m00, m01), (m10, m11) = np.exp(self.move)
        begin, end = t.starts, np.append(t.starts[1:], True) if t.n else t.starts
        forward = chain(
            odds * np.where(begin, np.exp(self.first[0]), m01), np.where(begin, 0.0, odds * m11), np.where(begin, 1.0, m00), np.where(begin, 0.0, m10)
        )
        after = np.append(odds[1:], 1.0) if t.n else odds
        backward = chain(*(v[::-1] for v in (np.where(end, 1.0, m10), np.where(end, 0.0, m11 * after), np.where(end, 1.0, m00), np.where(end, 0.0, m01 * after))))[::-1]
        both = forward * backward
        return both / (1 + both), forward, backward, odds

    def ascend(self, t: Tokens, y: np.ndarray, memory: dict[str, np.ndarray]) -> None:
        """One Adagrad step on the log-likelihood of token labels y."""
        p, forward, backward, odds = self.marginals(t)
        miss = y - p
        inner = np.flatnonzero(~t.starts)
        (m00, m01), (m10, m11) = np.exp(self.move)
        f, right = forward[inner - 1], odds[inner] * backward[inner]
        w = np.array([[m00 * np.ones(len(inner)), m01 * right], [m10 * f, m11 * f * right]])
        w /= w.sum(axis=(0, 1))
        a, b = y[inner - 1].astype(int), y[inner].astype(int)
        seen = np.bincount(2 * a + b, minlength=4).reshape(2, 2)
        g = {
            "word": np.bincount(t.word, miss, BUCKETS) - RIDGE * self.word, "prefix": np.bincount(t.prefix, miss, BUCKETS) - RIDGE * self.prefix,
            "bias": np.array([miss.sum()]), "move": seen - w.sum(axis=2) - RIDGE * self.move, "first": np.array([miss[t.starts].sum()]) - RIDGE * self.first,
        }
        for k, x in g.items():
            memory[k] = memory.get(k, 1e-6) + x * x
            setattr(self, k, getattr(self, k) + RATE * x / np.sqrt(memory[k]))


def token_labels(t: Tokens, y: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """1 for tokens of toxic documents whose word or prefix marks toxic documents."""
    toxic = y > 0.5
    out = np.zeros(t.n, bool)
    n1, n0 = weight[toxic].sum(), weight[~toxic].sum()
    for key in (t.word, t.prefix):
        pairs = np.unique(key * len(y) + t.doc)
        k, doc = pairs // len(y), pairs % len(y)
        one, zero = np.bincount(k[toxic[doc]], weight[doc[toxic[doc]]], BUCKETS), np.bincount(k[~toxic[doc]], weight[doc[~toxic[doc]]], BUCKETS)
        total = one + zero
        e1, e0 = total * n1 / (n1 + n0), total * n0 / (n1 + n0)
        with np.errstate(divide="ignore", invalid="ignore"):
            g2 = 2 * (np.where(one > 0, one * np.log(one / e1), 0) + np.where(zero > 0, zero * np.log(zero / e0), 0))
            lift = (one + 0.1) / n1 / ((zero + 0.1) / n0)
        out |= ((g2 >= LEAST_G2) & (lift >= LEAST_LIFT))[key]
    return (out & toxic[t.doc]).astype(float)


def evidence(t: Tokens, p: np.ndarray) -> np.ndarray:
    """Per text: log of 1 + the expected number of toxic tokens above NOISE, and of 1 + their summed log-odds above even."""
    total = np.bincount(t.doc, np.maximum(p - NOISE, 0) / (1 - NOISE), t.texts)
    sure = np.clip(p, 0.5, 1 - 1e-6)
    return np.log1p(np.column_stack([total, np.bincount(t.doc, np.log(sure / (1 - sure)), t.texts)]))


class Model:
    def __init__(self, texts: list[bytes], y: np.ndarray, weight: np.ndarray):
        t = gathered(texts)
        labels = token_labels(t, y, weight)
        self.field, memory = Field(float(np.log((labels.sum() + 1) / (t.n + 2)))), {}
        for _ in range(STEPS):
            self.field.ascend(t, labels, memory)
        self.head = logistic(evidence(t, self.field.marginals(t)[0]), y, weight, 0.01)

    def score(self, texts: list[bytes]) -> tuple[np.ndarray, list[list[dict]]]:
        """Score of each text, and its toxic spans by code points with the largest marginal in them."""
        t = Tokens(texts)
        p = self.field.marginals(t)[0]
        spans: list[list[dict]] = [[] for _ in texts]
        hot = np.flatnonzero(p >= SPAN)
        if len(hot):
            w = t.words
            place = np.cumsum((w.raw & 0xC0) != 0x80)  # code points up to and with each byte
            begin = np.concatenate(([0], np.cumsum([len(x) + 1 for x in texts])))
            for run in np.split(hot, np.flatnonzero((np.diff(hot) > 1) | (t.doc[hot[1:]] != t.doc[hot[:-1]])) + 1):
                a, b, d = run[0], run[-1], t.doc[run[0]]
                before = int(place[begin[d] - 1]) if begin[d] else 0
                spans[d].append({"start": int(place[w.start[a]]) - 1 - before, "end": int(place[w.end[b] - 1]) - before, "marginal": float(p[a : b + 1].max())})
        return sigmoid(np.column_stack([np.ones(len(texts)), evidence(t, p)]) @ self.head), spans


def toxicity_scores(docs: DataFrame, labels: DataFrame, folds: int = 5, held: int = 0) -> DataFrame:
    """A row per row of docs: doc_id, held_out, score, predicted, spans (start, end, marginal)."""
    texts, y, weight = labelled_sample(docs, labels, "toxic", folds, held, {0: FIT_CLEAN, 1: FIT_TOXIC})
    rate = base_rate(y, weight)
    model = Model(texts, y, weight) if len(set(y.tolist())) == 2 else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("marginal", pa.float64())]))
        for b in batches:
            for first, part in pieces(b.column(1), PIECE_BYTES):
                score, spans = model.score(part) if model else (np.full(len(part), rate), [[] for _ in part])
                yield pa.RecordBatch.from_arrays([b.column(0).slice(first, len(part)), pa.array(score), pa.array(spans, kind)], ["doc_id", "score", "spans"])

    chosen = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    scored = chosen.mapInArrow(run, "doc_id long, score double, spans array<struct<start: long, end: long, marginal: double>>")
    return scored.select("doc_id", (fold("doc_id", folds) == held).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "spans")

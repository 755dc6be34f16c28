"""Two tokenizers' alignment against a plain version that encodes whole texts and compares all pairs of tokens."""

import hashlib
import random
from collections import Counter, defaultdict

import public_tokenizers
import pytest

from evidara.llm import alignment
from evidara.llm.queries import op12_alignment

A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
COLUMNS = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]


@pytest.fixture(scope="module")
def pair():
    import sentencepiece
    from tokenizers import Tokenizer

    a = Tokenizer.from_file(A)
    a.encode_special_tokens = True
    return a, sentencepiece.SentencePieceProcessor(model_file=B)


def tokens(pair, text):
    """(id, begin, end) of both tokenizers' tokens, or two empty lists."""
    a, b = pair
    alphabet = alignment.byte_alphabet()
    if not text:
        return [], []
    whole = (" " + text).encode()
    sides = []
    for ids, data in (
        (a.encode(" " + text, add_special_tokens=False).ids, lambda i: bytes(alphabet[c] for c in a.id_to_token(i))),
        (b.encode(text), lambda i: bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode()),
    ):
        at, out = 0, []
        for i in ids:
            out.append((i, at, at + len(data(i))))
            at = out[-1][2]
        if b"".join(map(data, ids)) != whole:
            return [], []
        sides.append(out)
    return sides


def brute(pair, rows):
    sides = [(i, *tokens(pair, t)) for i, t in rows]
    links = [[(x[0], y[0]) for x in a for y in b if x[1] < y[2] and y[1] < x[2]] for _, a, b in sides]
    count = Counter(p for x in links for p in set(x))
    best = defaultdict(int)
    for (x, _), n in count.items():
        best[x] = max(best[x], n)
    out = []
    for (i, a, b), own in zip(sides, links):
        ends = sorted({x[2] for x in a} & {x[2] for x in b})
        begin, groups = 0, []
        for e in ends:
            groups.append(",".join(str(x[0]) for x in a if begin <= x[1] < e) + "|" + ",".join(str(x[0]) for x in b if begin <= x[1] < e))
            begin = e
        digest = hashlib.sha256(";".join(groups).encode()).hexdigest() if a else ""
        out.append((i, len(a), len(b), len(groups), len(own), sum(count[p] == best[p[0]] for p in own), sum(count[p] for p in own), digest))
    return out


def same(df, want):
    key = lambda r: tuple((x is None, x) for x in r)
    assert sorted((tuple(r) for r in df.select(COLUMNS).collect()), key=key) == sorted(want, key=key)


ODD = [
    None, "", " ", "  ", "a", " a", "a ", "a  b", "a\n b", "a \n b", "a\n\n  b\t c", "<|endoftext|> <s> </s> <unk> <0x0A>", "it's we'll I'd", " x   y", "x　 y  z", "▁a ▁ b",
    "\x00 a\x00", "naïve café 你好 \U0001f600 \U0001f468‍\U0001f469‍\U0001f467", "a\r\n b\r", "x" * 300, "ab " * 200, "́ ́a", "12345 67890.5", "\x1c \x1f a", "é ﬁ①", "﻿a b", "a​ b", "  a ᠎ b",
]


@pytest.mark.parametrize("head", [alignment.HEAD, 5, 0])
def test_odd_texts(spark, pair, head):
    rows = [(i, t) for i, t in enumerate(ODD)] + [(3, "a"), (None, "a  b"), (8, "a\n b")]
    df = spark.createDataFrame([(i, t, "x", 1, 2) for i, t in rows], "doc_id long, text string, row string, key int, kind int")
    same(alignment.align(df, A, B, head).documents, brute(pair, rows))


@pytest.mark.parametrize("limit", [20, 10**6])
def test_random_texts(spark, pair, monkeypatch, limit):
    monkeypatch.setattr(alignment, "KEPT_PARTS", 40)
    monkeypatch.setattr(alignment, "KEPT_GROUPS", limit)
    monkeypatch.setattr(alignment, "TEXT_BYTES", 60)
    r = random.Random(4)
    parts = [" ", "  ", "\n", "\t", "\r", " ", "　", "'s", "the", "Nation", "é", "你", ".", "!!", "7", "<s>", " ", "\x0b", "\x85", "▁"]
    rows = [(i, "".join(r.choice(parts) for _ in range(r.randrange(25)))) for i in range(300)]
    same(alignment.align(spark.createDataFrame(rows, "doc_id long, text string"), A, B, 7).documents, brute(pair, rows))


def test_whole_texts_under_other_rules(spark, pair, monkeypatch):
    monkeypatch.setattr(alignment, "parts_end_at_spaces", lambda a, b: False)
    rows = [(i, t) for i, t in enumerate(ODD[:12])]
    same(alignment.align(spark.createDataFrame(rows, "doc_id long, text string"), A, B).documents, brute(pair, rows))


def test_table(spark, small, pair):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{small}/documents.parquet").collect() if len(r.text or "") < 3000]
    df = spark.read.parquet(f"{small}/documents.parquet").where("text IS NULL OR length(text) < 3000")
    same(alignment.align(df, A, B).documents, brute(pair, rows))
    assert op12_alignment(spark, small).count() == spark.read.parquet(f"{small}/documents.parquet").count()


def test_bytes_that_are_no_text(spark):
    df = spark.sql("SELECT 1L AS doc_id, cast(unhex('FF41') AS string) AS text UNION ALL SELECT 2L, 'ab'")
    got = {r.doc_id: tuple(r)[1:] for r in alignment.align(df, A, B).documents.collect()}
    assert got[1] == (0, 0, 0, 0, 0, 0, "") and got[2][0] > 0


def test_no_rows(spark):
    out = alignment.align(spark.createDataFrame([], "doc_id long, text string"), A, B)
    assert out.documents.count() == out.groups.count() == out.pairs.count() == 0

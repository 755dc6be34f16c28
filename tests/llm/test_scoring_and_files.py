"""Classifiers on held-out rows, token files and archives by exact round trips, mixing and personal data by brute force."""

import hashlib
import json
import random
import re
import time
import zlib
from collections import Counter
from datetime import UTC, datetime
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from evidara.llm import common, decontaminate, fitting, mixing, pii, quality, token_files, toxicity, warc
from evidara.llm.queries import word_tokenizer

# ---------------------------------------------------------------------------------------------- classifiers


def corpus(n, seed, mark):
    """n plain texts, of which a quarter is changed by mark; (doc_id, text, label)."""
    r = random.Random(seed)
    out = []
    for i in range(n):
        words = [r.choice(["the", "of", "and", "house", "river", "green", "walks", "über", "naïve"]) for _ in range(r.randrange(20, 200))]
        odd = i % 4 == 0
        out.append((i, mark(words, r) if odd else " ".join(words) + ".", odd))
    return out


def auc(pairs):
    pos, neg = [s for s, y in pairs if y], [s for s, y in pairs if not y]
    return np.mean([(a > b) + (a == b) / 2 for a in pos for b in neg])


def frames(spark, rows, column, value):
    docs = spark.createDataFrame([(i, t, "x") for i, t, _ in rows] + [(9001, None, "x"), (9002, "", "x"), (None, "text", "x"), (9003, "word " * 60_000, "x")], "doc_id long, text string, score string")
    labels = spark.createDataFrame([(i, value(odd)) for i, _, odd in rows] + [(1, None), (None, 1)], f"doc_id long, {column} int")
    return docs, labels


def test_quality(spark):
    rows = corpus(400, 1, lambda w, r: " ".join(x.upper() + "!!" for x in w))
    docs, labels = frames(spark, rows, "quality", lambda odd: int(not odd))
    got = quality.quality_scores(docs, labels).collect()
    assert len(got) == 404 and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in got)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id if r.doc_id is not None else "").encode()) % 3 == 1) for r in got)
    odd = {i: o for i, _, o in rows}
    held = [(r.score, not odd[r.doc_id]) for r in got if r.held_out and r.doc_id in odd]
    assert auc(held) > 0.98 and np.mean([(s >= 0.5) == y for s, y in held]) > 0.95
    good = {r.doc_id for r in quality.good_documents(docs, labels).collect()}
    assert good == {r.doc_id for r in got if r.predicted}


def test_toxicity(spark):
    def insult(words, r):
        for _ in range(3):
            words.insert(r.randrange(len(words)), r.choice(["grumblefoot", "Snarkwort,", "grumblehead"]))
        return " ".join(words)

    rows = corpus(400, 2, insult)
    docs, labels = frames(spark, rows, "toxic", int)
    got = toxicity.toxicity_scores(docs, labels).collect()
    assert len(got) == 404 and all(0 <= r.score <= 1 for r in got)
    texts = {i: (t, o) for i, t, o in rows}
    held = [(r.score, texts[r.doc_id][1]) for r in got if r.held_out and r.doc_id in texts]
    assert auc(held) > 0.98
    spans = [texts[r.doc_id][0][s.start : s.end].lower() for r in got if r.doc_id in texts for s in r.spans]
    assert len(spans) > 200 and np.mean([x.startswith(("grumble", "snarkwort")) for x in spans]) > 0.97
    assert all(r.predicted == 0 for r in got if r.doc_id in (9001, 9002, 9003))


def test_without_labels(spark):
    docs, _ = frames(spark, corpus(4, 1, lambda w, r: "x"), "quality", int)
    for score, column in ((quality.quality_scores, "quality"), (toxicity.toxicity_scores, "toxic")):
        none = spark.createDataFrame([], f"doc_id long, {column} int")
        assert {r.score for r in score(docs, none).collect()} == {0.5}
        one = spark.createDataFrame([(i, 1) for i in range(4)], f"doc_id long, {column} int")
        assert {r.score for r in score(docs, one).collect()} == {1.0}
        assert score(docs.where("false"), none).count() == 0
    assert quality.good_documents(docs, spark.createDataFrame([], "doc_id long, quality int")).count() == docs.count()


def test_gradients():
    """Back-propagation against differences."""
    net, r = quality.Network(3), np.random.default_rng(0)
    texts = [bytes(r.integers(97, 105, n).astype(np.uint8)) for n in (5, 300, 700)]
    y, weight = np.array([0.0, 1.0, 1.0]), np.array([1.0, 0.5, 2.0])

    def loss():
        # the table is single precision, so steps are large and agreement coarse
        p = net.score(texts, net.table())
        return float((weight * -(y * np.log(p) + (1 - y) * np.log(1 - p))).sum() / 3)

    g = net.gradients(texts, y, weight)
    for name in ("in", "out", "kernel", "embed", "shift"):
        at = np.unravel_index(np.abs(g[name]).argmax(), g[name].shape)
        kept, step = net.p[name][at], 1e-3
        net.p[name][at] = kept + step
        up = loss()
        net.p[name][at] = kept - step
        down = loss()
        net.p[name][at] = kept
        assert (up - down) / (2 * step) == pytest.approx(g[name][at], rel=0.08, abs=1e-4)


def test_chain_marginals():
    """Forward-backward in rows against the sum over all label sequences."""
    from itertools import product

    f = toxicity.Field(-0.3)
    f.move, f.first = np.array([[0.2, -0.5], [0.1, 0.9]]), np.array([0.4])
    t = toxicity.Tokens([b"a b c d e", b"", b"x y", b"one"])
    r = np.random.default_rng(1)
    f.word[t.word], f.prefix[t.prefix] = r.normal(size=t.n), r.normal(size=t.n)
    p = f.marginals(t)[0]
    e = f.word[t.word] + f.prefix[t.prefix] + f.bias[0]
    at = 0
    for n in (5, 2, 1):
        weight = Counter()
        total = 0.0
        for y in product((0, 1), repeat=n):
            w = np.exp(y[0] * f.first[0] + sum(e[at + i] * y[i] for i in range(n)) + sum(f.move[y[i], y[i + 1]] for i in range(n - 1)))
            total += w
            for i in range(n):
                weight[i] += w * y[i]
        assert np.allclose(p[at : at + n], [weight[i] / total for i in range(n)])
        at += n


def test_scores_text_by_text(spark):
    """Scores of a batch against the model applied token by token and window by window to one text at a time."""
    rows = corpus(120, 5, lambda w, r: " ".join(w[:30] + ["grumblefoot"] * r.randrange(1, 4)))
    texts, y = [t.encode() for _, t, _ in rows] + [b"", b"a", b"\xc3\xa9 z" * 300], np.array([float(o) for *_, o in rows] + [0.0] * 3)
    weight = np.ones(len(y))
    m = toxicity.Model(texts, y, weight)
    f, move = m.field, np.exp(m.field.move)
    for text, score in zip(texts, m.score(texts)[0]):
        t = toxicity.Tokens([text])
        odds = np.exp(np.clip(f.word[t.word] + f.prefix[t.prefix] + f.bias[0], -12, 12))
        n, total, sure = t.n, 0.0, 0.0
        ahead, back = np.ones((n, 2)), np.ones((n, 2))
        for i in range(n):
            ahead[i] = ([1.0, np.exp(f.first[0])] if i == 0 else ahead[i - 1] @ move) * np.array([1.0, odds[i]])
            ahead[i] /= ahead[i].sum()
        for i in range(n - 2, -1, -1):
            back[i] = move @ (back[i + 1] * np.array([1.0, odds[i + 1]]))
            back[i] /= back[i].sum()
        for i in range(n):
            p = ahead[i, 1] * back[i, 1] / (ahead[i] * back[i]).sum()
            total += max(p - toxicity.NOISE, 0) / (1 - toxicity.NOISE)
            q = min(max(p, 0.5), 1 - 1e-6)
            sure += np.log(q / (1 - q))
        z = m.head @ np.array([1.0, np.log1p(total), np.log1p(sure)])
        assert score == pytest.approx(1 / (1 + np.exp(-z)), abs=1e-6)

    net = quality.Network(3)
    p, table = net.p, net.table().astype(float)
    for text, score in zip(texts, net.score(texts, net.table())):
        blocks = max(1, -(-len(text) // quality.BLOCK))
        data = np.frombuffer(text.ljust(blocks * quality.BLOCK, b"\0"), np.uint8)
        following = np.frombuffer(b"\0" * quality.WIDTH, np.uint8)
        tops = []
        for b in range(blocks):
            at = [np.concatenate((data, following))[i : i + quality.WIDTH] for i in range(b * quality.BLOCK, (b + 1) * quality.BLOCK)]
            tops.append(np.max([sum(table[w, x[w]] for w in range(quality.WIDTH)) for x in at], axis=0))
        chunks = [np.maximum(tops[b], tops[min(b + 1, blocks - 1)]) for b in range(blocks)]
        x = np.tanh(np.concatenate((np.mean(chunks, axis=0), np.max(chunks, axis=0), [np.log1p(len(text)) / 8])))
        hidden = np.maximum(x @ p["in"] + p["in0"], 0)
        assert score == pytest.approx(1 / (1 + np.exp(-(hidden @ p["out"] + p["out0"][0]))), abs=1e-4)


def test_long_texts_are_fitted_on_windows(spark):
    """A labelled set of long texts alone is fitted; each gives a window that its doc_id draws."""
    rows = [(i, (("GOOD words here. " if i % 2 else "bad!!! $$$ ") * 9000), i % 2) for i in range(60)]
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(i, y) for i, _, y in rows], "doc_id long, quality int")
    texts, y, _ = fitting.labelled_sample(docs, labels, "quality", 3, 1, {0: 100, 1: 100})
    assert 20 < len(texts) < 60 and {len(t) for t in texts} == {fitting.FIT_CHARS} and set(y.tolist()) == {0.0, 1.0}
    assert len({t[:40] for t in texts}) > 2 and texts == fitting.labelled_sample(docs.repartition(5), labels, "quality", 3, 1, {0: 100, 1: 100})[0]
    got = quality.quality_scores(docs, labels).collect()
    assert len(got) == 60 and all(r.predicted == r.doc_id % 2 for r in got)


def test_chain_of_any_length():
    r = np.random.default_rng(2)
    for n in (1, 63, 64, 65, 1000):
        a, b, c, d = r.uniform(0.1, 2, (4, n))
        b[0] = d[0] = 0
        x, want = 1.0, []
        for i in range(n):
            x = (a[i] + b[i] * x) / (c[i] + d[i] * x)
            want.append(x)
        assert np.allclose(toxicity.chain(a, b, c, d), want)


# ---------------------------------------------------------------------------------------------- token files


@pytest.mark.parametrize("bits", [1, 3, 8, 11, 16, 17, 31, 32])
def test_packing(bits):
    ids = np.random.default_rng(bits).integers(0, 1 << bits, 10_000, dtype=np.uint64).astype(np.uint32)
    counts = [0, 4096, 1, 5903]
    f = token_files.TokenFile(token_files.to_file([5, 6, 7, 8], counts, ids, bits))
    assert f.doc_ids.tolist() == [5, 6, 7, 8] and np.diff(f.starts).tolist() == counts
    for a, b in ((0, 10_000), (4095, 4097), (9_999, 10_000), (5, 5), (8192, 8193)):
        assert (f.ids(a, b) == ids[a:b]).all()
    assert len(token_files.pack(ids[:8], bits)) == bits
    with pytest.raises(ValueError):
        token_files.TokenFile(b"x" * 60)


def test_bits():
    assert [token_files.bits_for(n) for n in (1, 2, 3, 256, 257, 49_408)] == [1, 1, 2, 8, 9, 16]


STRANGE = ["Don't   stop", "IT'S 12,34.5 O'clock!!'s", "é,É!  áb  x y\x1cz\x85w", "<|endoftext|> <|ENDOFTEXT|>a", "Ünïcode—dash 漢字かな 🙂🙂x", "a_b-c/d@e.f #1 $2%^&*()[]{}<>?;:\"`~\\|", "", " ", "İstanbul ﬁ ①x́,", "\x00\x01a.\x02b", "ﷺ,a,b", "x" * 3000 + ",y"]


@pytest.mark.parametrize("most", [400_000, 6])
def test_words_encode_alone(monkeypatch, most):
    from tokenizers import Tokenizer

    monkeypatch.setattr(token_files, "CACHE_WORDS", most)

    whole, words = Tokenizer.from_file(word_tokenizer()), token_files.WordEncoder(word_tokenizer())
    for texts in (STRANGE, STRANGE[::-1], [t.upper() for t in STRANGE]):
        ids, n = words.encode([t.encode() for t in texts])
        assert [ids[e - k : e].tolist() for e, k in zip(np.cumsum(n), n)] == [[*whole.encode(t, add_special_tokens=False).ids, 1] for t in texts]


def test_repeated_words_are_looked_up_once():
    """A call looks up each different word once, and a worker that reads the files keeps no words."""

    class Counted(token_files.WordIndex):
        def __getitem__(self, word):
            looked.append(word)
            return super().__getitem__(word)

    looked, words = [], token_files.WordEncoder(word_tokenizer())
    known = dict(words.at)
    words.at = Counted()
    words.at.update(known)
    ids, n = words.encode([b"One two, two", b"two one " * 500])
    assert len(looked) <= 4 + len(known) and n.tolist() == [len(ids) - n[1], n[1]]
    token_files.kept_encoder(word_tokenizer())
    token_files.forget_encoders()
    assert "encoders" not in token_files.worker_cache()


def test_token_round_trip(spark, monkeypatch):
    monkeypatch.setattr(token_files, "FILE_IDS", 300)
    monkeypatch.setattr(token_files, "RANGE_BYTES", 2000)
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(word_tokenizer())
    rows = [(i * 7 % 101, x) for i, x in enumerate(STRANGE * 5)] + [(500, None), (501, "long text " * 20_000), (502, "same"), (502, "same")]
    df = spark.createDataFrame([(i, x, 0) for i, x in rows], "doc_id long, text string, start int")
    got = sorted(map(tuple, token_files.token_output(df, word_tokenizer()).collect()))
    at = 0
    for (i, x), (doc, start, n, crc) in zip(sorted(rows, key=lambda r: r[0]), sorted(got, key=lambda g: g[1])):
        assert (doc, start) == (i, at)
        if [r[0] for r in rows].count(i) == 1 or x == "same":
            ids = np.array([*t.encode(x or "", add_special_tokens=False).ids, 1], "<u4")
            assert (n, crc) == (len(ids), zlib.crc32(ids))
        at += n
    assert token_files.token_output(df.where("false"), word_tokenizer()).count() == 0
    assert token_files.token_output(spark.createDataFrame([(None, "a")], "doc_id long, text string"), word_tokenizer()).first().doc_id is None


def test_ids_at_both_ends_and_none(spark):
    rows = [(-(1 << 63), "least"), (None, "none"), ((1 << 63) - 1, "most"), (0, "zero"), (None, None)]
    got = {r.start: r for r in token_files.token_output(spark.createDataFrame(rows, "doc_id long, text string"), word_tokenizer()).collect()}
    assert [got[s].doc_id for s in sorted(got)] == [None, None, -(1 << 63), 0, (1 << 63) - 1]


def test_files_are_ordered_by_number(spark):
    files = [("1000000-0000-1.ids", 1_000_000, 0, 5), ("999999-0010-7.ids", 999_999, 10, 3), ("999999-0002-7.ids", 999_999, 2, 2), ("000000-0000-0.ids", 0, 0, 1)]
    written = spark.createDataFrame([(n, p, k, 1, i) for n, p, k, i in files], "name string, part long, number long, documents long, ids long")
    assert {r.name: r.base for r in token_files.file_bases(written).collect()} == {files[3][0]: 0, files[2][0]: 1, files[1][0]: 3, files[0][0]: 6}


def test_other_tokenizers_encode_whole_texts(spark, tmp_path):
    """A tokenizer with other rules than the word encoder's never goes through it: here one that keeps case."""
    rules = json.loads(Path(word_tokenizer()).read_text())
    cased = rules | {"normalizer": None, "pre_tokenizer": {"type": "Whitespace"}, "added_tokens": [], "model": {"type": "WordLevel", "vocab": {"?": 0, "end": 1, "Cat": 2, "cat": 3, ",": 4}, "unk_token": "?"}}
    path = tmp_path / "cased.json"
    path.write_text(json.dumps(cased))
    assert token_files.by_words(word_tokenizer()) and not token_files.by_words(str(path))
    for change in ({"normalizer": None}, {"pre_tokenizer": None}, {"truncation": {"max_length": 5}}, {"added_tokens": [{"content": "cat", "normalized": False}]}, {"model": rules["model"] | {"end_of_word_suffix": None}}):
        other = tmp_path / "other.json"
        other.write_text(json.dumps({k: v for k, v in (rules | change).items()}))
        assert not token_files.by_words(str(other))
    df = spark.createDataFrame([(1, "Cat, cat"), (2, None), (3, "CAT")], "doc_id long, text string")
    got = {r.doc_id: (r.start, r.n_tokens, r.ids_crc32) for r in token_files.token_output(df, str(path)).collect()}
    crc = lambda *ids: zlib.crc32(np.array(ids, "<u4"))
    assert got == {1: (0, 4, crc(2, 4, 3, 1)), 2: (4, 1, crc(1)), 3: (5, 2, crc(0, 1))}


# ---------------------------------------------------------------------------------------------- archives


def test_archives(spark, tmp_path):
    big, other = "<p>é</p>" * 200, "x" * 999
    rows = [(1, "http://a/\r\nX: y", big), (2, None, big), (3, "http://c", big), (4, "u", other), (5, "u", other), (6, "u", None), (7, "u", ""), (8, "u", "z" * 1000), (None, "n", big), (3, "http://again", big), (9, "u", "y" * 3_000_000)]
    df = spark.createDataFrame([(i, u, h, "clash") for i, u, h in rows], "page_id long, url string, html string, payload string")
    folder = f"file://{tmp_path}/archives"
    assert warc.write_archives(df, folder).count() >= 1
    records = warc.read_archives(spark, folder)
    want = []
    for i, _, h in rows:
        p = (h or "").encode()
        same = [j for j, _, g in rows if (g or "") == (h or "") and j is not None]
        revisit = len(p) >= 1000 and len(same) > 1 and i != max(same) or (i is None and len(p) >= 1000 and bool(same))
        want.append((i, len(p), hashlib.sha1(p).hexdigest(), "revisit" if revisit else "response", max(same) if revisit else None))
    key = lambda r: str(r)
    assert sorted(map(tuple, records.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to").collect()), key=key) == sorted(want, key=key)
    full = warc.resolve_revisits(records).collect()
    assert sorted(((r.page_id, bytes(r.payload)) for r in full), key=key) == sorted(((i, (h or "").encode()) for i, _, h in rows), key=key)
    assert warc.archive_round_trip(df.where("false")).count() == 0


def test_originals_by_headers(spark, monkeypatch):
    """Beyond a broadcast, only possible revisits are joined; records are the same."""
    big, other = "<p>é</p>" * 200, "q" * 2000
    rows = [(i, f"u{i}", big if i % 3 else other) for i in range(40)] + [(None, "n", big), (39, "again", other), (5, "again", big), (50, None, "z" * 1500), (51, "v", "small"), (52, "v", "small"), (None, "m", "y" * 1500)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    took = lambda: sorted(((r.page_id, r.url, r.digest, r.refers_to, r.refers_url) for r in warc.with_originals(df).collect()), key=str)
    want = took()
    assert sum(w[3] is not None for w in want) == 40
    monkeypatch.setattr(common, "BROADCAST_BYTES", 0)
    for heavy in (4096, 2):
        monkeypatch.setattr(common, "HEAVY", heavy)
        assert took() == want


def test_records_have_ids_and_dates_of_their_own(spark, tmp_path):
    big = "<p>é</p>" * 200
    df = spark.createDataFrame([(1, "a", big), (1, "a", big), (None, "a", big), (0, "b", big), (None, None, "x")], "page_id long, url string, html string")
    folder = f"{tmp_path}/archives"
    assert sum(r.records for r in warc.write_archives(df, f"file://{folder}").collect()) == 5
    heads = [m.partition(b"\r\n\r\n")[0].decode() for f in Path(folder).glob("*.warc.gz") for m in warc.members(f.read_bytes())]
    field = lambda name: re.findall(rf"^{name}: (\S+)\r?$", "\n".join(heads), re.M)
    assert len(set(field("WARC-Record-ID"))) == 5 and len(field("WARC-Refers-To-Page-ID")) == 2
    assert len(set(field("WARC-Date"))) == 1 and abs((datetime.now(UTC) - datetime.fromisoformat(field("WARC-Date")[0])).total_seconds()) < 300


def test_reading_is_linear():
    """The bytes that a reader unpacks and copies grow with the file, not with its square."""
    one = warc.record(1, "u", b"abc" * 50, hashlib.sha1(b"abc" * 50).hexdigest(), None, None, "2026-01-01T00:00:00Z")

    def seconds(n):
        began = time.process_time()
        assert sum(1 for _ in warc.members(one * n)) == n
        return time.process_time() - began

    seconds(500)
    assert min(seconds(16_000) for _ in range(2)) < 12 * min(seconds(4_000) for _ in range(2)) + 0.05
    with pytest.raises(ValueError, match="cut short"):
        list(warc.members(one[:-9]))


def test_damaged_archives_are_noticed():
    raw = next(warc.members(warc.record(1, "u", b"abc", hashlib.sha1(b"abc").hexdigest(), None, None, "2026-01-01T00:00:00Z")))
    assert warc.parse(raw)["payload"] == b"abc"
    with pytest.raises(ValueError):
        warc.parse(raw.replace(b"abc", b"abd"))


# ---------------------------------------------------------------------------------------------- mixing


def fill(caps, weights, total):
    """Water-filling by rounds: clamp, share the excess by weight, until none is above."""
    target, free = {}, set(caps)
    while free:
        rest = total - sum(target.values())
        share = {s: rest * weights[s] / sum(weights[x] for x in free) for s in free}
        over = {s for s in free if share[s] > caps[s]}
        if not over:
            return target | share
        target |= {s: caps[s] for s in over}
        free -= over
    return target


def test_mix(spark):
    r = random.Random(5)
    rows = [(i, r.choice(["b", "a", "é", "Z", None]) if i % 3 else "hot", "w " * r.randrange(0, 60)) for i in range(600)] + [(9, "b", None), (None, "a", "x y"), (7, "solo", ""), (8, "a", "x y")]
    df = spark.createDataFrame([(i, s, t, 1, "c") for i, s, t in rows], "doc_id long, source string, text string, target int, n_chars string")
    got = mixing.mix(df).collect()
    assert len(got) == len(rows)
    sources = sorted({s for _, s, _ in rows if s is not None}) + [None]
    size = {s: sum(len((t or "").split()) for _, x, t in rows if x == s) for s in sources}
    weights = {s: (5.0, 2.0, 1.0)[i % 3] for i, s in enumerate(sources)}
    target = fill({s: 2.0 * size[s] for s in sources}, weights, 1.5 * sum(size.values()))
    assert sorted({(round(g.target, 6), g.source_size) for g in got}) == sorted({(round(target[s], 6), size[s]) for s in sources})
    assert all(0 <= g.taken <= 2 * g.size for g in got)
    taken = Counter()
    for g in got:
        taken[round(g.target, 6)] += g.taken
    for s in sources:
        same = sum(round(target[x], 6) == round(target[s], 6) for x in sources)
        assert taken[round(target[s], 6)] == pytest.approx(same * target[s], abs=3 * same)
    assert sorted(map(str, mixing.mix(df.repartition(7)).collect())) == sorted(map(str, got))
    mixed = mixing.mixed_documents(df.drop("n_chars").withColumn("n_chars", F.length("text").cast("bigint")))
    words = Counter()
    for m in mixed.collect():
        words[m.doc_id] += len((m.text or "").split())
    assert {d: n for d, n in words.items() if n} == {d: n for d, n in sum((Counter({g.doc_id: g.taken}) for g in got), Counter()).items() if n}


def test_mix_of_nothing(spark):
    df = spark.createDataFrame([], "doc_id long, source string, text string")
    assert mixing.mix(df).count() == 0 and mixing.mixed_documents(df).count() == 0
    one = spark.createDataFrame([(1, "a", "")], "doc_id long, source string, text string")
    assert tuple(mixing.mix(one).first()) == (1, 0, 0, 0.0, 0)


# ---------------------------------------------------------------------------------------------- personal data

BASE = [("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"), ("card", r"[0-9]([\x20-]?[0-9])+"), ("phone", r"\+[0-9][\x20().0-9-]+[0-9]")]


def luhn(d):
    return sum(int(c) if i % 2 == 0 else sum(map(int, str(2 * int(c)))) for i, c in enumerate(reversed(d))) % 10 == 0


def base(text):
    out = []
    for rank, (kind, pattern) in enumerate(BASE):
        for m in re.finditer(pattern, text or ""):
            d = re.sub("[^0-9]", "", m[0])
            if {"email": True, "ip": kind != "ip" or all(int(x) <= 255 for x in m[0].split(".")), "card": 12 <= len(d) <= 19 and luhn(d), "phone": 9 <= len(d) <= 15}[kind]:
                out.append((m.start(), rank, kind, m.end()))
    return sorted(out)


ODD = [
    "a@b.c%d@e.f a@b@c.d.e. x..y@z.w é💥 1.2.3.4.5.6.7.8 300.1.2.3.4.5.6 4111 1111-1111 1111 +1 (234) 555-1234.", None, "", "\x01\x02 4111111111111111\x05 a\x06b@c.d \x01 x@y.zz",
    "1 2 3 4 5 6 7 8 9 0 " * 1500, "a@" + "b." * 5000 + "c", "0001.002.3.4 .@x.y a@b.c.@x.y +12345678 9 +1-------2345678901", "4111-1111 1111--1111 4111 1111 1111 1111 5 4111111111111111 41111111111111111111111", "a" * 50_000,
]


def test_base_spans(spark):
    r = random.Random(9)
    alphabet = ["a", "b@", "@", ".", "1", "22", "4111111111111111", " ", "-", "+1", "(", ")", "255", "256", "é", "%"]
    rows = list(enumerate(ODD + ["".join(r.choice(alphabet) for _ in range(60)) for _ in range(150)]))
    df = spark.createDataFrame([(i, t, 1) for i, t in rows], "doc_id long, text string, row int")
    got = {r.doc_id: r for r in pii.personal_data(df).collect()}
    for i, t in rows:
        spans = base(t)
        listed = [f"{k}:{a}:{b}" for a, _, k, b in spans]
        assert [getattr(got[i], f"n_{k}") for k, _ in BASE] == [sum(s[2] == k for s in spans) for k, _ in BASE]
        assert got[i].base_sha256 == hashlib.sha256(",".join(listed).encode()).hexdigest()
        assert not set(listed) - set(got[i].spans.split(","))
    assert pii.personal_data(df.where("false")).count() == 0


def test_sums_before(spark):
    for n in (0, 1, 63, 64, 65, 4095, 4096, 4097, 9000):
        got = spark.range(1).select(pii.sums_before(F.expr(f"transform(sequence(0, {n}), x -> cast(x % 7 as bigint))")).alias("s")).first().s
        assert got == [0, *np.cumsum([x % 7 for x in range(n)]).tolist()]


def test_spans_of_long_texts_take_linear_time(spark):
    """Four times the text takes about four times the time; a fold that copies its result would take sixteen times."""

    def seconds(n):
        df = spark.createDataFrame([(1, "".join(f"user{i}@mail.org, 10,0,{i % 99},1 " for i in range(n)))], "doc_id long, text string")
        began = time.perf_counter()
        (row,) = pii.personal_data(df).collect()
        assert row.n_email == n
        return time.perf_counter() - began

    seconds(500)
    assert seconds(16_000) < 8 * seconds(4_000)


def test_neighbours_are_judged_alone(spark):
    """An address beside another number is an instance of its own; a long neighbour word is one pattern; runs hold their tokens."""
    long = "w" * 100
    rows = [(i, f"server 10.0.{i}.7 down") for i in range(12)] + [(100, "server 4711 10,0,0,1 down"), (101, "server 10,0,0,2 down"), (102, "a@b.com 10,0,0,3 down")]
    rows += [(200 + i, f"{long} +4930123456{i:02d} called") for i in range(12)] + [(300, f"{long} 030 1234567 called"), (301, f"{long[:-1]} 030 1234568 went"), (302, f"{long}\n\t0301234569 called")]
    got = {r.doc_id: r.spans for r in pii.personal_data(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[101] == "ip:7:15" and got[302].startswith("phone:") and got[300] == "phone:101:112" and got[301] == ""
    assert got[102].startswith("email:0:7")


TEMPLATES = {
    "email": ["write to {} today", "my address {} works", "mail {} about it"], "ip": ["server {} is down", "ping {} failed", "host {} answered"],
    "card": ["card number {} was charged", "paid with {} yesterday", "the card {} expired"], "phone": ["call me on {} please", "phone: {} (evenings)", "reach him at {} now"],
}
OTHERS = ["invoice {} arrived", "in the year {} it rained", "order {} was sent", "page {} is missing", "about {} people came", "call {} witnesses", "the card {} of the deck"]


def disguised(r, kind):
    """An identifier of a kind as the base patterns find it, and one that they do not."""
    n = lambda k: "".join(r.choice("0123456789") for _ in range(k))
    if kind == "email":
        return f"u{n(4)}@mail.org", f"u{n(4)}@mail"
    if kind == "ip":
        return ".".join(str(r.randrange(256)) for _ in range(4)), ",".join(str(r.randrange(256)) for _ in range(4))
    if kind == "phone":
        return f"+49{n(9)}", f"0{n(9)}"
    good = next(c for c in iter(lambda: "4" + n(15), None) if luhn(c))
    return good, next(c for c in iter(lambda: "4" + n(15), None) if not luhn(c))


def test_recall_and_precision_of_what_is_added(spark):
    """Of identifiers that no base pattern finds, in contexts that others share, most are added, and little else is."""
    r, rows, hidden = random.Random(11), [], set()
    words = "the river walks over green hills and sings while old houses sleep".split()
    for i in range(700):
        text = " ".join(r.choice(words) for _ in range(r.randrange(3, 30)))
        for _ in range(r.randrange(1, 4)):
            if r.random() < 0.4:
                text += ". " + r.choice(OTHERS).format(r.randrange(10 ** r.randrange(1, 13)))
            else:
                kind = r.choice(list(TEMPLATES))
                known, other = disguised(r, kind)
                before, after = r.choice(TEMPLATES[kind]).split("{}")
                secret = r.random() < 0.2
                text += ". " + before
                if secret:
                    hidden.add((i, len(text), len(text) + len(other), kind))
                text += (other if secret else known) + after
            text += " " + " ".join(r.choice(words) for _ in range(r.randrange(6)))
        rows.append((i, text))
    got = pii.personal_data(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    own = {(i, a, b, k) for i, t in rows for a, _, k, b in base(t)}
    added = {(x.doc_id, int(a), int(b), k) for x in got for k, a, b in (s.split(":") for s in x.spans.split(",") if s)} - own
    hidden -= own
    print(f"hidden {len(hidden)}, added {len(added)}, recall {len(hidden & added) / len(hidden):.3f}, precision {len(hidden & added) / max(1, len(added)):.3f}")
    assert len(hidden) > 100 and len(hidden & added) > 0.9 * len(hidden) and len(hidden & added) > 0.9 * len(added)


def test_contexts_discover(spark):
    """Numbers that fail the card test are found where the words around them mark cards, and nowhere else."""
    cards = [str(n) for n in range(4111111111110000, 4111111111110400) if luhn(str(n))]
    rows = [(i, f"I paid with card {cards[i]} today, number {i}.") for i in range(20)]
    rows += [(100, "é she paid with card 4111111111111112 today"), (101, "the invoice 4111111111111112 came"), (102, "paid with card soon today")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r for r in pii.personal_data(df).collect()}
    assert got[100].spans == "card:21:37" and got[100].n_card == 0 and got[0].n_card == 1
    assert got[101].spans == got[102].spans == ""
    again = {r.doc_id: r.spans for r in pii.personal_data(df.union(df)).collect()}
    assert again == {i: r.spans for i, r in got.items()}


# ---------------------------------------------------------------------------------------------- pipeline


def test_pipeline(spark, small):
    pipeline = pytest.importorskip("corpus_pipeline")
    docs = spark.read.parquet(f"{small}/documents.parquet")
    assert [n for n, _ in pipeline.STAGES] == ["quality", "near_duplicates", "decontamination", "mixing", "tokens"]
    kept, counts = docs, []
    for name, stage in pipeline.STAGES:
        out = pipeline.materialize(stage(spark, kept, small), f"test-{name}")
        if name != "tokens":
            assert out.schema.names == docs.schema.names
        kept = out
        counts.append(kept.count())
    assert docs.count() > counts[0] > counts[1] >= counts[2] and counts[3] == counts[4]
    assert sorted(map(tuple, pipeline.run(spark, small).collect())) == sorted(map(tuple, kept.collect()))


def test_pipeline_with_odd_rows(spark, small):
    """Null ids, null and empty texts, repeated rows, ids at both ends, further columns; and a table without rows."""
    pipeline = pytest.importorskip("corpus_pipeline")
    docs = spark.read.parquet(f"{small}/documents.parquet").limit(40)
    text = docs.where("length(text) > 200").first().text
    odd = [(None, text + " one more"), (None, text[::-1]), (None, None), (1, ""), (1, text), (1, text), ((1 << 63) - 1, "a b c"), (-(1 << 63), None)]
    more = spark.createDataFrame([(i, t, None, None, None) for i, t in odd], docs.schema)
    both = docs.unionByName(more).withColumn("h", F.lit(1)).withColumn("component_id", F.lit("x")).withColumn("size", F.lit(2.5))
    for table in (both, both.where("false")):
        kept = table
        for name, stage in pipeline.STAGES:
            kept = pipeline.materialize(stage(spark, kept, small), f"odd-{name}")
            if name != "tokens":
                assert kept.columns == both.columns
        assert bool(kept.count()) == bool(table.count())
    distinct = pipeline.keep_distinct(spark, both, small).select("doc_id", "text").collect()
    ids = [r.doc_id for r in distinct]
    assert ids.count(1) in (1, 2) and text[::-1] in {r.text for r in distinct if r.doc_id is None}
    assert -(1 << 63) in ids and (1 << 63) - 1 in ids


def test_stages_take_columns_of_any_name(spark):
    """Names with dots and backticks come through every stage that keeps rows."""
    words = " ".join(f"word{i}" for i in range(60))
    rows = [(i, f"{words} {i}", i % 2, i, "s", 1, 2, 3) for i in range(12)]
    df = spark.createDataFrame(rows, "doc_id long, text string, `a.b` int, `c``d` int, source string, c0 int, row int, size int")
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(12)], "doc_id long, quality int, toxic int")
    bench = spark.createDataFrame([(1, "nothing of that kind is in any of these documents at all")], "item_id long, text string")
    for out in (quality.good_documents(df, labels), decontaminate.clean_documents(df, bench), mixing.mixed_documents(df)):
        assert out.columns == df.columns
        assert {tuple(r)[2:] for r in out.collect()} <= {r[2:] for r in rows}
    assert decontaminate.clean_documents(df, bench).count() == 12


def test_tokens_of_bytes_that_are_no_text(spark):
    df = spark.sql("SELECT 1L AS doc_id, cast(unhex('61FF62') AS string) AS text UNION ALL SELECT 2L, 'a�b'")
    one, other = sorted(tuple(r)[2:] for r in token_files.token_output(df, word_tokenizer()).collect())
    assert one == other

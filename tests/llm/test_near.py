"""The pipeline's near-duplicates against the similarity of all pairs."""

import hashlib
import random

import corpus_pipeline
import numpy as np
import pyarrow as pa
import pytest

from evidara.llm import common, grouping, near, simhash

DOCS = "doc_id long, text string, lang string, source string, n_chars int"


def docs(spark, rows):
    return spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], DOCS)


def shingles(text):
    w = (text or "").encode().lower().split()
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} or ({tuple(w)} if w else set())


def firsts(rows):
    """Smallest doc_id of each component, of all pairs."""
    sets, root = [shingles(t) for _, t in rows], list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if a == b or 5 * len(a & b) >= 4 * len(a | b):
                root[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        least[find(i)] = min(d, least.get(find(i), d))
    return sorted(least.values())


def edited(n=260, seed=3):
    """Texts of 5 to 150 words with up to a twelfth of their words changed, dropped or added: on both sides of 0.8."""
    r = random.Random(seed)
    line = "this very common line stands in many of the texts here".split()
    base = [[r.choice("abcdefgh") + str(r.randrange(60)) for _ in range(r.choice((5, 12, 30, 60, 150)))] for _ in range(40)]
    rows = []
    for i in range(n):
        words = list(r.choice(base))
        for _ in range(r.randrange(1 + max(1, len(words) // 12))):
            at = r.randrange(len(words))
            words[at : at + r.randrange(2)] = [f"new{i}"] * r.randrange(2)
        rows.append((i * 3 % 1009, " ".join(words + line * (r.random() < 0.4))))
    return rows


ODD = [(2000, None), (2001, ""), (2002, " \t "), (2003, "A b"), (2004, "a B"), (2005, "a b c"), (2006, "é ü " * 900), (2007, "w " * 50), (2008, "w " * 9)]


def test_stage_against_all_pairs(spark, small):
    rows = edited() + ODD
    want = firsts(rows)
    assert 40 < len(want) < len(rows) - 40
    kept = corpus_pipeline.keep_distinct(spark, docs(spark, rows), small)
    assert sorted(r.doc_id for r in kept.collect()) == want


def test_one_changed_word(spark, small):
    words = [f"w{i}" for i in range(100)]
    other = words[:50] + ["new"] + words[51:]
    kept = corpus_pipeline.keep_distinct(spark, docs(spark, [(1, " ".join(words)), (2, " ".join(other))]), small)
    assert [r.doc_id for r in kept.collect()] == [1]


@pytest.mark.parametrize("groups", [simhash.simhash_groups, near.near_groups])
def test_null_and_repeated_ids(spark, groups):
    """Only a row whose own component has another representative goes."""
    a, b, c, d, e = (" ".join(f"{x}{i}" for i in range(80)) for x in "abcde")
    rows = [(1, a), (None, a), (None, b), (None, c), (None, c), (2, d), (2, e), (3, d), (4, None), (4, ""), (5, "x"), (5, "y")]
    kept = simhash.one_of_each(docs(spark, rows), groups)
    got = sorted(((r.doc_id or 0, r.text or "") for r in kept.collect()))
    assert got == sorted([(1, a), (0, c), (2, d), (4, ""), (5, "x"), (5, "y"), (2, e), (0, b)])


@pytest.mark.parametrize("weight, held, strip, broadcast", [(400, 3, 5, 1), (1500, 50, 40, 2 << 20), (1, 1, 1, 2 << 20)])
def test_small_chunks_and_parts(spark, small, monkeypatch, weight, held, strip, broadcast):
    """Large buckets and groups in chunks, long groupings in parts, and joins without broadcasts give the same kept documents."""
    for name, value in (("BUCKET_BYTES", weight), ("GROUP_BYTES", 4 * weight), ("HELD", held), ("STRIP", strip)):
        monkeypatch.setattr(near, name, value)
    monkeypatch.setattr(common, "BROADCAST_BYTES", broadcast)
    rows = edited(160, seed=8) + ODD
    kept = corpus_pipeline.keep_distinct(spark, docs(spark, rows), small)
    assert sorted(r.doc_id for r in kept.collect()) == firsts(rows)


def described_sets(spark, rows):
    """The rows' table, described, and its sets."""
    of = near.materialize(near.described(docs(spark, rows)).withColumn("row", near.F.monotonically_increasing_id()), "test-near")
    return docs(spark, rows), of, of.dropDuplicates(["fp"]).select("fp", "h", "size", "simhash", "sketch")


def test_fingerprint_links_come_first(spark, small, monkeypatch):
    """The stage's first links are those of SimHash fingerprints of five words that hold for the whole sets."""
    long = [[f"{x}{i}" for i in range(500)] for x in "abcd"]
    rows = [(10 * k + j, " ".join(words[: 500 - j] + ["other"] * j)) for k, words in enumerate(long) for j in (0, 1, 2)]
    prints = {i: simhash.fingerprint(t.encode(), near.SHINGLE) for i, t in rows}
    df, of, sets = described_sets(spark, rows)
    assert {r.doc_id: r.simhash & (1 << 64) - 1 for r in of.collect()} == prints
    name = {r.doc_id: r.fp for r in of.collect()}
    want = {tuple(sorted((name[i], name[j]))) for i in name for j in name if i < j and (prints[i] ^ prints[j]).bit_count() <= simhash.BITS}
    assert want and all(abs(i - j) < 10 for i in name for j in name if tuple(sorted((name[i], name[j]))) in want)
    roots = {r.node: r.root for r in common.components(near.simhash_links(sets)).collect()}
    assert roots and all(roots[a] == roots[b] for a, b in want) and set(roots) == {x for p in want for x in p}

    asked = []
    monkeypatch.setattr(near, "simhash_links", lambda *a, own=near.simhash_links: asked.append(own(*a)) or asked[-1])
    assert sorted(r.doc_id for r in corpus_pipeline.keep_distinct(spark, df, small).collect()) == firsts(rows)
    assert len(asked) == 1


def test_equal_fingerprints_of_other_texts(spark, small, monkeypatch):
    """Fingerprints that link unlike texts link nothing; those that tell all texts apart lose nothing."""
    rows = edited(60, seed=4)
    for same in (True, False):
        monkeypatch.setattr(near, "fingerprint", lambda t, n, same=same: 7 if same else int.from_bytes(hashlib.md5(t).digest()[:8], "big"))
        kept = corpus_pipeline.keep_distinct(spark, docs(spark, rows), small)
        assert sorted(r.doc_id for r in kept.collect()) == firsts(rows)


def test_links_of_a_part():
    """Links of own members, or of visitors with these, join just what all pairs within the bounds join."""
    r = random.Random(5)
    seeds = [set(r.sample(range(1, 60), r.randrange(30, 40))) for _ in range(25)]
    sets = seeds + [{x for x in r.choice(seeds) if r.random() > 0.04} | set(r.sample(range(1, 60), 1)) for _ in range(65)]
    n = len(sets)
    doc, h = np.repeat(np.arange(n), [len(s) for s in sets]), near.mix64(np.array([x for s in sets for x in sorted(s)], np.uint64))
    sketch = near.sketches(n, doc, h)
    root = [i if r.random() < 0.8 else 1000 + r.randrange(3) for i in range(n)]
    want = set()
    for i in range(n):
        for j in range(i):
            apart = int(np.bitwise_count(np.frombuffer(sketch[i], np.uint64) ^ np.frombuffer(sketch[j], np.uint64)).sum())
            assert apart <= len(sets[i] ^ sets[j])
            if 9 * apart <= len(sets[i]) + len(sets[j]):
                want.add((j, i))

    def joined(pairs):
        up = {x: x for x in root}
        top = lambda x: x if up[x] == x else top(up[x])
        for i, j in pairs:
            up[top(root[i])] = top(root[j])
        return sorted(sorted(x for x in up if top(x) == t) for t in {top(x) for x in up})

    def found(own, visitors=()):
        at = [*own, *visitors]
        kinds = {"part": 1, "kind": 0, "fp": 0, "root": 0, "size": 0, "pos": 0}
        table = pa.table({**kinds, "part": [1] * len(at), "kind": [grouping.OWN] * len(own) + [grouping.VISITOR] * len(visitors), "fp": at, "root": [root[i] for i in at], "size": [len(sets[i]) for i in at], "pos": [0] * len(at), "sketch": [sketch[i] for i in at]})
        return list(grouping.Part(table, near.within_bound).links())

    whole = found(range(n))
    assert len(want) > 20 and {tuple(sorted(p)) for p in whole} <= want and joined(whole) == joined(want) and len(whole) < len(set(root))
    a, b = range(0, n, 2), range(1, n, 2)
    assert joined(found(a) + found(b) + found(a, b)) == joined(want)


def test_sketches_fold():
    """A sketch of more words, folded, is that of fewer; sets of any size get a power of two of words."""
    h = near.mix64(np.arange(1, 40_001).astype(np.uint64))
    for n in (1, 5, 128, 129, 4000, 40_000):
        (s,) = near.sketches(1, np.zeros(n, np.int64), h[:n])
        words = len(s) // 8
        assert words & (words - 1) == 0 and near.LEAST_WORDS <= words <= near.MOST_WORDS
        folded = np.bitwise_xor.reduce(np.frombuffer(s, np.uint64).reshape(-1, near.LEAST_WORDS), axis=0)
        want = np.zeros(near.LEAST_WORDS, np.uint64)
        np.bitwise_xor.at(want, ((h[:n] >> np.uint64(6)) % np.uint64(near.LEAST_WORDS)).astype(np.int64), np.uint64(1) << (h[:n] & np.uint64(63)))
        assert (folded == want).all()


def test_few_jobs(spark, small):
    """The stage takes a bounded number of jobs, and changes nothing of the driver's JVM."""
    tracker, group = spark.sparkContext.statusTracker(), "near-jobs"
    spark.sparkContext.setJobGroup(group, group)
    rows = edited(60, seed=6)
    assert sorted(r.doc_id for r in corpus_pipeline.keep_distinct(spark, docs(spark, rows), small).collect()) == firsts(rows)
    jobs = len(tracker.getJobIdsForGroup(group))
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert 10 < jobs < 150, jobs

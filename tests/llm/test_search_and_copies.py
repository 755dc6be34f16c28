"""Exact top-k, SimHash components, substring removal and decontamination against brute force, with the odd cases."""

import hashlib
import math
import random

import numpy as np
import pytest

from evidara.llm import common, decontaminate, simhash, substrings, topk

DOCS = "doc_id long, text string, size string, source string, component_id int"


def docs(spark, rows):
    """Documents with columns whose names clash with outputs."""
    return spark.createDataFrame([(i, t, "x", "y", 3) for i, t in rows], DOCS)


# ---------------------------------------------------------------------------------------------- top-k


def brute_top(rows, k=10, step=100):
    good = [(i, [math.floor(1024 * x) for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = {}
    for q in sorted({i for i, _ in good if i % step == 0}):
        own = min(v for i, v in good if i == q)
        best = sorted((-sum(a * b for a, b in zip(own, v)), i) for i, v in good if i != q and len(v) == len(own))[:k]
        out |= {(q, n): (i, -s) for n, (s, i) in enumerate(best, 1)}
    return out


def top(spark, rows, **how):
    df = spark.createDataFrame([(i, v, "c") for i, v in rows], "vec_id long, embedding array<double>, score string")
    return {(r.query_id, r["rank"]): (r.vec_id, r.score) for r in topk.top_k(df, **how).collect()}


def test_top_k(spark):
    r = np.random.default_rng(1)
    rows = [(i, r.normal(0, 0.2, 24).tolist()) for i in range(350)]
    rows += [(i, [0.5] * 24) for i in (400, 401, 402)] + [(500, None), (501, [float("nan")] * 24), (502, [None] * 24), (503, [float("inf")] + [0.0] * 23), (600, [1.0, 2.0]), (601, [1.0, 1.0]), (700, []), (701, []), (None, [0.1] * 24), (300, [0.0] * 24), (3, rows[3][1])]
    assert top(spark, rows) == brute_top(rows)
    assert top(spark, rows, k=3, step=7) == brute_top(rows, 3, 7)


def test_top_k_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(topk, "QUERY_BYTES", 700)
    rows = [(i, np.random.default_rng(i).normal(0, 0.3, 9).tolist()) for i in range(120)]
    assert top(spark, rows, k=4, step=6) == brute_top(rows, 4, 6)


def test_top_k_in_files(spark, monkeypatch):
    """Blocks of queries in files, candidates gathered by the batch, lengths mixed."""
    monkeypatch.setattr(topk, "QUERY_BYTES", 300)
    monkeypatch.setattr(topk, "GATHER_BYTES", 900)
    r = np.random.default_rng(2)
    rows = [(i, r.normal(0, 0.3, 5 + i % 3).tolist()) for i in range(150)] + [(20, [9.0] * 5), (151, None)]
    assert top(spark, rows, k=3, step=5) == brute_top(rows, 3, 5)


def test_top_k_beyond_doubles(spark):
    rows = [(i, [x * 1e3 + i, -3.5e5, 7.25]) for i, x in enumerate((1.0, -2.0, 3.0, 900.0, 17.5))]
    assert top(spark, rows, k=2, step=2) == brute_top(rows, 2, 2)


def test_top_k_of_nothing(spark):
    assert top(spark, []) == {} and top(spark, [(100, [1.0])]) == {} and top(spark, [(1, [1.0])]) == {}


def test_bounds_hold():
    r = np.random.default_rng(5)
    v = np.floor(1024 * r.normal(0, 1, (60, 37)))
    for n in (1, 4, 16, 37):
        s = topk.statistics(v, n)
        assert (s @ s.T >= v @ v.T - 1e-6 * np.abs(v).max() ** 2).all()


# ---------------------------------------------------------------------------------------------- SimHash


def reach(fps):
    root = list(range(len(fps)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(fps)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= 2:
                root[max(find(i), find(j))] = min(find(i), find(j))
    return [find(i) for i in range(len(fps))]


def check_components(spark, rows):
    ids = [i for i, _ in rows]
    fps = [simhash.fingerprint(t and t.encode()) for _, t in rows]
    groups: dict[int, list[int]] = {}
    for i, g in zip(ids, reach(fps)):
        groups.setdefault(g, []).append(i)
    want = sorted((i, f"{f:016x}", min(groups[g])) for i, f, g in zip(ids, fps, reach(fps)))
    assert sorted(map(tuple, simhash.simhash_groups(docs(spark, rows)).collect())) == want
    kept = simhash.one_of_each(docs(spark, rows))
    assert kept.columns == DOCS.replace(" long", "").replace(" string", "").replace(" int", "").split(", ")
    assert sorted(r.doc_id for r in kept.collect()) == sorted({m for _, _, m in want})


def near_copies(n, seed=2):
    r = random.Random(seed)
    base = [r.choice("abcdefghij") + str(r.randrange(40)) for _ in range(400)]
    rows = []
    for i in range(n):
        words = list(base)
        for _ in range(r.randrange(3)):
            words[r.randrange(400)] = "new" + str(i)
        rows.append((i * 3, " ".join(words)))
    return rows


def test_components(spark):
    rows = near_copies(60) + [(1000 + i, "word " * i) for i in range(6)] + [(2000, None), (2001, ""), (2002, " \t "), (2003, "A b"), (2004, "a B"), (5, "a B"), (2005, "é ü " * 9000), (7, "x y z w"), (7, "x y z w")]
    check_components(spark, rows)


def test_components_of_large_buckets(spark, monkeypatch):
    monkeypatch.setattr(simhash, "BUCKET", 3)
    check_components(spark, near_copies(80, 4))


def test_no_link_is_lost():
    """Pigeonhole and pivots against all pairs, on fingerprints close enough to chain."""
    r = random.Random(1)
    fps = {r.getrandbits(64) for _ in range(30)}
    for f in list(fps):
        for _ in range(6):
            f ^= (1 << r.randrange(64)) | (1 << r.randrange(64))
            fps.add(f)
    fps = sorted(fps)
    keep = [int(np.int64(m).view(np.uint64)) for m in simhash.masks()]
    for i, a in enumerate(fps):
        for b in fps[:i]:
            if (a ^ b).bit_count() <= 2:
                assert any(a & m == b & m for m in keep)
    pivots = simhash.pivot_table(np.array(fps, np.uint64)).astype(int)
    far = np.abs(pivots[:, None] - pivots[None]).max(-1)
    assert all(far[i, j] <= 2 for i in range(len(fps)) for j in range(i) if (fps[i] ^ fps[j]).bit_count() <= 2)


def test_no_documents(spark):
    assert simhash.simhash_groups(docs(spark, [])).count() == 0 and simhash.one_of_each(docs(spark, [])).count() == 0


def test_long_chain_of_components(spark):
    n = 200
    edges = spark.createDataFrame([(i, i + 1) for i in range(n)] + [(900, 901), (905, 905)], "src long, dst long")
    assert {r.node: r.root for r in common.components(edges).collect()} == {i: 0 for i in range(n + 1)} | {900: 900, 901: 900}


# ---------------------------------------------------------------------------------------------- substrings


def brute_removal(rows):
    seen, out = {}, []
    for d, t in sorted(rows, key=lambda r: (r[0] is None, r[0])):
        words = (t or "").encode().split()
        gone = [False] * len(words)
        for s in range(len(words) - 19):
            if seen.setdefault(tuple(words[s : s + 20]), (d, s)) != (d, s):
                gone[s : s + 20] = [True] * 20
        kept = b" ".join(w for w, g in zip(words, gone) if not g)
        out.append((d, len(words), sum(gone), hashlib.sha256(kept).hexdigest(), kept.decode()))
    return out


def repetitive(n, seed=3):
    r = random.Random(seed)
    some = lambda k: " ".join(r.choice("abcdé,") + str(r.randrange(9)) for _ in range(k))
    passage = some(60)
    make = [lambda: some(80), lambda: f"{some(15)} {passage} {some(20)}", lambda: "the " * r.randrange(1, 300), lambda: passage, lambda: "x y z " * 50 + some(30), lambda: some(5), lambda: passage[:120] + some(40), lambda: ("ab " * 30 + some(25) + " ") * 2]
    rows = [(i * 2, make[i % 8]()) for i in range(n)]
    return rows + [(10_001, None), (10_003, ""), (10_005, rows[0][1]), (1, rows[3][1]), (10_007, "\t\n" + passage.replace(" ", "\x0b")), (None, passage), (10_009, "long " * 40_000)]


@pytest.mark.parametrize("shard", [2000, 3])
def test_removal(spark, monkeypatch, shard):
    monkeypatch.setattr(substrings, "SHARD", shard)
    rows = repetitive(160)
    found = substrings.remove_repeats(docs(spark, rows), texts=True)
    assert sorted(map(tuple, found.collect()), key=str) == sorted(brute_removal(rows), key=str)


@pytest.mark.parametrize("words, heavy", [(60, 4), (1 << 17, 2)])
def test_removal_with_small_shards_and_split_joins(spark, monkeypatch, words, heavy):
    """Shards bounded by words, and joins that split nearly every key, give the same rows."""
    monkeypatch.setattr(substrings, "SHARD_WORDS", words)
    monkeypatch.setattr(substrings, "EMIT", 7)
    monkeypatch.setattr(common, "HEAVY", heavy)
    rows = repetitive(90, seed=6)
    found = substrings.remove_repeats(docs(spark, rows), texts=True)
    assert sorted(map(tuple, found.collect()), key=str) == sorted(brute_removal(rows), key=str)


def test_removal_at_the_ends_of_ids(spark):
    """Ids at both ends of long stay; a null id counts as larger than the largest, and null rows are documents of their own."""
    text = " ".join(map(str, range(30)))
    other = " ".join(f"w{i}" for i in range(25))
    most, least = (1 << 63) - 1, -(1 << 63)
    rows = [(most, text), (least, "x " + text), (None, text + " y"), (None, other), (most, other), (None, None)]
    got = sorted(((r.doc_id, r.n_words, r.n_removed) for r in substrings.remove_repeats(docs(spark, rows)).collect()), key=str)
    assert got == sorted([(most, 30, 30), (least, 31, 0), (None, 31, 30), (None, 25, 25), (most, 25, 0), (None, 0, 0)], key=str)


def test_removal_of_repeated_rows_and_nothing(spark):
    text = " ".join(map(str, range(30)))
    rows = substrings.remove_repeats(docs(spark, [(1, text), (1, text), (2, text)])).collect()
    assert sorted((r.doc_id, r.n_removed) for r in rows) == [(1, 0), (1, 0), (2, 30)]
    assert substrings.remove_repeats(docs(spark, [])).count() == 0


def test_automaton_finds_longest_earlier_suffix():
    r = random.Random(7)
    text, automaton = [r.randrange(3) for _ in range(120)], substrings.SuffixAutomaton()
    for i, c in enumerate(text):
        before = [n for n in range(i + 2) if any(text[e - n : e] == text[i + 1 - n : i + 1] for e in range(n, i + 1))]
        assert automaton.add(c) == max(before, default=0)


# ---------------------------------------------------------------------------------------------- decontamination


def brute_hits(rows, items):
    import re

    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if c.isascii() else c for c in t or ""))
    windows: dict[tuple, set] = {}
    for i, t in items:
        w = words(t)
        n = min(10, len(w))
        for s in range(len(w) - n + 1 if w and i is not None else 0):
            windows.setdefault(tuple(w[s : s + n]), set()).add(str(i))
    out = []
    for d, t in rows:
        w, hit, found = words(t), set(), set()
        for n in {len(k) for k in windows}:
            for s in range(len(w) - n + 1):
                if own := windows.get(tuple(w[s : s + n])):
                    hit |= set(range(s, s + n))
                    found |= own
        out.append((d, len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit), sorted(found)))
    return out


ITEMS = [(1, "One two three four five six seven eight nine ten eleven"), (10, "short item"), (2, "Straße"), (3, None), (4, "!!"), (5, "a " * 40), (6, "two three four five six seven eight nine ten eleven twelve"), (None, "gone"), (7, "short item")]
TEXTS = [
    (1, "x ONE-two three, four five six seven eight nine ten. y"), (2, "one two three four five six seven eight nine"), (3, "a Short ITEM; short item straße"), (4, None), (5, ""), (6, "a " * 300), (7, "gone"),
    (8, "0 one two three four five six seven eight nine ten eleven twelve 1"), (9, "b " * 30_000 + "short item"), (9, "short item"), (None, "STRASSE straße STRAßE"),
]


@pytest.mark.parametrize("block", [1 << 20, 40])
def test_decontamination(spark, monkeypatch, block):
    monkeypatch.setattr(decontaminate, "BLOCK_BYTES", block)
    bench = spark.createDataFrame([(i, t, 1) for i, t in ITEMS], "item_id long, text string, doc_id int")
    found = decontaminate.decontaminate(docs(spark, TEXTS), bench)
    assert sorted(map(tuple, found.collect()), key=str) == sorted(brute_hits(TEXTS, ITEMS), key=str)
    clean = decontaminate.clean_documents(docs(spark, TEXTS), bench)
    assert sorted(r.doc_id for r in clean.collect()) == [2, 4, 5, 7]


def test_decontamination_by_join(spark, monkeypatch):
    """Many texts and items, with common passages, through the join of fingerprints and through the index."""
    r = random.Random(9)
    some = lambda n: " ".join(r.choice("abcdefgh") + str(r.randrange(4)) for _ in range(n))
    passage = some(14)
    items = [(i, r.choice([some(30), some(12) + " " + passage, some(3), passage, some(9)])) for i in range(30)]
    rows = [(i, some(40) + " " + r.choice([passage, passage[:30], r.choice(items)[1], r.choice(items)[1][5:60], ""]) + " " + some(5)) for i in range(150)] + [(None, passage), (None, "x"), (3, passage)]
    want = sorted(brute_hits(rows, items), key=str)
    bench = spark.createDataFrame(items, "item_id long, text string")
    assert sum(w[5] for w in want) > 40
    for block, heavy in ((1 << 20, 4096), (1, 4096), (1, 3)):
        monkeypatch.setattr(decontaminate, "BLOCK_BYTES", block)
        monkeypatch.setattr(common, "HEAVY", heavy)
        assert sorted(map(tuple, decontaminate.decontaminate(docs(spark, rows), bench).collect()), key=str) == want
        clean = decontaminate.clean_documents(docs(spark, rows), bench).collect()
        assert sorted((str(x.doc_id), x.text) for x in clean) == sorted((str(d), t) for (d, t), w in zip(rows, brute_hits(rows, items)) if not w[5])


def test_decontamination_without_items_or_documents(spark):
    none = spark.createDataFrame([], "item_id long, text string")
    assert not any(r.contaminated for r in decontaminate.decontaminate(docs(spark, TEXTS), none).collect())
    assert decontaminate.decontaminate(docs(spark, []), none).count() == 0


def test_winnowing_guarantee():
    """Any ten shared words share a fingerprint, wherever they stand."""
    r = random.Random(4)
    for _ in range(40):
        shared = " ".join(r.choice("abcdef") + str(r.randrange(6)) for _ in range(10)).encode()
        around = lambda: " ".join(str(r.randrange(99)) for _ in range(r.randrange(9))).encode()
        index = decontaminate.build_index([("i", around() + b" " + shared + b" " + around())])
        assert decontaminate.scan([around() + b" " + shared + b" " + around()], index)[1][0] >= 10


# ---------------------------------------------------------------------------------------------- shared helpers


def test_broadcast_by_bytes(spark):
    few = spark.range(10)
    wide = few.selectExpr("id", "repeat('é', 500) AS s", "array(id, id) AS a", "named_struct('t', repeat('z', 100)) AS n")
    size = wide.agg(common.F.sum(common.row_bytes(wide))).first()[0]
    assert 10 * 1100 < size < 10 * 1400
    assert common.is_small(wide, size) and not common.is_small(wide, size - 1) and common.is_small(few) and common.is_small(few.where("false"), 0)
    hinted = lambda df: "BroadcastHashJoin" in few.hint("merge").join(df, "id")._jdf.queryExecution().toString()
    assert hinted(common.broadcast_if_small(wide, size)) and not hinted(common.broadcast_if_small(wide, size - 1))
    for most in (1 << 20, 0):
        assert few.join(common.broadcast_if_small(few.where("id > 6"), most), "id").count() == 3


@pytest.mark.parametrize("heavy", [4096, 5, 1])
def test_spread_join(spark, monkeypatch, heavy):
    monkeypatch.setattr(common, "HEAVY", heavy)
    rows = [(("hot", "a", "b", None)[min(i % 7, 3)] if i % 7 else "hot", i) for i in range(300)]
    many = spark.createDataFrame(rows, "k string, i long")
    few = many.where("k IN ('hot', 'b')").groupBy("k").agg(common.F.count("*").alias("n")).withColumn("x", common.F.length("k"))
    got = common.spread_join(many, common.checkpointed(few), "k", 300, common.F.xxhash64("i"))
    assert sorted((r.k, r.i, r.x) for r in got.collect()) == sorted((k, i, len(k)) for k, i in rows if k in ("hot", "b"))


@pytest.mark.parametrize("parts", [1, 5])
def test_running_totals(spark, parts):
    r = random.Random(1)
    rows = [(r.randrange(50), i, r.randrange(9)) for i in range(200)]
    df = spark.createDataFrame(rows, "a long, i long, w long")
    got = common.running_totals(df, [common.F.col("a"), common.F.col("i")], {"before": common.F.col("w"), "place": common.F.lit(1).cast("bigint")}, parts)
    at, want = 0, []
    for n, (a, i, w) in enumerate(sorted(rows)):
        want.append((a, i, w, at, n))
        at += w
    assert sorted(map(tuple, got.collect())) == want
    assert common.running_totals(df.where("false"), [common.F.col("i")], {"before": common.F.col("w")}).count() == 0


def test_no_machine_local_folder_on_a_cluster():
    class Context:
        master = "spark://host:7077"
        getConf = staticmethod(dict)
        getCheckpointDir = staticmethod(lambda: None)

    class Session:
        sparkContext = Context
        conf = type("Conf", (), {"get": staticmethod(lambda k: "100")})

    with pytest.raises(ValueError, match="checkpoint"):
        common.shared_dir(Session)


def test_hashes_do_not_depend_on_the_strip(monkeypatch):
    texts = [b"a bb ccc " * 50, b"", b"x" * 5000 + b" yy", b"a bb"]
    want = common.Words(texts, common.NOT_SPACE).hashes()
    for n in (1, 7, 100):
        monkeypatch.setattr(common, "HASH_BYTES", n)
        w = common.Words(texts, common.NOT_SPACE)
        assert (w.hashes() == want).all()
    assert len(set(want.tolist())) == len({w.word(i) for i in range(len(w.start))})

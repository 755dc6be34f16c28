"""MinHash components against all pairs, at every way that a group's size may take, and components against a plain union."""

import random
import re

import pytest

from evidara.llm import common, grouping, minhash


def shingles(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {" ".join(w) for w in zip(words, words[1:])} if len(words) > 1 else set(map(str, words))


def brute(rows):
    sets = [shingles(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
                root[find(i)] = find(j)
    members = {}
    for i, (d, _) in enumerate(rows):
        members.setdefault(find(i), []).append(d)
    least = {r: min((d for d in m if d is not None), default=None) for r, m in members.items()}
    return sorted(((d, len(s), least[find(i)], d == least[find(i)]) for i, ((d, _), s) in enumerate(zip(rows, sets))), key=str)


def found(spark, rows):
    df = spark.createDataFrame([(d, t, 1, "x", 5) for d, t in rows], "doc_id long, text string, fp int, component_id string, size int")
    return sorted((tuple(r) for r in minhash.minhash_groups(df).collect()), key=str)


def copies(r, base, n, changes):
    out = []
    for _ in range(n):
        words = base.split()
        for _ in range(r.randrange(changes + 1)):
            words[r.randrange(len(words))] = f"w{r.randrange(10**6)}"
        out.append(" ".join(words))
    return out


@pytest.fixture(scope="module")
def rows():
    r = random.Random(7)
    vocabulary = [f"v{i}" for i in range(60)]
    prose = lambda n: " ".join(r.choice(vocabulary) for _ in range(n))
    texts = [t for n in (12, 60, 200) for base in [prose(n) for _ in range(6)] for t in copies(r, base, 9, max(1, n // 18))]
    passage = prose(80)
    texts += [f"{passage} {prose(40)}" for _ in range(20)]
    texts += [None, "", " \t\n", "One", "one", "ONE two", "one  two", "one two three", "É É", "é é", prose(4000), "a b " * 3000]
    texts += copies(r, prose(40), 60, 3) + [prose(10)] * 30
    out = list(enumerate(texts, 5))
    r.shuffle(out)
    return out + [(None, out[0][1]), (None, "quite alone here"), (out[3][0], out[3][1])]


def test_against_all_pairs(spark, rows):
    assert found(spark, rows) == brute(rows)


def test_small_parts(spark, rows, monkeypatch):
    """Buckets and groups are cut into chunks, visited, and joined without broadcasts."""
    monkeypatch.setattr(minhash, "BUCKET_BYTES", 1500)
    monkeypatch.setattr(minhash, "GROUP_BYTES", 6000)
    monkeypatch.setattr(common, "BROADCAST_BYTES", 1)
    assert found(spark, rows) == brute(rows)


def test_without_common_values(spark, rows, monkeypatch):
    monkeypatch.setattr(minhash, "COMMON", 1)
    assert found(spark, rows[:150]) == brute(rows[:150])


def test_no_rows_and_empty_ones(spark):
    assert found(spark, []) == []
    assert found(spark, [(2, None), (1, ""), (1, " ")]) == brute([(2, None), (1, ""), (1, " ")])


@pytest.mark.parametrize("most", [1 << 19, 20])
def test_components(spark, monkeypatch, most):
    monkeypatch.setattr(common, "TASK_EDGES", most)
    r = random.Random(3)
    edges = [(r.randrange(-400, 400), r.randrange(-400, 400)) for _ in range(300)] + [(i, i + 1) for i in range(1000, 1100)] + [(5000, i) for i in range(5001, 5200)] + [(9, 9), (2**62, -(2**62))]
    parent = {}
    find = lambda x: x if parent.setdefault(x, x) == x else find(parent[x])
    for a, b in edges:
        x, y = find(a), find(b)
        parent[max(x, y)] = min(x, y)
    want = {x: find(x) for e in edges if e[0] != e[1] for x in e}
    got = common.components(spark.createDataFrame(edges, "src long, dst long"))
    assert {r.node: r.root for r in got.collect()} == want
    assert got.count() == len(want)


def test_parts_of_any_batching():
    import pyarrow as pa

    t = pa.table({"part": [1, 1, 2, 3, 3, 3, 4], "x": list(range(7))})
    for n in (1, 2, 3, 7):
        assert [p.column("x").to_pylist() for p in grouping.parts_of(iter(t.to_batches(max_chunksize=n)))] == [[0, 1], [2], [3, 4, 5], [6]]

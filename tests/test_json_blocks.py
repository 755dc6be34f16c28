"""JSON files in byte ranges of every size against the whole file read at once."""

import io
import json
import random
import time

import pytest

from evidara.sources import json_blocks, records


def plain(text: str) -> list[dict]:
    return list(records.objects(io.StringIO(text), 1 << 30))


def found(spark, folder, text, block):
    path = folder / f"{time.monotonic_ns()}.json"
    path.write_bytes(text if isinstance(text, bytes) else text.encode())
    rows = json_blocks.read_objects(spark, f"file://{path}", block).collect()
    assert sorted(r.position for r in rows) == list(range(len(rows)))
    return [json.loads(r.record) for r in sorted(rows, key=lambda r: r.position)]


def made(n=25, seed=3):
    r = random.Random(seed)
    odd = ["plain", 'a "quote" {', "}{][", "back\\slash\\\\", "é你\U0001f600", "", "\\", '\\"', "x" * 90, "  \x7f"]
    return [{"i": i, r.choice(odd): r.choice(odd), "deep": {"a": [{"b": r.choice(odd)}, {}], "c": None}, "n": r.random()} for i in range(n)]


LAYOUTS = {
    "lines": lambda x: "\n".join(json.dumps(o, ensure_ascii=False) for o in x),
    "pretty": lambda x: json.dumps(x, indent=3, ensure_ascii=False),
    "one line": lambda x: json.dumps(x, separators=(",", ":")),
    "with others": lambda x: "[1, \"a{\", null, [true]]\n" + "\n, ".join(json.dumps(o) + ' 12 "}"' for o in x) + "\n-3.5e7",
}


@pytest.mark.parametrize("layout", LAYOUTS)
def test_ranges_of_any_size(spark, tmp_path, layout):
    text = LAYOUTS[layout](made())
    want = plain(text)
    assert want == made()
    for block in (37, 211, 1 << 20):
        assert found(spark, tmp_path, text, block) == want


def test_every_cut():
    """Without Spark: a small text cut at every two places."""
    text = ('[{"a\\\\": "{\\"}"}, 7, ' + json.dumps({"k": ["\\", {}, "}"]}) + ' {"z": {"y": 1}}]').encode()
    want = plain(text.decode())
    for a in range(1, len(text)):
        for b in range(a, len(text), 7):
            cuts = sorted({0, a, b, len(text)})
            ranges = [("f", x, y) for x, y in zip(cuts, cuts[1:])]
            run = lambda x: (len(text[:x]) - len(text[:x].rstrip(b"\\"))) % 2 == 1
            known = {("f", x): (run(x), *(json_blocks.summary([text[x:y]], json_blocks.State(s, s and run(x))) for s in (False, True))) for _, x, y in ranges}
            objects, parts = [], {}
            for _, x, y, in_string, escaped, depth, begun in json_blocks.placed(ranges, known):
                scan = json_blocks.Range(json_blocks.State(in_string, escaped, depth), x == 0)
                place = 0
                for kind, value, part in scan.feed(text[x:y]):
                    assert kind != json_blocks.FAULT
                    if kind == json_blocks.OBJECT:
                        objects.append((x, place, value))
                    else:
                        parts.setdefault(begun, []).append(part)
                    place += 1
                parts.setdefault(x if scan.synced else begun, []).append(scan.take(b""))
            for x, own in parts.items():
                kind, value = json_blocks.whole(b"".join(own))
                assert kind != json_blocks.FAULT, (a, b)
                if value is not None:
                    objects.append((x, 1 << 60, value))
            assert [v for *_, v in sorted(objects, key=lambda o: o[:2])] == want, (a, b)


@pytest.mark.parametrize("damage", ['{"a": }', "xyz", '{"a": "x}\n{', "}", '{"open": {"a": 1}', "{'a': 1}", "[}"])
def test_damage_ends_a_file(spark, tmp_path, damage):
    x = made(12)
    text = "\n".join(json.dumps(o) for o in x[:7]) + f"\n{damage}\n" + "\n".join(json.dumps(o) for o in x[7:])
    assert plain(text) == x[:7]
    for block in (50, 333, 1 << 20):
        assert found(spark, tmp_path, text, block) == x[:7]


def test_damage_costs_no_more(spark, tmp_path):
    """A fault at the beginning of 30 MB: one pass, no second reading of what follows."""
    line = json.dumps({"text": "word " * 200}) + "\n"
    began = time.monotonic()
    assert found(spark, tmp_path, '{"a": }\n' + line * 30_000, 4 << 20) == []
    assert time.monotonic() - began < 40


def test_empty_and_several_files(spark, tmp_path):
    assert found(spark, tmp_path, "", 10) == [] == found(spark, tmp_path, " \n[]", 2)
    for n in range(3):
        (tmp_path / f"part-{n}.json").write_text(json.dumps([{"n": n, "i": i} for i in range(n)]))
    rows = json_blocks.read_objects(spark, f"file://{tmp_path}/part-*.json", 9).collect()
    assert sorted((json.loads(r.record)["n"], r.position) for r in rows) == [(1, 0), (2, 0), (2, 1)]
    assert json_blocks.read_objects(spark, f"file://{tmp_path}/none-*.json").count() == 0


def test_records(spark, tmp_path):
    (tmp_path / "all.json").write_text(LAYOUTS["pretty"](made(9)))
    path = f"file://{tmp_path}/all.json"
    one = {r.position: {k: v if v is None or v[:1] not in "{[" else json.loads(v) for k, v in r.record.items()} for r in records.read_records(spark, path).collect()}
    other = {r.position: {k: v if v is None or v[:1] not in "{[" else json.loads(v) for k, v in r.record.items()} for r in records.read_large_records(spark, path, 64).collect()}
    assert one == other and len(one) == 9


def test_small_ranges_share_tasks(spark, tmp_path, monkeypatch):
    """Ranges are as small as they are asked for; tasks are as many as their bytes need."""
    text = LAYOUTS["lines"](made(400))
    monkeypatch.setattr(json_blocks, "TASK_BYTES", 1 << 20)
    (tmp_path / "x.json").write_text(text)
    written = []
    keep = json_blocks.stored
    monkeypatch.setattr(json_blocks, "stored", lambda df, name: written.append(df.rdd.getNumPartitions()) or keep(df, name))
    rows = json_blocks.read_objects(spark, f"file://{tmp_path}/x.json", 50).collect()
    assert [json.loads(r.record) for r in sorted(rows, key=lambda r: r.position)] == made(400)
    assert len(text) // 50 > 400 and written[0] == 4 * spark.sparkContext.defaultParallelism

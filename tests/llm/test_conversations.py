"""Conversation repair against a search of all edits, in segments of any size, with the odd cases."""

import hashlib
import heapq
import random
import zlib

import pytest
from oracle import assert_same

from evidara.llm import conversations as repair

SPACE = " \t\n\x0b\x0c\r"
ROWS = "conv_id long, turn long, role string, text string, blank string, part int"


def cheapest(rows):
    """(cost, audit, turns) of the least way through all edits of (role, text, fault), by (cost, audit) from the queue."""
    step = {("", "s"): "s", ("", "u"): "u", ("s", "u"): "u", ("a", "u"): "u", ("u", "a"): "a"}
    queue, done = [(0, "", 0, "", ())], []
    seen = {}
    while queue:
        cost, audit, i, state, turns = heapq.heappop(queue)
        if seen.get((i, state), (cost, audit)) < (cost, audit):
            continue
        seen[i, state] = (cost, audit)
        if i == len(rows) and state in ("", "a"):
            done.append((cost, audit, turns))
        if done and cost > done[0][0]:
            break
        for role in ("user", "assistant"):
            if (state, role[0]) in step:
                heapq.heappush(queue, (cost + 5, audit + "I", i, role[0], (*turns, (role, ""))))
        if i < len(rows):
            role, text, fault = rows[i]
            heapq.heappush(queue, (cost + 2, audit + "D", i + 1, state, turns))
            if fault not in ("blank", "duplicate"):
                cut = 5 * (fault == "truncated")
                if (state, role[:1]) in step:
                    heapq.heappush(queue, (cost + cut, audit + "K", i + 1, step[state, role[:1]], (*turns, (role, text))))
                for other in ("user", "assistant"):
                    if (state, other[0]) in step:
                        heapq.heappush(queue, (cost + 1 + cut, audit + "R", i + 1, other[0], (*turns, (other, text))))
    return min(done)


def brute(rows):
    """The query's row of each conversation of undamaged rows (conv_id, turn, role, text)."""
    out = []
    for conv in {r[0] for r in rows}:
        after = []
        for c, turn, role, text in (r for r in rows if r[0] == conv):
            code = zlib.crc32(f"{' ' if c is None else c}:{' ' if turn is None else turn}".encode()) % 20
            role, text = " " if role is None else role, " " if text is None else text
            if code == 1:
                text = ""
            if code == 2:
                text = "".join(ch for ch in text if ch not in ".!?")
            if code == 4:
                role = "user"
            after += [(turn, role, text)] * (0 if code == 0 else 2 if code == 3 else 1)
        after.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2].encode()))
        seen, judged, counts = set(), [], dict(blank=0, duplicate=0, truncated=0)
        for _, role, text in after:
            bare = text.strip(SPACE)
            fault = "blank" if not bare else "duplicate" if (role, text) in seen else "truncated" if bare[-1] not in ".!?" else None
            seen.add((role, text))
            counts.update({fault: counts[fault] + 1} if fault else {})
            judged.append((role, text, fault))
        named = {t for t, _, _ in after if t is not None}
        cost, audit, turns = cheapest(judged)
        illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(after, after[1:]))
        lines = "\n".join(f"{r}:{t}" for r, t in turns)
        out.append((conv, max(named) - min(named) + 1 - len(named) if named else 0, *counts.values(), illegal, cost, audit, hashlib.sha256(lines.encode()).hexdigest()))
    return sorted(out, key=str)


def made(n, longest, seed):
    r, out = random.Random(seed), []
    for conv in [*range(n), None]:
        for _ in range(r.randrange(longest)):
            turn = r.choice([None, *range(12)]) if r.random() < 0.3 else len(out) % 9
            out.append((conv, turn, r.choice(["user", "assistant", "system", "user", "assistant", "tool", "", None]), r.choice(["Yes.", "Yes.", "No", "Ha! ", "", " \t", None, "é?", "e.\n", "\u00a0", f"t{len(out)}."])))
    return out


def found(spark, rows, **how):
    df = spark.createDataFrame([(*r, "x", 3) for r in rows], ROWS)
    return sorted((tuple(r) for r in repair.repair_report(df, **how).collect()), key=str)


@pytest.mark.parametrize("most, most_bytes", [(1000, 1 << 20), (4, 1 << 20), (1, 1), (1000, 12)])
def test_against_all_edits(spark, most, most_bytes):
    rows = made(60, 14, 1)
    assert found(spark, rows, most=most, most_bytes=most_bytes) == brute(rows)


def test_one_long_conversation(spark):
    """Half of all rows are of one conversation, many of them equal."""
    r = random.Random(2)
    rows = [(7, r.choice([None, 3, i]), r.choice(["user", "assistant", "system"]), r.choice(["Same.", "Same", "", f"Turn {i}."])) for i in range(400)] + made(40, 9, 3)
    assert found(spark, rows, most=30) == brute(rows) == found(spark, rows)


def test_turns_are_given(spark):
    df = spark.createDataFrame([(1, 0, "user", "Hi."), (1, 1, "user", "Why?"), (1, 2, "assistant", "So."), (2, 0, "assistant", "cut")], "conv_id long, turn long, role string, text string")
    got = {r.conv_id: (r.cost, r.audit, [(t.role, t.text) for t in r.repaired]) for r in repair.repair(df).collect()}
    assert got == {1: (2, "DKK", [("user", "Why?"), ("assistant", "So.")]), 2: (2, "D", [])}


def test_no_rows_or_none_left(spark):
    assert found(spark, []) == []
    lost = next(i for i in range(10**4) if zlib.crc32(f"{i}:0".encode()) % 20 == 0)
    assert found(spark, [(lost, 0, "user", "Gone.")]) == [(lost, 0, 0, 0, 0, 0, 0, "", hashlib.sha256().hexdigest())]


def test_sql_on_odd_rows(spark):
    import duckdb
    import pandas as pd

    rows = made(50, 10, 5)
    c = duckdb.connect()
    frame = pd.DataFrame(rows, columns=["conv_id", "turn", "role", "text"]).astype({"conv_id": "Int64", "turn": "Int64"})
    c.register("conversations", frame)
    df = spark.createDataFrame([(*r, "x", 3) for r in rows], ROWS)
    assert assert_same(repair.repair_report(df), c, repair.ORACLE) == len({r[0] for r in rows})

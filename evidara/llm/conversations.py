"""Conversation structure repair: the cheapest edits that make the roles of a conversation read (s?(ua)+)? or nothing.

Rows of a conversation are taken by turn (nulls first), then role and text, so equal rows are neighbours and may change places.
A row is blank (no character beyond ASCII white space), else a duplicate (role and text of an earlier row), else truncated (its
last such character is none of . ! ?). Edits: Keep (0), Rerole to user or assistant (1), Delete (2; the only edit of blank and
duplicate rows), Insert an empty turn of user or assistant (5); a truncated row that is not deleted costs 5 more. Roles count by
their first character.

A forward Viterbi pass carries, for each of the four states of the grammar, the least (cost, audit string): after each row its
layer is closed by inserts, at most two, as a third would come back to a state. Two audits of one layer and cost are never
prefixes of each other (a prefix would lack inserts, and so cost less), so the least whole string is found from least prefixes.

Conversations of up to SEGMENT rows and SEGMENT_BYTES are grouped by one shuffle and held by a task one at a time. Longer ones
are dealt by ranges of (conversation, turn, role, text) and cut into segments; each segment gives the 4 x 4 table of least
(cost, audit) from state to state, these compose along the conversation, and the segments, with the state they begin in, are
then repaired where they are. Equal rows of a long conversation travel as one row with a count. What one task sees of a long
conversation is its audits and, for the digest of its repaired text, that text streamed segment by segment; both are columns
of one result row.

Nulls in role and text read as one space; a null conv_id is a conversation of its own; null turns come first and leave no gap.
Repeated rows are duplicates. An empty table gives no rows. Very long texts are held one segment at a time. Other columns are
not read. Bytes that are not UTF-8 read as U+FFFD.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import partial

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import broadcast_if_small, checkpointed, materialize, spread_join

SEGMENT, SEGMENT_BYTES = 1000, 4 << 20
SPACE = " \t\n\v\f\r"
BLANK, DUPLICATE, TRUNCATED = "blank", "duplicate", "truncated"
#: The four states of the grammar: nothing yet, after s, after u, after a; which one each initial leads to.
NOTHING, SYSTEM, USER, ASSISTANT = range(4)
STEP = {(NOTHING, "s"): SYSTEM, (NOTHING, "u"): USER, (SYSTEM, "u"): USER, (ASSISTANT, "u"): USER, (USER, "a"): ASSISTANT}
DELETE, INSERT, REROLE, CUT = 2, 5, 1, 5
LEGAL = {"su", "ua", "au"}

#: State: the least (cost, audit) that leads there, if any.
Layer = list[tuple[int, str] | None]


def missing(state: int) -> int:
    """The state that the next turn of the dialogue, inserted or reroled, leads to."""
    return ASSISTANT if state == USER else USER


def offer(layer: Layer, state: int, cost: int, audit: str) -> bool:
    old = layer[state]
    if old is None or (cost, audit) < old:
        layer[state] = (cost, audit)
        return True
    return False


def closed(layer: Layer) -> Layer:
    """The layer with what up to two inserts reach."""
    for _ in range(2):
        changed = False
        for state, best in enumerate(list(layer)):
            if best is not None:
                changed |= offer(layer, missing(state), best[0] + INSERT, best[1] + "I")
        if not changed:
            break
    return layer


def after(layer: Layer, initial: str, fault: str | None, copies: int = 1) -> Layer:
    """The layer after a row, and after copies - 1 duplicates of it; inserts among deletes are never least before the last."""
    out: Layer = [None] * 4
    gone = copies if fault in (BLANK, DUPLICATE) else copies - 1
    if gone < copies:
        extra = CUT if fault == TRUNCATED else 0
        for state, best in enumerate(layer):
            if best is None:
                continue
            cost, audit = best
            offer(out, state, cost + DELETE, audit + "D")
            if (state, initial) in STEP:
                offer(out, STEP[state, initial], cost + extra, audit + "K")
            offer(out, missing(state), cost + REROLE + extra, audit + "R")
        layer = closed(out)
        out = [None] * 4
    if gone:
        out = [b and (b[0] + DELETE * gone, b[1] + "D" * gone) for b in layer]
        return closed(out)
    return layer


def start() -> Layer:
    return closed([(0, ""), None, None, None])


def best_end(layer: Layer) -> tuple[int, str, int]:
    """Cost, audit and state of the least accepted end."""
    return min((*layer[s], s) for s in (NOTHING, ASSISTANT) if layer[s] is not None)


def repaired(roles: list[str], texts: list[str], copies: list[int], audit: str, state: int = NOTHING) -> list[dict[str, str]]:
    """The turns that the audit leaves of the rows, beginning in a state."""
    names, out, row, left = {USER: "user", ASSISTANT: "assistant"}, [], 0, copies[0] if copies else 0
    for edit in audit:
        if edit == "I":
            state = missing(state)
            out.append({"role": names[state], "text": ""})
            continue
        if edit == "K":
            state = STEP[state, roles[row][:1]]
            out.append({"role": roles[row], "text": texts[row]})
        elif edit == "R":
            state = missing(state)
            out.append({"role": names[state], "text": texts[row]})
        left -= 1
        if not left:
            row += 1
            left = copies[row] if row < len(copies) else 0
    return out


def fault_of(text: str) -> str | None:
    """Blank or truncated, by the text alone."""
    bare = text.rstrip(SPACE)
    return BLANK if not bare else None if bare[-1] in ".!?" else TRUNCATED


# ---------------------------------------------------------------------------------------------- short conversations

REPORT = "gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string"
TURNS = "repaired array<struct<role:string,text:string>>"
PIECE = f"conv_id long, piece long, {REPORT}, {TURNS}"


def report(turns: list[int | None], roles: list[str], texts: list[str]) -> dict:
    """The repair of one conversation in order."""
    seen, counts, layer = set(), dict.fromkeys((BLANK, DUPLICATE, TRUNCATED), 0), start()
    for role, text in zip(roles, texts):
        fault = fault_of(text)
        if fault != BLANK:
            if (role, text) in seen:
                fault = DUPLICATE
            seen.add((role, text))
        if fault:
            counts[fault] += 1
        layer = after(layer, role[:1], fault)
    cost, audit, _ = best_end(layer)
    named = {t for t in turns if t is not None}
    return {
        "gaps": max(named) - min(named) + 1 - len(named) if named else 0, **counts,
        "illegal": sum(a[:1] + b[:1] not in LEGAL for a, b in zip(roles, roles[1:])), "cost": cost, "audit": audit,
        "repaired": repaired(roles, texts, [1] * len(roles), audit),
    }


def repair_short(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Reports of conversations whose rows (conv_id, turn, role, text) come together and in order."""
    schema = pa.schema([("conv_id", pa.int64()), ("piece", pa.int64()), *((n, pa.int64()) for n in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")), ("audit", pa.string()), ("repaired", pa.list_(pa.struct([("role", pa.string()), ("text", pa.string())])))])
    conv, rows, out = None, [], []

    def done() -> dict:
        turns, roles, texts = zip(*rows)
        return {"conv_id": conv, "piece": 0, **report(list(turns), list(roles), list(texts))}

    for b in batches:
        for c, *row in zip(*(b.column(i).to_pylist() for i in range(4))):
            if rows and c != conv:
                out.append(done())
                rows = []
            conv = c
            rows.append(row)
        if out:
            yield pa.RecordBatch.from_pylist(out, schema)
            out = []
    if rows:
        yield pa.RecordBatch.from_pylist([done()], schema)


# ---------------------------------------------------------------------------------------------- long conversations

#: Counts of a segment and of a conversation, in this order.
FAULTS = ("illegal", BLANK, DUPLICATE, TRUNCATED)
SEGMENTS = "conv_id long, part long, number long, first string, last string, illegal long, blank long, duplicate long, truncated long, costs array<long>, audits array<string>, roles array<string>, texts array<string>, copies array<long>"


def cut_segments(batches: Iterator[pa.RecordBatch], most: int, most_bytes: int) -> Iterator[pa.RecordBatch]:
    """Segments of rows (conv_id, part, turn, role, text, copies, fault) in order, with their tables of least (cost, audit)."""
    fields = [("conv_id", pa.int64()), ("part", pa.int64()), ("number", pa.int64()), ("first", pa.string()), ("last", pa.string()), *((n, pa.int64()) for n in FAULTS)]
    lists = [("costs", pa.int64()), ("audits", pa.string()), ("roles", pa.string()), ("texts", pa.string()), ("copies", pa.int64())]
    schema = pa.schema([*fields, *((n, pa.list_(k)) for n, k in lists)])
    held, size, number, key = [], 0, 0, None

    def done() -> pa.RecordBatch:
        nonlocal number
        roles, texts, copies, faults = (list(c) for c in zip(*held))
        costs, audits = [], []
        for state in range(4):
            layer: Layer = [None] * 4
            layer[state] = (0, "")
            for role, fault, n in zip(roles, faults, copies):
                layer = after(layer, role[:1], fault, n)
            costs += [b and b[0] for b in layer]
            audits += [b and b[1] for b in layer]
        illegal = sum(a[:1] + b[:1] not in LEGAL for a, b in zip(roles, roles[1:])) + sum((n - 1) for r, n in zip(roles, copies) if 2 * r[:1] not in LEGAL)
        row = {
            "conv_id": key[0], "part": key[1], "number": number, "first": roles[0][:1], "last": roles[-1][:1], "illegal": illegal,
            "blank": sum(n for f, n in zip(faults, copies) if f == BLANK), "duplicate": sum(n - (f != DUPLICATE) for f, n in zip(faults, copies) if f != BLANK), "truncated": faults.count(TRUNCATED),
            "costs": costs, "audits": audits, "roles": roles, "texts": texts, "copies": copies,
        }
        number += 1
        held.clear()
        return pa.RecordBatch.from_pylist([row], schema)

    for b in batches:
        for conv, part, _, role, text, copies, fault in zip(*(b.column(i).to_pylist() for i in range(7))):
            if held and ((conv, part) != key or len(held) >= most or size >= most_bytes):
                yield done()
            if not held:
                key, size = (conv, part), 0
            held.append((role, text, copies, fault))
            size += len(text)
    if held:
        yield done()


def chain(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Along each conversation's segments (conv_id, part, number, first, last, FAULTS, costs, audits), in order: for each its first
    state and audit, and a row of the whole with part null."""
    schema = pa.schema([("conv_id", pa.int64()), ("part", pa.int64()), ("number", pa.int64()), ("state", pa.int64()), ("cost", pa.int64()), ("audit", pa.string()), *((n, pa.int64()) for n in FAULTS)])
    conv, layer, steps, last, sums = None, None, [], None, [0] * 4

    def done() -> pa.RecordBatch:
        cost, audit, state = best_end(layer)
        out = [{"conv_id": conv, "cost": cost, "audit": audit, **dict(zip(FAULTS, sums))}]
        # The first segment's audits begin with the inserts before all rows, so it begins in the first state.
        for part, number, came in reversed(steps):
            before, piece = came[state]
            out.append({"conv_id": conv, "part": part, "number": number, "state": before, "audit": piece})
            state = before
        return pa.RecordBatch.from_pylist(out, schema)

    for b in batches:
        for c, part, number, first, end, *own, costs, audits in zip(*(b.column(i).to_pylist() for i in range(11))):
            if layer is not None and c != conv:
                yield done()
                layer = None
            opening = layer is None
            if opening:
                conv, layer, steps, last, sums = c, start(), [], None, [0] * 4
            sums = [a + b for a, b in zip(sums, own)]
            sums[0] += last is not None and last + first not in LEGAL
            last = end
            moved: Layer = [None] * 4
            came: list[tuple[int, str] | None] = [None] * 4
            for p, best in enumerate(layer):
                for q in range(4):
                    if best is not None and costs[4 * p + q] is not None and offer(moved, q, best[0] + costs[4 * p + q], best[1] + audits[4 * p + q]):
                        came[q] = (NOTHING, best[1] + audits[4 * p + q]) if opening else (p, audits[4 * p + q])
            layer = moved
            steps.append((part, number, came))
    if layer is not None:
        yield done()


def repair_segments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(conv_id, piece, repaired) of segments (conv_id, piece, state, audit, roles, texts, copies)."""
    schema = pa.schema([("conv_id", pa.int64()), ("piece", pa.int64()), ("repaired", pa.list_(pa.struct([("role", pa.string()), ("text", pa.string())])))])
    for b in batches:
        for i in range(b.num_rows):
            conv, piece, state, audit, roles, texts, copies = (b.column(k)[i].as_py() for k in range(7))
            yield pa.RecordBatch.from_pylist([{"conv_id": conv, "piece": piece, "repaired": repaired(roles, texts, copies, audit, state)}], schema)


def turn_order(turn: Column) -> Column:
    """Orders turns with nulls first, as a value that a minimum may be taken of."""
    return F.struct(turn.isNotNull().alias("named"), turn.alias("turn"))


def repair_long(rows: DataFrame, most: int, most_bytes: int) -> DataFrame:
    """Pieces of conversations of any length; see repair."""
    once = rows.groupBy("conv_id", "turn", "role", "text").agg(F.count("*").alias("copies"))
    name = F.concat_ws(":", F.coalesce(F.col("conv_id").cast("string"), F.lit("")), F.octet_length("role"), F.col("role"), F.col("text"))
    once = materialize(once.withColumn("name", F.md5(name.cast("binary"))), "long-turns")
    first = once.groupBy("name").agg(F.count("*").alias("n"), F.min(turn_order(F.col("turn"))).alias("first"))
    total = once.count()
    bare = F.rtrim(F.col("text"), F.lit(SPACE))
    fault = F.when(bare == "", BLANK).when(turn_order(F.col("turn")) != F.col("first"), DUPLICATE).when(~bare.substr(F.lit(-1), F.lit(1)).isin(".", "!", "?"), TRUNCATED)
    marked = spread_join(once, checkpointed(first), "name", total, F.xxhash64("turn")).withColumn("fault", fault)
    order = [F.col("conv_id"), F.col("turn").asc_nulls_first(), F.col("role"), F.col("text")]
    # Ranges by the first characters of texts, so that whole ones do not go to the driver; order within them is by all.
    ranges = [F.col("conv_id"), F.col("turn").asc_nulls_first(), F.col("role"), F.substring("text", 1, 64)]
    dealt = marked.repartitionByRange(max(1, -(-total // most)), *ranges).withColumn("part", F.spark_partition_id().cast("bigint")).sortWithinPartitions(*order)
    cut = dealt.select("conv_id", "part", "turn", "role", "text", "copies", "fault").mapInArrow(partial(cut_segments, most=most, most_bytes=most_bytes), SEGMENTS)
    cut = materialize(cut, "long-segments")
    tables = cut.select("conv_id", "part", "number", "first", "last", *FAULTS, "costs", "audits").repartition("conv_id").sortWithinPartitions("conv_id", "part", "number")
    chained = materialize(tables.mapInArrow(chain, "conv_id long, part long, number long, state long, cost long, audit string, illegal long, blank long, duplicate long, truncated long"), "long-audits")
    piece = F.shiftleft("part", 32) + F.col("number") + 1
    chosen = chained.where("part IS NOT NULL").select("part", "number", "state", "audit")
    turns = cut.join(chosen, ["part", "number"]).select("conv_id", piece.alias("piece"), "state", "audit", "roles", "texts", "copies").mapInArrow(repair_segments, f"conv_id long, piece long, {TURNS}")
    span = F.coalesce(F.max("turn") - F.min("turn") + 1 - F.count_distinct("turn"), F.lit(0)).cast("bigint")
    gaps = once.groupBy("conv_id").agg(span.alias("gaps"))
    ends = chained.where("part IS NULL")
    whole = ends.join(gaps, ends["conv_id"].eqNullSafe(gaps["conv_id"])).drop(gaps["conv_id"])
    nothing = F.lit(None)
    reports = whole.select("conv_id", F.lit(-1).cast("bigint").alias("piece"), "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", nothing.cast("array<struct<role:string,text:string>>").alias("repaired"))
    pieces = turns.select("conv_id", "piece", *(nothing.cast("bigint").alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")), nothing.cast("string").alias("audit"), "repaired")
    return reports.union(pieces)


def repair(conversations: DataFrame, most: int = SEGMENT, most_bytes: int = SEGMENT_BYTES) -> DataFrame:
    """Repaired conversations in pieces: conv_id, piece, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired.

    A conversation of up to `most` rows and `most_bytes` of text is one row, piece 0. A longer one is a row with its report, piece
    -1 and repaired null, and rows with pieces of its turns in ascending order of piece, the other columns null.
    """
    space = lambda c: F.coalesce(F.make_valid_utf8(F.col(c).cast("string")), F.lit(" ")).alias(c)
    rows = conversations.select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), space("role"), space("text"))
    sizes = rows.groupBy("conv_id").agg(F.count("*").alias("n"), F.sum(F.octet_length("text")).alias("size"))
    long = checkpointed(sizes.where((F.col("n") > most) | (F.col("size") > most_bytes)).select(F.col("conv_id").alias("long_id")))
    some = long.count()
    order = [F.col("conv_id"), F.col("turn").asc_nulls_first(), F.col("role"), F.col("text")]
    listed = broadcast_if_small(long) if some else long
    is_long = rows["conv_id"].eqNullSafe(listed["long_id"])
    short = rows.join(listed, is_long, "left_anti") if some else rows
    out = short.repartition("conv_id").sortWithinPartitions(*order).mapInArrow(repair_short, PIECE)
    return out.union(repair_long(rows.join(listed, is_long, "left_semi"), most, most_bytes)) if some else out


def digests(pieces: DataFrame) -> DataFrame:
    """(conv_id, digest) of the repaired role:text lines of conversations in several pieces; texts are streamed, one piece at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conv, sha, lines = None, None, False
        done = lambda: pa.RecordBatch.from_pydict({"conv_id": pa.array([conv], pa.int64()), "digest": [sha.hexdigest()]})
        for b in batches:
            for i in range(b.num_rows):
                c, block = b.column(0)[i].as_py(), b.column(2)[i].as_py()
                if sha is not None and c != conv:
                    yield done()
                    sha = None
                if sha is None:
                    conv, sha, lines = c, hashlib.sha256(), False
                if block is not None:
                    sha.update(b"\n" + block if lines else block)
                    lines = True
        if sha is not None:
            yield done()

    blocks = pieces.select("conv_id", "piece", F.when(F.size("repaired") > 0, lines_of(F.col("repaired")).cast("binary")).alias("block"))
    return blocks.repartition("conv_id").sortWithinPartitions("conv_id", "piece").mapInArrow(run, "conv_id long, digest string")


def lines_of(turns: Column) -> Column:
    return F.array_join(F.transform(turns, lambda t: F.concat(t["role"], F.lit(":"), t["text"])), "\n")


# ---------------------------------------------------------------------------------------------- the query


def damaged(conversations: DataFrame) -> DataFrame:
    """Rows as crc32 of conv_id:turn, modulo 20, says: 0 drops, 1 empties, 2 takes the ends of sentences, 3 repeats, 4 makes user."""
    space = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    code = F.pmod(F.crc32(F.concat(space("conv_id"), F.lit(":"), space("turn")).cast("binary")), F.lit(20))
    role = F.when(code == 4, "user").otherwise(space("role"))
    text = F.when(code == 1, "").when(code == 2, F.regexp_replace(space("text"), "[.!?]", "")).otherwise(space("text"))
    times = F.explode(F.when(code == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))
    rows = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), role.alias("role"), text.alias("text"), code.alias("code"))
    return rows.where("code <> 0").select("conv_id", "turn", "role", "text", times.alias("time")).drop("time")


def repair_report(conversations: DataFrame, most: int = SEGMENT, most_bytes: int = SEGMENT_BYTES) -> DataFrame:
    """A row for every conv_id: what damage left of it, the cheapest repair, and a digest of its repaired turns."""
    found = repair(damaged(conversations), most, most_bytes)
    found = materialize(found.withColumn("digest", F.sha2(lines_of(F.col("repaired")).cast("binary"), 256)).withColumn("repaired", F.when(F.col("piece") != 0, F.col("repaired"))), "repaired")
    short = found.where("piece = 0").drop("piece", "repaired")
    reports = found.where("piece = -1").drop("piece", "repaired", "digest")
    streamed = digests(found.where("piece <> 0 AND repaired IS NOT NULL"))
    long = reports.join(streamed, reports["conv_id"].eqNullSafe(streamed["conv_id"])).drop(streamed["conv_id"])
    every = conversations.select(F.col("conv_id").cast("long").alias("conv_id")).distinct()
    rows = short.unionByName(long)
    both = every.join(rows, every["conv_id"].eqNullSafe(rows["conv_id"]), "left").drop(rows["conv_id"])
    zero = [F.coalesce(c, F.lit(0)).cast("bigint").alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    return both.select("conv_id", *zero, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("digest", F.lit(hashlib.sha256().hexdigest())).alias("repaired_sha256"))


ORACLE = r"""
WITH RECURSIVE poly AS (SELECT list(list_reduce(range(0, 8), lambda c, i: CASE WHEN c % 2 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, b::BIGINT) ORDER BY b) AS t FROM range(0, 256) r(b)),
coded AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, xor(4294967295::BIGINT, list_reduce(
            list_transform(string_split(coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' '), ''), lambda x: ord(x)::BIGINT),
            lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1]), 4294967295::BIGINT)) % 20 AS code FROM conversations, poly),
rows AS (SELECT conv_id, turn, CASE code WHEN 4 THEN 'user' ELSE role END AS role,
                CASE code WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text
         FROM coded, (SELECT unnest([0, 1]) AS copy) WHERE code <> 0 AND (copy = 0 OR code = 3)),
placed AS (SELECT *, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY pos) AS nth,
                  rtrim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS bare, left(role, 1) AS i
           FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS pos FROM rows)),
faulty AS (SELECT *, CASE WHEN bare = '' THEN 1 WHEN nth > 1 THEN 2 WHEN right(bare, 1) NOT IN ('.', '!', '?') THEN 3 ELSE 0 END AS fault,
                  lag(i) OVER (PARTITION BY conv_id ORDER BY pos) || i AS pair FROM placed),
counts AS (SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 1) AS blank, count(*) FILTER (fault = 2) AS duplicate,
                  count(*) FILTER (fault = 3) AS truncated, count(*) FILTER (pair NOT IN ('su', 'ua', 'au')) AS illegal, max(pos) AS n FROM faulty GROUP BY conv_id),
-- The least cost (9 digits) and audit of each state: 0 nothing, 1 after s, 2 after u, 3 after a.
layer AS (
  SELECT conv_id, 0::BIGINT AS pos, '000000000' AS s0, NULL::VARCHAR AS s1, '000000005I' AS s2, '000000010II' AS s3 FROM counts
  UNION ALL
  SELECT conv_id, pos, n0, n1, m2, least(n3, printf('%09d', left(m2, 9)::INT + 5) || substr(m2, 10) || 'I') FROM (
    SELECT conv_id, pos, n0, n1, n3, least(n2, printf('%09d', left(n0, 9)::INT + 5) || substr(n0, 10) || 'I', printf('%09d', left(n1, 9)::INT + 5) || substr(n1, 10) || 'I',
                                           printf('%09d', left(n3, 9)::INT + 5) || substr(n3, 10) || 'I') AS m2 FROM (
      SELECT l.conv_id, r.pos,
        printf('%09d', left(s0, 9)::INT + 2) || substr(s0, 10) || 'D' AS n0,
        least(printf('%09d', left(s1, 9)::INT + 2) || substr(s1, 10) || 'D', CASE WHEN ok AND i = 's' THEN printf('%09d', left(s0, 9)::INT + cut) || substr(s0, 10) || 'K' END) AS n1,
        least(printf('%09d', left(s2, 9)::INT + 2) || substr(s2, 10) || 'D',
              CASE WHEN ok THEN least(printf('%09d', left(s0, 9)::INT + cut + keep_u) || substr(s0, 10) || letter_u, printf('%09d', left(s1, 9)::INT + cut + keep_u) || substr(s1, 10) || letter_u,
                                      printf('%09d', left(s3, 9)::INT + cut + keep_u) || substr(s3, 10) || letter_u) END) AS n2,
        least(printf('%09d', left(s3, 9)::INT + 2) || substr(s3, 10) || 'D', CASE WHEN ok THEN printf('%09d', left(s2, 9)::INT + cut + keep_a) || substr(s2, 10) || letter_a END) AS n3
      FROM layer l JOIN (SELECT *, fault NOT IN (1, 2) AS ok, CASE fault WHEN 3 THEN 5 ELSE 0 END AS cut, CASE i WHEN 'u' THEN 0 ELSE 1 END AS keep_u, CASE i WHEN 'u' THEN 'K' ELSE 'R' END AS letter_u,
                                CASE i WHEN 'a' THEN 0 ELSE 1 END AS keep_a, CASE i WHEN 'a' THEN 'K' ELSE 'R' END AS letter_a FROM faulty) r
        ON l.conv_id IS NOT DISTINCT FROM r.conv_id AND r.pos = l.pos + 1))),
ends AS (SELECT c.*, least(s0, s3) AS best FROM counts c JOIN layer l ON c.conv_id IS NOT DISTINCT FROM l.conv_id AND l.pos = c.n),
edits AS (SELECT conv_id, k, substr(substr(best, 10), k, 1) AS e FROM (SELECT conv_id, best, unnest(range(1, length(best) - 8)) AS k FROM ends)),
numbered AS (SELECT *, sum(CASE e WHEN 'I' THEN 0 ELSE 1 END) OVER (PARTITION BY conv_id ORDER BY k) AS pos FROM edits),
turns AS (SELECT n.conv_id, k, e, r.role, r.text, CASE e WHEN 'K' THEN r.i END AS i FROM numbered n LEFT JOIN faulty r ON n.conv_id IS NOT DISTINCT FROM r.conv_id AND n.pos = r.pos WHERE e <> 'D'),
-- After an s, or first without one, roles alternate from user on.
ranked AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY k) - (first_value(i) OVER (PARTITION BY conv_id ORDER BY k) IS NOT DISTINCT FROM 's')::INT AS place FROM turns),
said AS (SELECT conv_id, string_agg((CASE WHEN e = 'K' THEN role WHEN place % 2 = 1 THEN 'user' ELSE 'assistant' END) || ':' || (CASE e WHEN 'I' THEN '' ELSE text END), chr(10) ORDER BY k) AS lines FROM ranked GROUP BY conv_id)
SELECT a.conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0)::BIGINT AS blank, coalesce(duplicate, 0)::BIGINT AS duplicate, coalesce(truncated, 0)::BIGINT AS truncated, coalesce(illegal, 0)::BIGINT AS illegal,
       coalesce(left(best, 9)::BIGINT, 0) AS cost, coalesce(substr(best, 10), '') AS audit, sha256(coalesce(lines, '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) a LEFT JOIN ends e ON a.conv_id IS NOT DISTINCT FROM e.conv_id LEFT JOIN said s ON a.conv_id IS NOT DISTINCT FROM s.conv_id
"""

"""Personal data: fixed patterns, and bootstrapped contextual extraction of what they miss. DataFrame functions only.

Base spans are the leftmost non-overlapping matches of four kinds (email, ip, card, phone), of which those that fail the
kind's test are dropped. Spark gives no match offsets, so matches are wrapped in two control characters, the text is
split there, and lengths of the pieces give the offsets (code points). Repeated groups would recurse in Java's matcher,
so separators that join parts are marked first and a part becomes one run of characters; every pattern is linear.

Bootstrapping: tokens with a digit or @ are instances, and so are runs of two to five of them; the words around them are
patterns (left word, right word, both, two words to the left), where a neighbour that is itself such a token counts as
the word 0, which is a pattern only beside another word. Runs that overlap a base span, and tokens that hold one, are
seeds of its kind; tokens that are part of a base span are no instances. Patterns and instances form a graph, scored for
ROUNDS rounds: a pattern's confidence in a kind is the summed score of its instances over their number (plus one), if at
least SEEDS seeds support it; an instance's score is the best confidence among its patterns. Instances of a fitting
shape that score ACCEPT or more become spans of that kind, a token only where no accepted run holds it. All of it is
grouped sums and equi-joins on the distinct (instance, context) rows; joins split the patterns, values and contexts that
have a large part of them. Spans and instances of a document meet by cells of CELL code points, so a text's cost is
linear in its length, and offsets are running sums over blocks of BLOCK pieces.

n_email, n_ip, n_card, n_phone and base_sha256 are of base spans; spans has these and the ones the method adds. Null
texts are empty, as are texts without digits and @. Rows are returned one for one, repeated rows too, which count once in
the graph; a table without rows gives none; very long texts are taken whole, words of any length. Other columns are not
read.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import broadcast_if_small, checkpointed, materialize, spread_join

KINDS = ("email", "ip", "card", "phone")
ROUNDS, SEEDS, ACCEPT, CELL, BLOCK = 3, 3, 0.6, 256, 64

# Control characters: match start and end, a separator inside a card, a dot inside a name, and what stands for these.
OPEN, CLOSE, JOIN, DOT, PLAIN = "\x01", "\x02", "\x05", "\x06", "\x03"
LOCAL, LABEL = rf"[A-Za-z0-9._%+{DOT}-]", "[A-Za-z0-9-]"
EMAIL = rf"(?:\G|(?<!{LOCAL})){LOCAL}++@{LABEL}++{DOT}[A-Za-z0-9{DOT}-]++"
IP = r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}"
CARD = rf"(?<![0-9{JOIN}])[0-9{JOIN}]{{12,37}}(?![0-9{JOIN}])"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
OCTET = "0*(?:25[0-5]|2[0-4][0-9]|[01]?[0-9]?[0-9])"
TOKEN = r"[^\s0-9@]*+[0-9@]\S*+"
RUN = rf"(?<!\S){TOKEN}(?:\x20{TOKEN}){{1,4}}+"
#: What stands for a neighbour that is an instance itself; no other context word has a digit.
NUMBER = "0"
SPAN = "struct<start: bigint, end: bigint, value: string>"


def cut(marked: Column) -> Column:
    """The pieces of a marked text: every second one was wrapped."""
    return F.split(marked, f"[{OPEN}{CLOSE}]", -1)


def bind(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with value evaluated once however often it is used."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def sums_before(values: Column, levels: int = 2) -> Column:
    """array<bigint> of the sum before each element. A fold that appends copies its array at every step, so it runs over
    blocks of BLOCK elements alone; their bases are the sums before their totals, found in the same way."""

    def fold(v: Column) -> Column:
        begin = F.expr("named_struct('at', 0L, 'out', cast(array() as array<bigint>))")
        return F.aggregate(v, begin, lambda a, x: F.struct((a["at"] + x).alias("at"), F.concat(a["out"], F.array(a["at"])).alias("out")), lambda a: a["out"])

    if not levels:
        return fold(values)

    def blocks(b: Column) -> Column:
        totals = F.transform(b, lambda x: F.aggregate(x, F.lit(0).cast("bigint"), lambda a, y: a + y))
        return bind(totals, lambda t: bind(sums_before(t, levels - 1), lambda base: F.flatten(F.transform(b, lambda x, i: F.transform(fold(x), lambda y: y + F.get(base, i))))))

    n = F.size(values)
    cut_up = F.transform(F.sequence(F.lit(0), F.floor((n - 1) / BLOCK).cast("int")), lambda i: F.slice(values, i * BLOCK + 1, F.lit(BLOCK)))
    return F.when(n <= BLOCK, fold(values)).otherwise(bind(cut_up, blocks))


def located(pieces: Column) -> Column:
    """array<struct<start, end, value>> of the wrapped pieces, by code points of the unmarked text."""

    def spans(p: Column) -> Column:
        def ends(n: Column) -> Column:
            def each(at: Column) -> Column:
                one = lambda i: F.struct(F.get(at, i).alias("start"), (F.get(at, i) + F.get(n, i)).alias("end"), F.get(p, i).alias("value"))
                return F.transform(F.sequence(F.lit(1), F.size(p) - 2, F.lit(2)), one)

            return bind(sums_before(n), each)

        return F.when(F.size(p) > 2, bind(F.transform(p, lambda x: F.length(x).cast("bigint")), ends)).otherwise(none())

    return bind(pieces, spans)


def none() -> Column:
    return F.expr(f"cast(array() as array<{SPAN}>)")


def wrap(text: Column, pattern: str) -> Column:
    return F.regexp_replace(text, pattern, f"{OPEN}$0{CLOSE}")


def digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def base_spans(text: Column) -> dict[str, Column]:
    """Column of array<struct<start, end, value>> for each kind; text must hold none of the control characters."""
    dotted = F.regexp_replace(text, rf"(?<={LABEL})\.(?={LABEL})", DOT)
    joined = F.regexp_replace(text, r"(?<=[0-9])[\x20-](?=[0-9])", JOIN)
    size = lambda v: F.length(digits(v))
    some = text.rlike("[0-9]")
    return {
        "email": F.when(F.contains(text, F.lit("@")), located(cut(wrap(dotted, EMAIL)))).otherwise(none()),
        "ip": F.when(some, F.filter(located(cut(wrap(text, IP))), lambda s: s["value"].rlike(rf"^{OCTET}(?:\.{OCTET}){{3}}$"))).otherwise(none()),
        "card": F.when(some, F.filter(located(cut(wrap(joined, CARD))), lambda s: size(s["value"]).between(12, 19) & F.call_function("luhn_check", digits(s["value"])))).otherwise(none()),
        "phone": F.when(F.contains(text, F.lit("+")), F.filter(located(cut(wrap(text, PHONE))), lambda s: size(s["value"]).between(9, 15))).otherwise(none()),
    }


def instances(text: Column) -> Column:
    """array<struct<start, end, value, left, left2, right, run>>: trimmed tokens with a digit or @, runs of them, and the words around."""
    word = lambda c: F.lower(F.regexp_replace(c, r"^[^\p{L}\p{N}]++|(?<![^\p{L}\p{N}])[^\p{L}\p{N}]++$", ""))
    last = lambda c, n: F.reverse(F.regexp_extract(F.reverse(c), rf"^\s*+(?:\S++\s++){{{n}}}(\S++)", 1))
    number, empty = F.lit(NUMBER), F.lit("")

    def one(pieces: Column, span: Column, i: Column, run: bool) -> Column:
        before, after, at = F.get(pieces, 2 * i), F.get(pieces, 2 * i + 2), F.size(pieces)
        head = F.length(F.regexp_extract(span["value"], r"^[^\p{L}\p{N}+(]*+", 0))
        core = F.regexp_replace(F.substr(span["value"], (head + 1).cast("int")), r"(?<![^\p{L}\p{N}])[^\p{L}\p{N}]++$", "")
        left, left2, right = word(last(before, 0)), word(last(before, 1)), word(F.regexp_extract(after, r"^\s*+(\S++)", 1))
        bare, alone = F.trim(before) == "", last(before, 1) == ""
        further = F.coalesce(word(last(F.get(pieces, 2 * i - 2), 0)), empty)
        return F.struct(
            (span["start"] + head).alias("start"), (span["start"] + head + F.length(core)).alias("end"), core.alias("value"),
            F.when(bare & (i > 0), number).otherwise(left).alias("left"),
            F.when(bare & (i > 0), further).when(alone & (i > 0) & ~bare, number).otherwise(left2).alias("left2"),
            F.when((F.trim(after) == "") & (2 * i + 3 < at), number).otherwise(right).alias("right"), F.lit(run).alias("run"),
        )

    def found(pattern: str, run: bool) -> Column:
        return bind(cut(wrap(text, pattern)), lambda p: F.transform(located(p), lambda span, i: one(p, span, i, run)))

    both = F.concat(found(rf"(?<!\S){TOKEN}", False), found(RUN, True))
    return F.when(text.rlike("[0-9@]"), F.filter(both, lambda s: s["end"] > s["start"]))


def fits(kind: Column, value: Column) -> Column:
    """Whether a value has the shape that an instance of the kind must have at least."""
    n = F.length(digits(value))
    return (
        F.when(kind == "email", F.contains(value, F.lit("@")))
        .when(kind == "ip", value.rlike(r"^[0-9]+([.:,-][0-9]+){3}$"))
        .when(kind == "card", n.between(12, 19) & ~value.rlike(r"\p{L}"))
        .otherwise(n.between(7, 15) & ~value.rlike(r"\p{L}"))
    )


def discovered(found: DataFrame) -> DataFrame:
    """(value, left, left2, right, kind, n: rows of found with these) that the pattern-instance graph accepts; found has the seeds' kind or null."""
    key = ["value", "left", "left2", "right"]
    distinct = checkpointed(found.groupBy(*key).agg(F.min("kind").alias("kind"), F.count("*").alias("rows")))
    empty = F.lit("")
    left, left2, right = (F.coalesce(c, empty) for c in ("left", "left2", "right"))
    plain = lambda c: (c != "") & (c != NUMBER)
    pair = lambda a, b: (a != "") & (b != "") & (plain(a) | plain(b))
    named = [("L", left, plain(left)), ("R", right, plain(right)), ("B", F.concat_ws(" ", left, right), pair(left, right)), ("P", F.concat_ws(" ", left2, left), pair(left2, left))]
    patterns = F.array_compact(F.array(*(F.when(ok, F.concat(F.lit(f"{k}:"), c)) for k, c, ok in named)))
    edges = checkpointed(distinct.select(*key, "kind", "rows", F.explode(patterns).alias("pattern")))
    seeds = checkpointed(edges.where("kind IS NOT NULL").groupBy("value", "kind").agg(F.lit(1.0).alias("score")))
    links = checkpointed(edges.select("pattern", "value").distinct())
    total = links.count()
    size = checkpointed(links.groupBy("pattern").agg(F.count("*").alias("n")))
    uses = checkpointed(links.groupBy("value").agg(F.count("*").alias("n")))
    kinds = lambda score: F.collect_list(F.struct("kind", F.col(score).alias("score"))).alias("kinds")  # one a kind, at most four
    scores = seeds
    for _ in range(ROUNDS):
        known = checkpointed(scores.groupBy("value").agg(kinds("score")).join(uses, "value"))
        reach = spread_join(links, known, "value", total, F.xxhash64("pattern")).select("pattern", F.inline("kinds"))
        reach = reach.groupBy("pattern", "kind").agg(F.sum("score").alias("sum"), F.count_if(F.col("score") == 1).alias("seeds"))
        trusted = reach.where(F.col("seeds") >= SEEDS).join(size, "pattern").select("pattern", "kind", (F.col("sum") / (F.col("n") + 1)).alias("confidence"))
        trusted = checkpointed(trusted.groupBy("pattern").agg(kinds("confidence")).join(size, "pattern"))
        heard = spread_join(links, trusted, "pattern", total, F.xxhash64("value")).select("value", F.inline("kinds"))
        heard = heard.where((F.col("score") >= 0.3) & fits(F.col("kind"), F.col("value"))).groupBy("value", "kind").agg(F.max("score").alias("score"))
        scores = checkpointed(heard.join(seeds.select("value"), "value", "left_anti").union(seeds.select("value", "kind", "score")))
    rest = edges.where("kind IS NULL").drop("kind")
    best = spread_join(rest, trusted, "pattern", edges.count(), F.xxhash64(*key)).select(*key, "rows", F.inline("kinds"))
    best = best.where((F.col("score") >= ACCEPT) & fits(F.col("kind"), F.col("value")))
    return best.groupBy(*key).agg(F.max_by("kind", F.struct("score", "kind")).alias("kind"), F.max("rows").alias("n"))


def cells(start: Column, end: Column) -> Column:
    """The cells of CELL code points that a span touches."""
    return F.explode(F.sequence(F.floor(start / CELL), F.floor((end - 1) / CELL)))


def labelled(found: DataFrame, base: DataFrame) -> DataFrame:
    """found (row, start, end, run, ...) with the kind of the base spans (row, b) that make it a seed; parts of base spans go."""
    at = ["row", "start", "end", "run"]
    near = found.select(*at, cells(F.col("start"), F.col("end")).alias("cell"))
    other = base.select("row", "b", cells(F.col("b.start"), F.col("b.end")).alias("cell"))
    hits = near.join(other, ["row", "cell"]).where("b.start < end AND start < b.end")
    hits = hits.groupBy(*at).agg(F.min("b.kind").alias("any"), F.min(F.expr("IF(start <= b.start AND b.end <= end, b.kind, NULL)")).alias("held"))
    seen = found.join(hits, at, "left")
    return seen.where("run OR any IS NULL OR held IS NOT NULL").withColumn("kind", F.expr("IF(run, any, held)")).drop("any", "held")


def written(spans: str) -> str:
    """SQL for kind:start:end of an array of struct<start, rank, kind, end>, by start and then kind."""
    return f"array_join(transform(array_sort({spans}), s -> concat_ws(':', s.kind, s.start, s.end)), ',')"


def personal_data(docs: DataFrame) -> DataFrame:
    """A row per row of docs: doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans."""
    raw = F.coalesce(F.col("text").cast("string"), F.lit(""))
    odd = F.contains(raw, F.lit(OPEN)) | F.contains(raw, F.lit(CLOSE)) | F.contains(raw, F.lit(JOIN)) | F.contains(raw, F.lit(DOT))
    text = F.when(odd, F.translate(raw, OPEN + CLOSE + JOIN + DOT, PLAIN * 4)).otherwise(raw)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("t"), F.monotonically_increasing_id().alias("row"))
    rows = rows.select("doc_id", "row", *(c.alias(k) for k, c in base_spans(F.col("t")).items()), instances(F.col("t")).alias("instances"))
    tagged = [F.expr(f"transform({k}, s -> named_struct('start', s.start, 'rank', {i}, 'kind', '{k}', 'end', s.end))") for i, k in enumerate(KINDS)]
    rows = materialize(rows.select("doc_id", "row", *(F.size(k).cast("long").alias(f"n_{k}") for k in KINDS), F.concat(*tagged).alias("base"), "instances"), "pii")
    found = rows.where("size(instances) > 0").select("row", F.explode("instances").alias("i")).select("row", "i.*")
    found = checkpointed(labelled(found, rows.where("size(base) > 0").select("row", F.explode("base").alias("b"))))
    same = ["value", "left", "left2", "right"]
    new = checkpointed(discovered(found.select(*same, "kind")).withColumn("key", F.xxhash64(*same)))
    once = new.groupBy("key").agg(F.collect_list(F.struct(*same, "kind")).alias("new"), F.sum("n").alias("n"))  # several only where hashes meet
    f = found.where("kind IS NULL").drop("kind").withColumn("key", F.xxhash64(*same))
    added = spread_join(f, checkpointed(once), "key", found.count(), F.col("row")).withColumn("n", F.explode("new"))
    rank = F.array_position(F.array(*map(F.lit, KINDS)), F.col("n.kind")).cast("int") - 1
    added = added.where(" AND ".join(f"{c} <=> n.{c}" for c in same)).select("row", "start", "end", "run", "n.kind", rank.alias("rank"))
    added = checkpointed(added)
    runs = added.where("run").select("row", F.col("start").alias("from"), F.col("end").alias("to"), cells(F.col("start"), F.col("end")).alias("cell"))
    inside = (added["row"] == runs["row"]) & (F.floor(added["start"] / CELL) == runs["cell"]) & (runs["from"] <= added["start"]) & (added["end"] <= runs["to"]) & ~added["run"]
    added = added.join(runs, inside, "left_anti").groupBy("row").agg(F.collect_set(F.struct("start", "rank", "kind", "end")).alias("added"))
    both = rows.drop("instances").join(broadcast_if_small(added), "row", "left").withColumn("all", F.expr("coalesce(concat(base, added), base)"))
    return both.select("doc_id", *(f"n_{k}" for k in KINDS), F.sha2(F.expr(written("base")).cast("binary"), 256).alias("base_sha256"), F.expr(written("all")).alias("spans"))

"""Lexicon scan: a cheap RE2 prefilter, the exact scan of what survives, and summaries.

The prefilter is one alternation whose bounded repeats are widened, a superset of the exact patterns, matched by PyArrow's
RE2 over whole Arrow arrays. In what it keeps, one automaton over the literals that patterns must contain (factors.py)
says which patterns are tried. Exact hits come from Python's re, whose Unicode classes and offsets (code points) are the
definition. A lexicon with the option engine: re2 means RE2's word boundaries, classes and case instead, as SQL engines
have them: a letter beyond ASCII parts words there. Both run where documents are read; nothing is shuffled before reports.
"""

from __future__ import annotations

import re

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .. import schemas
from ..sources.config import TIERS, Lexicon, Pattern
from .factors import Literals

HIT = "struct<pattern_id: string, tier: string, annex_a: string, start: bigint, match: string, context: string, negated_hint: boolean, excluded_by: string>"
_SPACE = re.compile(r"\s+")
# RE2 knows ASCII classes only; these take in all that Python's \s and \w do.
_WIDE = {r"\s": r"\s\p{Z}\x0b\x1c-\x1f\x{85}", r"\w": r"\p{L}\p{N}_"}


def widened(regex: str) -> str:
    """The expression with {0,n} as * and {0,n}? as *?: matches wherever the expression does."""
    return re.sub(r"\{0,\d+\}", "*", regex)


def for_re2(regex: str) -> str:
    """The expression for RE2: groups do not capture, \\s and \\w cover what they do in Python."""
    out, inside, at = [], False, 0
    while at < len(regex):
        two = regex[at : at + 2]
        if two[0] == "\\":
            out.append((_WIDE[two] if inside else f"[{_WIDE[two]}]") if two in _WIDE else two)
            at += 2
            continue
        if inside:
            inside = two[0] != "]"
        elif two[0] == "[":
            inside = True
        elif two[0] == "(":
            if two != "(?":
                out.append("(?:")
                at += 1
                continue
            if regex.startswith("(?P<", at):
                out.append("(?:")
                at = regex.index(">", at) + 1
                continue
        out.append(two[0])
        at += 1
    return "".join(out)


#: A class, an escape, the head of a group, a repeat or a character of an expression.
_PART = re.compile(r"(?P<set>\[\^?\]?(?:\\.|[^\]\\])*\])|(?P<escape>\\.)|\((?:\?(?:P[<=]\w+[>)]|[a-zA-Z-]+[:)]|<?[=!]|[:>]))?|\{\d*,?\d*\}|(?P<one>.)", re.S)

_RE2_INSIDE = {r"\s": r"\t\n\f\r ", r"\w": "0-9A-Za-z_", r"\d": "0-9"}
_RE2 = {r"\s": r"[\t\n\f\r ]", r"\S": r"[^\t\n\f\r ]", r"\d": "[0-9]", r"\D": "[^0-9]", r"\w": "(?:(?!(?-i:[İı]))[0-9A-Za-z_])", r"\W": "(?:[^0-9A-Za-z_]|(?-i:[İı]))"}


def as_re2(regex: str) -> str:
    """The expression for Python's re with the meaning that RE2 gives it where the two differ: ASCII boundaries and classes, white
    space without the vertical tab, and i without its forms of more or less than one dot."""

    def part(m: re.Match) -> str:
        if two := m["escape"]:
            return f"(?a:{two})" if two in (r"\b", r"\B") else _RE2.get(two, two)
        if inside := m["set"]:
            inside = re.sub(r"\\[swd]", lambda x: _RE2_INSIDE[x[0]], inside)
            dotted = inside[1] == "^" or not inside.isascii() or re.search(r"\\[xuUNSWD]", inside)
            return inside if dotted else f"(?:(?!(?-i:[İı])){inside})"
        return "(?-i:[iI])" if m["one"] in ("i", "I") else m[0]

    return _PART.sub(part, regex)


def compiled(regex: str, lexicon: Lexicon) -> re.Pattern:
    """The expression as the lexicon's engine means it, without regard to case; a dot matches newlines too."""
    return re.compile(as_re2(regex) if lexicon.option("engine") == "re2" else regex, re.I | re.S)


def prefilter_source(lexicon: Lexicon, tiers: tuple[str, ...] | None = None) -> str:
    """RE2 alternation of the patterns of some tiers (the candidate tiers by default)."""
    chosen = lexicon.of_tiers(tiers or lexicon.candidate_tiers)
    if not chosen:
        raise ValueError("no pattern of these tiers")
    return "|".join(f"(?:{widened(for_re2(p.regex))})" for p in chosen)


def may_match(text: Column, lexicon: Lexicon, tiers: tuple[str, ...] | None = None) -> Column:
    """Whether a text can have a hit; null and empty texts cannot."""
    source = f"(?s){prefilter_source(lexicon, tiers)}"

    @F.arrow_udf("boolean")
    def match(value: pa.Array) -> pa.Array:
        return pc.fill_null(pc.match_substring_regex(value, source, ignore_case=True), False)

    return match(text)


class Scanner:
    """Compiled patterns and rules."""

    def __init__(self, lexicon: Lexicon, patterns: tuple[Pattern, ...]):
        self.patterns = [(p, compiled(widened(p.regex), lexicon), compiled(p.regex, lexicon)) for p in patterns]
        self.literals = Literals([p.regex for p in patterns])
        self.exclusions = [(r, compiled(r.regex, lexicon)) for r in lexicon.exclusions]
        self.negations = [compiled(r.regex, lexicon) for r in lexicon.negations]
        self.before, self.after, self.most = (int(lexicon.option(k)) for k in ("window_before", "window_after", "max_hits_per_pattern"))

    def judged(self, pattern_id: str, around: str) -> dict:
        """What the rules say of a hit, from its context alone."""
        return {
            "negated_hint": any(r.search(around) for r in self.negations),
            "excluded_by": next((r.id for r, x in self.exclusions if pattern_id in r.applies_to and x.search(around)), None),
        }

    def hits(self, text: str | None) -> list[dict]:
        """Non-overlapping hits, at most so many a pattern (excluded ones count), by start and pattern."""
        out = []
        possible = self.literals.possible(text) if text else 0
        for i, (p, cheap, exact) in enumerate(self.patterns):
            if not possible >> i & 1 or not cheap.search(text):
                continue
            for n, m in enumerate(exact.finditer(text)):
                if n == self.most:
                    break
                around = _SPACE.sub(" ", text[max(0, m.start() - self.before) : m.end() + self.after]).strip()
                out.append({
                    "pattern_id": p.id, "tier": p.tier, "annex_a": ";".join(map(str, p.annex_a)), "start": m.start(),
                    "match": _SPACE.sub(" ", m[0]).strip(), "context": around, **self.judged(p.id, around),
                })
        return sorted(out, key=lambda h: (h["start"], h["pattern_id"]))


def hits_of(text: Column, lexicon: Lexicon, tiers: tuple[str, ...] | None = None, only: tuple[str, ...] | None = None, prefilter: tuple[str, ...] = ()) -> Column:
    """array<HIT> of a text; null where no pattern of the tiers in prefilter can match, if any are given.

    Declared nondeterministic so that the optimizer neither evaluates it twice nor moves a later filter below it.
    """
    scanner = Scanner(lexicon, lexicon.of_tiers(tiers, only))
    source = f"(?s){prefilter_source(lexicon, prefilter)}" if prefilter else ""

    def scan(value: pa.Array) -> pa.Array:
        kinds = [("pattern_id", pa.string()), ("tier", pa.string()), ("annex_a", pa.string()), ("start", pa.int64()), ("match", pa.string()), ("context", pa.string()), ("negated_hint", pa.bool_()), ("excluded_by", pa.string())]
        wanted = pc.fill_null(pc.match_substring_regex(value, source, ignore_case=True), False).to_pylist() if source else [True] * len(value)
        return pa.array([scanner.hits(v.as_py()) if w else None for v, w in zip(value, wanted)], pa.list_(pa.struct(kinds)))

    scan.__annotations__ = {"value": pa.Array, "return": pa.Array}
    return F.arrow_udf(scan, f"array<{HIT}>").asNondeterministic()(text)


def scan(docs: DataFrame, lexicon: Lexicon, prefilter: bool = True, only: tuple[str, ...] | None = None) -> DataFrame:
    """docs that the prefilter keeps, with their hits; docs need a text column. One Arrow pass does both."""
    out = docs.withColumn("hits", hits_of(F.col("text"), lexicon, only=only, prefilter=lexicon.candidate_tiers if prefilter else ()))
    return out.where("hits IS NOT NULL") if prefilter else out


def all_hits(text: Column, lexicon: Lexicon, only: tuple[str, ...] | None = None) -> Column:
    """hits_of, empty where there are none; the prefilter takes in every tier, so it changes nothing but the time."""
    tiers = tuple({p.tier for p in lexicon.patterns})
    return F.coalesce(hits_of(text, lexicon, only=only, prefilter=tiers), F.expr(f"cast(array() as array<{HIT}>)"))


def hit_rows(scanned: DataFrame) -> DataFrame:
    """schemas.HITS: a row a hit of scanned (seq_documento, key, hits)."""
    return scanned.select("seq_documento", "key", F.inline("hits")).to(schemas.HITS)


def summaries(scanned: DataFrame, lexicon: Lexicon, keep: tuple[str, ...] = ()) -> DataFrame:
    """schemas.CANDIDATES and the columns to keep: a row a document, from the array of its own hits, so without a shuffle."""
    kept = F.filter("hits", lambda h: h["excluded_by"].isNull())
    distinct = lambda field: F.array_sort(F.array_distinct(F.transform(kept, lambda h: h[field])))
    numbers = F.flatten(F.transform(kept, lambda h: F.transform(F.filter(F.split(h["annex_a"], ";"), lambda x: x != ""), lambda x: x.cast("int"))))
    own = F.filter(kept, lambda h: h["tier"].isin(*lexicon.candidate_tiers))
    tiers = distinct("tier")
    kinds = StructType([*schemas.CANDIDATES.fields, *(scanned.schema[c] for c in keep)])
    return scanned.select(
        *keep, "seq_documento", "key", F.size(kept).cast("bigint").alias("n_hits"), F.size(distinct("pattern_id")).cast("bigint").alias("n_patterns"),
        F.array_join(distinct("pattern_id"), ";").alias("patterns"), F.array_join(tiers, ";").alias("tiers"),
        F.array_join(F.array_sort(F.array_distinct(numbers)), ";").alias("annex_a_items"),
        *(F.array_contains(tiers, t).alias(f"{t}_hit") for t in TIERS),
        ((F.size(own) > 0) & F.forall(own, lambda h: h["negated_hint"])).alias("negated_all"),
        (F.size("hits") - F.size(kept)).cast("bigint").alias("n_excluded"), (F.size(own) > 0).alias("is_candidate"), F.lit(lexicon.version).alias("lexicon_version"),
    ).to(kinds)


def outputs(docs: DataFrame, lexicon: Lexicon) -> dict[str, DataFrame]:
    """candidates, their hits, and near misses (prefiltered, no candidate) of docs (seq_documento, key, text).

    One scan feeds all three: write scanned (or persist it) before using more than one.
    """
    scanned = scan(docs, lexicon)
    summary = summaries(scanned, lexicon)
    return {"scanned": scanned, "candidates": summary.where("is_candidate"), "near_miss": summary.where("NOT is_candidate"), "hits": hit_rows(scanned)}


def pattern_counts(hits: DataFrame) -> DataFrame:
    """pattern_id, tier, documents, hits, negated share and excluded hits. Hits are summed by document first, then by pattern."""
    kept = F.col("excluded_by").isNull()
    each = hits.groupBy("pattern_id", "tier", "key", "seq_documento").agg(F.count_if(kept).alias("own"), F.count_if(kept & F.col("negated_hint")).alias("negated"), F.count_if(~kept).alias("out"))
    own = F.sum("own")
    return each.groupBy("pattern_id", "tier").agg(
        F.count_if(F.col("own") > 0).alias("documents"), own.alias("hits"), F.round(100 * F.sum("negated") / F.nullif(own, F.lit(0)), 1).alias("pct_negated"), F.sum("out").alias("dropped"),
    )


def marked(text: Column, hits: Column, left: str = "[[", right: str = "]]") -> Column:
    """text with each kept hit of hits between marks; overlapping hits share one pair."""

    @F.arrow_udf("string")
    def mark(value: pa.Array, found: pa.Array) -> pa.Array:
        out = []
        for text, own in zip(value.to_pylist(), found.to_pylist()):
            merged: list[list[int]] = []
            for a, b in sorted((h["start"], h["end"]) for h in own or ()):
                if merged and a <= merged[-1][1]:
                    merged[-1][1] = max(b, merged[-1][1])
                else:
                    merged.append([a, b])
            for a, b in reversed(merged):
                text = f"{text[:a]}{left}{text[a:b]}{right}{text[b:]}"
            out.append(text)
        return pa.array(out, pa.string())

    return mark(text, hits)


def hit_spans(text: Column, lexicon: Lexicon, only: tuple[str, ...] | None = None) -> Column:
    """array<struct<start, end>> of all matches, uncapped, by the real ends."""
    patterns = [compiled(p.regex, lexicon) for p in lexicon.of_tiers(None, only)]

    @F.arrow_udf("array<struct<start: bigint, end: bigint>>")
    def spans(value: pa.Array) -> pa.Array:
        kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
        return pa.array([[{"start": m.start(), "end": m.end()} for p in patterns for m in p.finditer(t or "")] for t in value.to_pylist()], kind)

    return spans(text)

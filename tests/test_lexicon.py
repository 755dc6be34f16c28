import re

import pyarrow as pa
import pyarrow.compute as pc
import pytest
from pyspark.sql import functions as F

from evidara.operators import lexicon as L
from evidara.plans.tables import LEXICON
from evidara.sources.config import load_groups, load_lexicon

BASE = {
    "version": "t",
    "patterns": [
        {"id": "strict_a", "tier": "strict", "annex_a": [12, 7], "regex": r"spurious\s+petition"},
        {"id": "conduct_a", "tier": "conduct", "annex_a": [7], "regex": r"identical[^.]{0,30}?petitions"},
        {"id": "capture", "tier": "conduct", "regex": r"capture"},
        {"id": "law", "tier": "normative", "regex": r"article\s\d+"},
        {"id": "near", "tier": "neighbour", "regex": r"bad faith"},
    ],
    "exclusions": [{"id": "funding", "regex": "funding cost", "applies_to": ["capture"]}],
    "negations": [{"id": "no", "regex": r"\bno\b"}],
}
LEX = load_lexicon(BASE)


def scanned(spark, *texts, lexicon=LEX, prefilter=False):
    df = spark.createDataFrame([(i, "k", t) for i, t in enumerate(texts)], "seq_documento bigint, key string, text string")
    return L.scan(df, lexicon, prefilter)


def summary(spark, *texts):
    return {r.seq_documento: r for r in L.summaries(scanned(spark, *texts), LEX).collect()}


def test_hits_exclusions_and_negation(spark):
    s = scanned(spark, "capture at low funding cost", "capture of clients", "There is no  spurious \n petition", None, "")
    hits = {(r.seq_documento, r.pattern_id): r for r in L.hit_rows(s).collect()}
    assert hits[0, "capture"].excluded_by == "funding" and hits[1, "capture"].excluded_by is None
    h = hits[2, "strict_a"]
    assert h.negated_hint and h.match == "spurious petition" and h.start == 13 and h.context == "There is no spurious petition" and h.annex_a == "12;7"
    assert not [k for k in hits if k[0] in (3, 4)]


def test_summary(spark):
    rows = summary(spark, "Spurious petition by identical new petitions under article 5", "bad faith", "no spurious petition", "capture, funding cost")
    a = rows[0]
    assert a.is_candidate and a.strict_hit and a.conduct_hit and a.normative_hit and not a.negated_all
    assert (a.n_hits, a.n_patterns, a.annex_a_items, a.patterns) == (3, 3, "7;12", "conduct_a;law;strict_a")
    assert not rows[1].is_candidate and rows[1].neighbour_hit
    assert rows[2].is_candidate and rows[2].negated_all
    assert not rows[3].is_candidate and rows[3].n_excluded == 1


def test_cap_comes_before_exclusion(spark):
    s = scanned(spark, "capture " * 10)
    assert L.hit_rows(s).count() == 3


def test_prefilter_takes_in_all_hits():
    """Whatever white space or case a hit has, RE2 keeps it."""
    source = "(?s)" + L.prefilter_source(LEX, ("strict", "conduct", "sanction", "normative", "neighbour"))
    examples = ["spurious petition", "identical new petitions", "capture", "article 5", "bad faith"]
    for sep in "  \n \x0b\x85\x1c":
        for e in examples:
            t = e.replace(" ", sep)
            exact = any(re.search(p.regex, t, re.I | re.S) for p in LEX.patterns)
            assert not exact or pc.match_substring_regex(pa.array([t, t.upper()]), source, ignore_case=True).to_pylist() == [True, True]


def test_re2_classes_cover_python():
    space, word = L.for_re2(r"\s"), L.for_re2(r"\w")
    chars = [chr(c) for c in range(1, 0x3000) if not 0xD800 <= c < 0xE000]
    for python, re2 in ((r"\s", space), (r"\w", word)):
        wanted = [c for c in chars if re.match(python, c)]
        assert all(pc.match_substring_regex(pa.array(wanted), re2).to_pylist())


def test_loader_rejects():
    def broken(**change):
        return {**BASE, **change}

    for bad in (
        broken(patterns=[]), broken(patterns=BASE["patterns"] + BASE["patterns"][:1]), broken(patterns=[{"id": "x", "tier": "odd", "regex": "a"}], exclusions=[]),
        broken(exclusions=[{"id": "e", "regex": "x", "applies_to": ["nobody"]}]),
    ):
        with pytest.raises(ValueError):
            load_lexicon(bad)
    for bad in ({"groups": []}, {"version": "1", "groups": [{"id": "Bad", "codes": [1]}]}, {"version": "1", "groups": [{"id": "abc"}]}, {"version": "1", "groups": [{"id": "abc", "codes": [1]}] * 2}):
        with pytest.raises(ValueError):
            load_groups(bad)


def test_loader_names_every_fault():
    with pytest.raises(ValueError) as told:
        load_lexicon({"patterns": [{"id": "a", "tier": "odd", "regex": "("}, {"id": "a", "tier": "strict", "regex": "x"}], "negations": [{"id": "n", "regex": None}]})
    assert all(x in str(told.value) for x in ("'a' stands 2 times", "unknown tier 'odd'", "pattern 'a' has no valid expression", "negation 'n' has no valid expression"))
    g = load_groups({"version": 2, "groups": [{"id": "some_group", "codes": ["12", 7, "x1"]}]}).by_id("some_group")
    assert (g.label, g.codes) == ("some_group", (12, 7, "x1"))


def test_wide_lexicon():
    from evidara.plans.lexicons import MIX, WIDE

    assert len(WIDE.patterns) == sum(MIX.values()) == 53 and {p.tier for p in WIDE.patterns} == set(MIX)


def test_yaml_file(tmp_path):
    yaml = pytest.importorskip("yaml")
    path = tmp_path / "lexicon.yaml"
    path.write_text(yaml.safe_dump(BASE), encoding="utf-8")
    assert load_lexicon(path) == LEX


def test_near_misses_and_marks(spark):
    out = L.outputs(spark.createDataFrame([(1, "k", "capture funding cost"), (2, "k", "capture")], "seq_documento bigint, key string, text string"), LEX)
    assert [r.seq_documento for r in out["near_miss"].collect()] == [1] and [r.seq_documento for r in out["candidates"].collect()] == [2]
    df = spark.createDataFrame([("an idiot, a moron",)], "t string")
    assert df.select(L.marked(F.col("t"), L.hit_spans(F.col("t"), LEXICON, ("insult",)))).first()[0] == "an [[idiot]], a [[moron]]"


def test_engine_of_sql():
    """With engine re2 an expression finds what RE2 finds; by default what Python does."""
    regexes = (r"\bnicht\b", r"\Bnicht", r"a\wb", r"a\Wb", r"a\sb", r"a\Sb", r"a[\s\w]b", r"a[a-z]b", r"[^.]{0,2}?\bin(?:i|s)k", r"(?P<n>i+)s{1,2}", r"a[]i]b", r"\d\D")
    texts = [f"{x}{y}" for x in ("nicht", "xnicht", "inik", "INSK", "iss", "1") for y in ("", "\u00e4", ".", "\u0131", " ")]
    texts += [f"\u00e4{x}" for x in ("nicht", "inik")] + [f"a{c}b" for c in " \xa0\x0b\u00e4xX\u0130\u0131\u017f\u212ai_.]"] + ["\u0131nik", "\u0131\u017f", "\u0663x"]
    of = lambda engine: [L.compiled(r, load_lexicon({**BASE, "options": {"engine": engine}})) for r in regexes]
    for exact, plain, regex in zip(of("re2"), of("python"), regexes):
        assert [bool(exact.search(t)) for t in texts] == pc.match_substring_regex(pa.array(texts), f"(?s){regex}", ignore_case=True).to_pylist(), regex
        assert [bool(plain.search(t)) for t in texts] == [bool(re.search(regex, t, re.I | re.S)) for t in texts]
    with pytest.raises(ValueError):
        load_lexicon({**BASE, "options": {"engine": "other"}})


def test_boundaries_of_queries_are_those_of_their_sql(spark, tmp_path):
    """A letter beyond ASCII ends a word in SQL: the one hit of each text stands beside it or beside a negation that does."""
    import sys
    from pathlib import Path

    sys.path.insert(0, str(Path(__file__).parent))
    from oracle import assert_same, database

    from evidara.plans import ORACLE_SQL, QUERIES

    texts = ["das nicht\u00e4tzach is moron", "das nicht\u00e4 x", "ein moron\u00e4 und", "\u00e4\u00e4idiot", "nichts moron", "mor\u00f3n \u0131diot"]
    spark.createDataFrame([(i, t, "de", "s", len(t)) for i, t in enumerate(texts * 2)], "doc_id bigint, text string, lang string, source string, n_chars bigint").coalesce(1).write.parquet(f"{tmp_path}/documents")
    (next(Path(f"{tmp_path}/documents").glob("*.parquet"))).rename(f"{tmp_path}/documents.parquet")
    tables = database(str(tmp_path))
    for name in ("lexicon_decisions", "lexicon_hits", "lexicon_near_miss", "lexicon_candidates", "lexicon_marked", "lexicon_rescan_candidates", "lexicon_wide"):
        assert_same(QUERIES[name](spark, str(tmp_path)), tables, ORACLE_SQL[name])

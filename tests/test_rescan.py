import pytest
from pyspark.sql import functions as F

from evidara.operators import lexicon as L
from evidara.operators import rescan as R
from evidara.sources.config import load_lexicon

PATTERNS = [
    {"id": "strict_a", "tier": "strict", "annex_a": [12, 7], "regex": r"spurious\s+petition"},
    {"id": "capture", "tier": "conduct", "regex": r"capture"},
    {"id": "law", "tier": "normative", "regex": r"article\s\d+"},
    {"id": "near", "tier": "neighbour", "regex": r"bad faith"},
]
TEXTS = ["No spurious  petition under article 5", "capture " * 5, "capture at a funding cost, bad faith", None, "", "Article 7 and article 8", "capture " * 5]


def lexicon(patterns=PATTERNS, **more):
    return load_lexicon({"version": "1", "patterns": patterns, **more})


@pytest.fixture
def docs(spark):
    return spark.createDataFrame([(i if i != 6 else 1, "k" if i < 6 else None, t, "x") for i, t in enumerate(TEXTS)], "seq_documento bigint, key string, text string, hits string")


def rows(df):
    return sorted(map(repr, df.collect()))


def full(docs, lex):
    return rows(L.hit_rows(docs.select("seq_documento", "key", "text").withColumn("hits", L.all_hits(F.col("text"), lex))))


def test_only_what_changed_is_scanned(spark, docs, tmp_path):
    root, one = str(tmp_path / "s"), lexicon()
    assert R.scan_changed(docs, one, root, "a") == ["strict_a", "capture", "law", "near"]
    assert R.scan_changed(docs, one, root, "a") == []
    changed = [{**p, "regex": r"captured?"} if p["id"] == "capture" else {**p, "regex": r"article \d"} if p["id"] == "law" else p for p in PATTERNS]
    two = lexicon(changed)
    assert R.scan_changed(docs, two, root, "a") == ["capture", "law"]
    for lex in (one, two):  # the earlier lexicon's hits are still there
        assert rows(R.stored_hits(spark, root, lex)) == full(docs, lex) != []


def test_rules_tiers_and_ids_need_no_scan(spark, docs, tmp_path):
    root = str(tmp_path / "s")
    R.scan_changed(docs, lexicon(), root, "a")
    other = [{**p, "id": "held" if p["id"] == "capture" else p["id"], "tier": "sanction", "annex_a": [3]} for p in PATTERNS]
    ruled = lexicon([*other, {"id": "again", "tier": "strict", "regex": "capture"}], exclusions=[{"id": "cost", "regex": "funding cost", "applies_to": ["held"]}], negations=[{"id": "no", "regex": r"\bno\b"}])
    assert R.scan_changed(docs.where("false"), ruled, root, "a") == []
    assert rows(R.stored_hits(spark, root, ruled)) == full(docs, ruled)
    got = rows(R.stored_candidates(spark, root, ruled))
    assert got == rows(L.summaries(L.scan(docs, ruled, prefilter=False), ruled).where("is_candidate"))


def test_windows_and_cap_are_part_of_a_fingerprint(docs, tmp_path):
    root = str(tmp_path / "s")
    R.scan_changed(docs, lexicon(), root, "a")
    for option in ("window_before", "window_after", "max_hits_per_pattern"):
        assert len(R.scan_changed(docs, lexicon(options={option: 2}), root, "a")) == 4


def test_batches(spark, docs, tmp_path):
    root, lex = str(tmp_path / "s"), lexicon()
    R.scan_changed(docs.where("seq_documento < 2"), lex, root, "a")
    R.scan_changed(docs.where("seq_documento >= 2"), lexicon(PATTERNS[:2]), root, "b")
    with pytest.raises(ValueError, match="not scanned with every pattern: b"):
        R.stored_hits(spark, root, lex)
    assert R.scan_changed(docs.where("seq_documento >= 2"), lex, root, "b") == ["law", "near"]
    assert rows(R.stored_hits(spark, root, lex)) == full(docs, lex)


def test_a_scan_that_failed_is_not_read(spark, docs, tmp_path, monkeypatch):
    root, lex = str(tmp_path / "s"), lexicon()

    made = type(spark).createDataFrame

    def fail(session, data, *more):
        if data:
            raise RuntimeError("lost")
        return made(session, data, *more)

    with monkeypatch.context() as m:
        m.setattr(type(spark), "createDataFrame", fail)  # hits are written, their lines of done are not
        with pytest.raises(RuntimeError):
            R.scan_changed(docs, lex, root, "a")
    assert R.scan_changed(docs, lex, root, "a") == [p["id"] for p in PATTERNS]
    assert len(list((tmp_path / "s" / "hits").iterdir())) == 2
    assert rows(R.stored_hits(spark, root, lex)) == full(docs, lex)


def test_empty_table_and_same_work_twice(spark, docs, tmp_path):
    root, lex = str(tmp_path / "s"), lexicon()
    R.scan_changed(docs.where("false"), lex, root, "none")
    assert R.stored_hits(spark, root, lex).count() == 0
    # two calls at a time: both scans are in done, one is read
    R.scan_changed(docs, lex, root, "a")
    again = str(tmp_path / "t")
    R.scan_changed(docs, lex, again, "a")
    spark.read.schema(R.DONE).parquet(f"{again}/done").write.mode("append").parquet(f"{root}/done")
    for scan in (tmp_path / "t" / "hits").iterdir():
        scan.rename(tmp_path / "s" / "hits" / scan.name)
    assert rows(R.stored_hits(spark, root, lex)) == full(docs, lex)


def test_filters_reach_the_files(spark, docs, tmp_path):
    root = str(tmp_path / "s")
    R.scan_changed(docs, lexicon(), root, "a")
    plan = R.stored_hits(spark, root, lexicon(PATTERNS[:1]))._jdf.queryExecution().toString()
    assert "PushedFilters" in plan and "Exchange" not in plan

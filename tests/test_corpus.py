import datetime as dt

import pytest
from pyspark.sql import functions as F

from evidara import schemas
from evidara.operators import corpus, lexicon
from evidara.operators.worksheet import REQUIRED
from evidara.sources.config import load_lexicon

LEX = load_lexicon({
    "version": "1",
    "patterns": [{"id": "s", "tier": "strict", "regex": "spurious"}, {"id": "c1", "tier": "conduct", "regex": "copied"}, {"id": "c2", "tier": "conduct", "regex": "invented"}, {"id": "f", "tier": "sanction", "regex": "fined"}],
    "exclusions": [{"id": "x", "regex": "harmless", "applies_to": ["s"]}], "negations": [{"id": "n", "regex": r"\bnot\b"}],
})
TEXTS = {1: "spurious", 2: "not spurious", 3: "copied, invented", 4: "copied, fined", 5: "spurious but harmless", 6: "quiet " * 100, 7: "short", 8: "copied"}


@pytest.fixture(scope="module")
def tables(spark):
    texts = spark.createDataFrame([(i, "20240101", t, len(t)) for i, t in TEXTS.items()], "seq_documento bigint, key string, text string, nchar bigint")
    blank = dict.fromkeys(schemas.DOCUMENTS.names)
    meta = [{**blank, "seq_documento": i, "key": "20240101", "numero_registro": f"r{i}", "data_publicacao": dt.date(2024, 1, 1)} for i in TEXTS]
    documents = spark.createDataFrame([tuple(m.values()) for m in [*meta, meta[0]]], schemas.DOCUMENTS)  # one row twice
    out = lexicon.outputs(texts, LEX)
    return documents, texts, out["candidates"], out["near_miss"], out["hits"]


def test_annotation_sample(spark, tables):
    base = corpus.annotation_base(*tables)
    sample = corpus.annotation_sample(base)
    assert {r.seq_documento: r.stratum for r in sample.collect()} == {1: "strict", 2: "strict_negated", 3: "conduct_multi", 4: "conduct_sanction", 5: "control_flagged", 6: "control_unflagged"}
    assert set(REQUIRED) <= set(sample.columns) and len(sample.columns) == 28
    assert sample.where("seq_documento = 3").first().context_1 == "copied, invented"
    blind = corpus.blind_sample(sample, 6)
    assert blind.count() == 1 and "stratum" not in blind.columns and "context_2" in blind.columns
    assert corpus.annotation_base(*tables, years=("2025", "2026")).count() == 0


def test_targets(spark, tables):
    documents, _, candidates, _, _ = tables
    links = [(f"r{i}", f"{i:020d}", "court", True) for i in TEXTS] + [("r1", "9" * 20, "court", True), ("r2", "8" * 20, None, True), ("r3", "7" * 20, "court", False), ("r7", f"{1:020d}", "court", True)]
    frame = spark.createDataFrame(links, "numero_registro string, cnj_digits string, datajud_alias string, cnj_valid boolean")
    t = corpus.targets(documents, frame, candidates, ratio=0.4)
    rows = {r.numero_processo: r for r in t.collect()}
    chosen = {n for n, r in rows.items() if r.grupo == corpus.CANDIDATE}
    assert chosen == {f"{i:020d}" for i in (1, 2, 3, 4, 8)} | {"9" * 20}
    drawn = set(rows) - chosen
    assert len(drawn) == 3 and drawn <= {f"{i:020d}" for i in (5, 6, 7)} and not any(rows[d].strict_hit for d in drawn)
    assert rows[f"{1:020d}"].strict_hit and rows[f"{1:020d}"].n_documentos == 1
    assert corpus.targets(documents, frame, candidates, ratio=0).count() == 6
    assert corpus.targets(documents, frame, candidates, years=("1999",)).count() == 0


def test_source_agreement(spark, tables):
    documents, _, candidates, _, _ = tables
    left = corpus.by_registry(documents, candidates, corpus.KEY)
    other = documents.select(F.col("numero_registro"), F.concat(F.lit("b:"), F.col("seq_documento").cast("string")).alias("key")).where("seq_documento <> 2")
    flags = spark.createDataFrame([("b:1", True, True), ("b:6", True, True)], "key string, strict_hit boolean, is_candidate boolean")
    right = corpus.by_registry(other, flags, ["key"])
    row = corpus.source_agreement(left, right).first()
    assert (row.left, row.right, row.shared) == (8, 7, 7) and (row.both_strict, row.strict_left_only, row.strict_right_only) == (1, 0, 1)
    assert (row.both_candidate, row.candidate_left_only, row.candidate_right_only, row.pct_strict_found_right) == (1, 3, 1, 100.0)
    assert [tuple(r) for r in corpus.agreement_by_year(left, right, 1).collect()] == [("2024", 2, 1, 1, 100.0)]
    assert corpus.agreement_by_year(left, right).count() == 0

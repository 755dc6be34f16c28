import datetime as dt

import pytest
from pyspark.sql import functions as F

from evidara.operators import sampling, validation, worksheet
from evidara.operators.worksheet import REQUIRED

GOLD = "doc_id string, stratum string, status string, flagged boolean, patterns array<string>, grounds array<string>"


def gold(spark, *rows):
    return spark.createDataFrame([(str(i), s, st, f, p, g) for i, (s, st, f, p, g) in enumerate(rows)], GOLD)


def test_confusion_and_weights(spark):
    rows = gold(spark, ("a", "S3", True, ["p"], []), ("a", "S2", True, ["p"], []), ("a", "S0", True, ["p"], []), ("b", "S3", False, [], []), ("b", "S0", False, [], []), ("b", "NA", False, [], []))
    m = validation.metrics(rows).first()
    assert (m.tp, m.fp, m.fn, m.tn, m.precision, m.recall, m.f1) == (2, 1, 1, 1, 0.6667, 0.6667, 0.6667)
    assert validation.metrics(rows, include_s2=False).first().precision == 0.3333
    w = spark.createDataFrame([("a", 2.0)], "stratum string, weight double")
    m = validation.metrics(rows, w).first()
    assert (m.tp, m.fp, m.fn, m.tn) == (4, 2, 1, 1)  # strata without a weight count once
    none = validation.metrics(rows.where("false")).first()
    assert (none.tp, none.precision, none.recall, none.f1) == (0, None, None, None)


def test_masking(spark):
    rows = gold(spark, ("strict", "S3", True, [], []), ("strict", "S0", True, [], []))
    log = spark.createDataFrame([("strict", 20, 2), ("control_unflagged", 1000, 10)], "stratum string, available int, sampled int")
    e = validation.estimability(rows, log)
    r = e.first()
    assert (r.precision, r.recall, r.annotation_complete, r.precision_covers_all_candidates, r.precision_scope) == (True, False, False, True, ["strict"])
    assert {(x.positive, x.kind): (x.precision, x.recall) for x in validation.estimates(rows, validation.weights(log, rows), e).collect()} == {(p, k): (0.5, None) for p in ("S3+S2", "S3") for k in ("raw", "weighted")}
    assert {x.stratum: x.weight for x in validation.weights(log, rows).collect()} == {"strict": 10.0, "control_unflagged": 0.0}


@pytest.mark.parametrize(("cells", "kappa"), [([("y", "y", 20), ("y", "n", 5), ("n", "y", 10), ("n", "n", 15)], 0.4), ([("y", "y", 3)], 1.0), ([], None)])
def test_kappa(spark, cells, kappa):
    pairs = spark.createDataFrame([(a, b) for a, b, n in cells for _ in range(n)], "a string, b string")
    assert validation.cohen_kappa(pairs).first().kappa == kappa


def test_counts_hide_small_cells(spark):
    rows = gold(spark, *[("a", "S3" if i < 3 else "S0", True, ["p", "p"], ["A1"]) for i in range(5)], ("a", "NA", True, ["q"], ["A1", "A2"]))
    assert {r.pattern_id: (r.annotated, r.signalled, r.precision) for r in validation.per_pattern(rows).collect()} == {"p": (5, 3, 0.6)}
    assert {r.ground: r.documents for r in validation.ground_counts(rows).collect()} == {"A1": 6, "A2": None}


def test_verdicts(spark):
    v = spark.createDataFrame([(600, 10, 0.35, None, 0.5, 0.1)], "reviewed int, confirmed int, precision double, kappa double, bridge_rate double, trajectory_rate double")
    assert [r.verdict for r in validation.verdicts(v).collect()] == ["reformulate", "no-go", "go", "not measured yet", "reformulate", "no-go"]
    assert [r.verdict for r in validation.verdicts(v, complete=False).collect()][:2] == ["in progress", "in progress"]


def sheet(spark, *rows):
    blank = dict.fromkeys(REQUIRED, "")
    return spark.createDataFrame([tuple((blank | r)[c] for c in REQUIRED) for r in rows], ", ".join(f"{c} string" for c in REQUIRED))


def test_worksheet_issues(spark):
    good = {"doc_id": "1", "stratum": "strict", "label1_status": "S3", "label2_grounds": "A1", "label3_measure": "M1", "label4_domain": "D1", "justification": "x", "minutes_spent": "3,5", "annotator": "a", "annotation_date": "2026-10-02", "protocol_version": "v0.1"}
    found = worksheet.issues(sheet(spark, good, good | {"doc_id": "2", "label1_status": "Q"}, good | {"doc_id": "3", "minutes_spent": "x", "label2_grounds": "MAFE;A3"}, {"doc_id": "4", "stratum": "strict"}, good | {"doc_id": "5"}, good | {"doc_id": "5"}))
    assert sorted((r.severity, r.doc_id, r.column) for r in found.collect()) == [("error", "2", "label1_status"), ("error", "3", "minutes_spent"), ("error", "5", "doc_id"), ("warning", "3", "label2_grounds")]
    assert worksheet.issues(sheet(spark, good).drop("doc_id")).first().column == "doc_id"


def test_progress_and_rounds(spark):
    rows = sheet(spark, {"doc_id": "1", "stratum": "control_flagged", "label1_status": "NA", "minutes_spent": "4", "annotation_date": "2026-10-01"}, {"doc_id": "2", "stratum": "strict"}, {"doc_id": "3", "stratum": "strict", "label1_status": "S1", "minutes_spent": "900", "annotation_date": "2026-10-05"})
    assert [(r.stratum, r.total, r.done, r.na) for r in worksheet.progress(rows).collect()] == [("strict", 2, 1, 0), ("control_flagged", 1, 1, 1)]
    assert worksheet.pace(rows).first().own_pace == 4.0
    ids = spark.createDataFrame([("1",), ("3",)], "doc_id string")
    assert worksheet.blind_schedule(rows, ids).first().earliest_start == dt.date(2026, 10, 19)
    assert worksheet.blind_schedule(rows, spark.createDataFrame([("2",)], "doc_id string")).first().earliest_start is None
    second = rows.withColumn("annotation_date", F.lit("2026-10-16"))
    assert tuple(worksheet.blind_gaps(rows, second).first()) == (2, 1, 0)


def test_samples_only_grow(spark):
    pool = spark.createDataFrame([(i, "a" if i % 2 else "b") for i in range(200)], "id int, cell string")
    few, more = ({r.id for r in sampling.seeded_sample(pool, n, 1, "id").collect()} for n in (10, 30))
    assert len(few) == 10 and few < more
    wanted = pool.where("id < 20")
    q1, q2 = ({r.id for r in sampling.quota_matched(pool, wanted, ["cell"], x, 1, ["id"]).collect()} for x in (0.5, 1.0))
    assert len(q1) == 10 and q1 < q2
    strata = (sampling.Stratum("odd", 5, "cell = 'a'"), sampling.Stratum("rest", 500, "true"))
    s = sampling.stratified(pool, 1, ["id"], strata).groupBy("stratum").agg(F.count("*").alias("n"), F.max("available").alias("m")).collect()
    assert {(r.stratum, r.n, r.m) for r in s} == {("odd", 5, 100), ("rest", 100, 100)}


def test_batches(spark):
    rows = spark.createDataFrame([(str(i), "strict" if i < 30 else "zzz", "S1" if i == 3 else "") for i in range(60)], "doc_id string, stratum string, label1_status string")
    plan = sampling.batch_plan(rows, 25).collect()
    assert [r.ordem for r in sorted(plan, key=lambda r: r.ordem)] == list(range(1, 61)) and {r.lote for r in plan} == {1, 2, 3} and all(r.stratum == "strict" for r in plan if r.ordem <= 30)
    assert tuple(sampling.next_batch(sampling.batch_plan(rows, 25)).first()) == (1, 3)
    assert sampling.batch_dates(3, dt.date(2026, 10, 2)) == [dt.date(2026, 10, 2), dt.date(2026, 10, 5), dt.date(2026, 10, 6)]
    with pytest.raises(ValueError):
        sampling.batch_plan(rows, 0)


def test_plan_keeps_one_order(spark):
    """Places by stratum and first digits of the hash are those of one sort over all rows."""
    import hashlib

    rows = [(f"d{i}", ("strict", "conduct_multi", None, "other")[i % 4], "S1" if i % 3 else "") for i in range(300)]
    df = spark.createDataFrame(rows, "doc_id string, stratum string, label1_status string").repartition(7)
    rank = {s.name: i for i, s in enumerate(sampling.STRATA)}
    want = sorted((rank.get(s or "", len(rank)), s or "", hashlib.sha256(f"5:{d}".encode()).hexdigest(), d) for d, s, _ in rows)
    got = sampling.batch_plan(df, 40, 5).orderBy("ordem").collect()
    assert [r.doc_id for r in got] == [w[3] for w in want] and [r.ordem for r in got] == list(range(1, 301))
    assert [r.lote for r in got] == [(i // 40) + 1 for i in range(300)]


def test_quota_of_nothing(spark):
    pool = spark.createDataFrame([("a", 1)], "cell string, id int")
    assert sampling.quota_matched(pool, pool.where("false"), ["cell"], 1.0, 1, ["id"]).count() == 0

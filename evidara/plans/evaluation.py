"""Samples, gold-set statistics and worksheets: labels are the gold, a lexicon scan the prediction."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import lexicon as L
from ..operators import sampling, validation, worksheet
from ..operators.sampling import Stratum
from ..session import stored
from .lexicons import _CANDIDATE, _N, PLAIN
from .tables import table, texts

STRATA = (Stratum("strict", 12, "strict_hit"), Stratum("conduct_multi", 8, "conduct_hit"), Stratum("control_flagged", 6, "lang <> 'en'"), Stratum("control_unflagged", 20, "true"))


def _flagged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a scan says of each document, with its language: one pass over the texts, without a join."""
    d = texts(spark, sf_dir).withColumn("hits", L.all_hits(F.col("text"), PLAIN))
    return L.summaries(d, PLAIN, ("lang",)).withColumn("doc_id", F.col("seq_documento"))


def _scanned(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same written once, without texts, for plans that use it more than once."""
    return stored(_flagged(spark, sf_dir), "scanned")


def _strata(spark: SparkSession, sf_dir: str, scanned: DataFrame | None = None) -> DataFrame:
    f = _flagged(spark, sf_dir) if scanned is None else scanned
    return f.groupBy(sampling.stratum_of(STRATA).alias("stratum")).agg(F.count("*").alias("available"))


def _sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sampling.stratified(_scanned(spark, sf_dir), 20260922, ["key", "seq_documento"], STRATA).select("doc_id", "key", "stratum", "available", "place")


def _blind(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sampling.blind_round(_sample(spark, sf_dir), 46, 20260922, hints=("available", "place", "stratum"))


def _seeded(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sampling.seeded_sample(table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey"), 100, 42, "o_orderkey")


def _gold(spark: SparkSession, sf_dir: str, scanned: DataFrame | None = None) -> DataFrame:
    """Labelled documents: status from quality and toxicity, strata, patterns and grounds from the scan."""
    f = (_flagged(spark, sf_dir) if scanned is None else scanned).withColumn("stratum", sampling.stratum_of(STRATA))
    l = table(spark, sf_dir, "labels")
    status = F.when(F.col("toxic") == 1, F.when(F.col("quality") == 1, "S3").otherwise("S2")).when(F.col("doc_id") % 10 == 0, "NA").when(F.col("quality") == 0, "S1").otherwise("S0")
    grounds = F.filter(F.split("annex_a_items", ";"), lambda x: x != "")
    return l.join(f, "doc_id").select("doc_id", "stratum", status.alias("status"), F.col("is_candidate").alias("flagged"), F.filter(F.split("patterns", ";"), lambda p: p != "").alias("patterns"), F.transform(grounds, lambda g: F.concat(F.lit("A"), g)).alias("grounds"))


def _log(spark: SparkSession, sf_dir: str, scanned: DataFrame | None = None) -> DataFrame:
    size = F.create_map(*(F.lit(x) for s in STRATA for x in (s.name, s.size)))[F.col("stratum")]
    return _strata(spark, sf_dir, scanned).withColumn("sampled", F.least(size, F.col("available")))


def _metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return validation.metrics(_gold(spark, sf_dir))


def _metrics_by(spark: SparkSession, sf_dir: str) -> DataFrame:
    return validation.metrics(_gold(spark, sf_dir), include_s2=False, by=("stratum",))


def _estimates(spark: SparkSession, sf_dir: str) -> DataFrame:
    scanned = _scanned(spark, sf_dir)
    gold = _gold(spark, sf_dir, scanned)
    out = validation.estimates(gold, validation.weights(_strata(spark, sf_dir, scanned), gold), validation.estimability(gold, _log(spark, sf_dir, scanned)))
    return out.select("positive", "kind", *(F.round(c, 6).alias(c) for c in ("tp", "fp", "fn", "tn")), "precision", "recall", "f1")


def _weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    return validation.weights(_log(spark, sf_dir))


def _estimability(spark: SparkSession, sf_dir: str) -> DataFrame:
    scanned = _scanned(spark, sf_dir)
    e = validation.estimability(_gold(spark, sf_dir, scanned), _log(spark, sf_dir, scanned))
    return e.withColumn("precision_scope", F.array_join("precision_scope", ";"))


def _kappa(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = _gold(spark, sf_dir).where("status <> 'NA'").select(F.col("flagged").cast("string").alias("a"), validation.signalled().cast("string").alias("b"))
    return validation.cohen_kappa(pairs)


def _rounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Agreement of the worksheet with a second labelling of every other row, in which some labels differ."""
    first, i = _sheet(spark, sf_dir).withColumn("patterns", F.lit("")), F.col("doc_id").cast("bigint")
    second = first.where(i % 2 == 0).withColumns({
        "label1_status": F.when(i % 5 == 0, F.lit("S1")).otherwise(F.col("label1_status")), "label2_grounds": F.when(i % 3 == 0, F.lit("A3")).otherwise(F.col("label2_grounds")),
    })
    return validation.round_agreement(validation.annotated(first), validation.annotated(second))


def _verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = _metrics(spark, sf_dir)
    v = m.select(F.lit(399).alias("reviewed"), (F.col("tp") + F.col("fn")).alias("confirmed"), "precision", F.lit(0.7).alias("kappa"), F.lit(0.5).alias("bridge_rate"), F.lit(None).cast("double").alias("trajectory_rate"))
    return validation.verdicts(v, complete=False)


def _sheet(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A worksheet made of the labels: some rows open, some with faults."""
    l, i = table(spark, sf_dir, "labels"), F.col("doc_id")
    pick = lambda *v: F.element_at(F.array(*map(F.lit, v)), (i % len(v) + 1).cast("int"))
    return l.select(
        i.cast("string").alias("doc_id"), pick("strict", "conduct_multi", "control_unflagged", "elsewhere").alias("stratum"), pick("S3", "", "s2", "S0", "NA", "Q").alias("label1_status"), pick("A7;A7", "", "MAFE;A3", "zz").alias("label2_grounds"),
        pick("M0", "", "M5", "M9", "m1").alias("label3_measure"), pick("D1", "", "D7").alias("label4_domain"), pick("because", "").alias("justification"), pick("3,5", "", "500", "x", "2").alias("minutes_spent"), pick("ann", "").alias("annotator"),
        pick("2026-10-02", "05/10/2026", "", "soon").alias("annotation_date"), pick("v0.1", "v0.2", "").alias("protocol_version"),
    )


def _issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    return worksheet.issues(_sheet(spark, sf_dir)).groupBy("severity", "column", "message").agg(F.count("*").alias("rows"))


def _progress(spark: SparkSession, sf_dir: str) -> DataFrame:
    return worksheet.progress(_sheet(spark, sf_dir))


def _pace(spark: SparkSession, sf_dir: str) -> DataFrame:
    return worksheet.pace(_sheet(spark, sf_dir))


def _plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sampling.batch_plan(_sheet(spark, sf_dir), 25, 20260922)


def _next(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sampling.next_batch(_plan(spark, sf_dir))


def _schedule(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = _sheet(spark, sf_dir)
    ids = s.where("label1_status <> '' AND annotation_date LIKE '%2026%'").select("doc_id")
    return worksheet.blind_schedule(s, ids)


def _gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = _sheet(spark, sf_dir)
    second = s.withColumn("annotation_date", F.when(F.col("doc_id").cast("int") % 3 == 0, "2026-10-12").otherwise("2026-11-01"))
    return worksheet.blind_gaps(s, second)


QUERIES = {
    "strata_available": _strata, "stratified_sample": _sample, "blind_sample": _blind, "seeded_sample": _seeded, "gold_metrics": _metrics, "gold_metrics_by_stratum": _metrics_by,
    "masked_estimates": _estimates, "stratum_weights": _weights, "estimability": _estimability, "per_pattern_precision": lambda s, d: validation.per_pattern(_gold(s, d)), "ground_counts": lambda s, d: validation.ground_counts(_gold(s, d), 20),
    "cohen_kappa": _kappa, "kappa_two_rounds": _rounds, "go_no_go": _verdicts, "worksheet_issues": _issues, "worksheet_progress": _progress, "worksheet_pace": _pace, "batch_plan": _plan, "next_batch": _next, "blind_schedule": _schedule, "blind_gaps": _gaps,
}

_F = f"""WITH f AS (SELECT doc_id, source AS key, lang, {_N['insult']} > 0 AS strict_hit, {_N['scorn']} > 0 AS conduct_hit, {_CANDIDATE} AS is_candidate,
  {', '.join(f"{n} AS n_{i}" for i, n in _N.items())} FROM documents),
s AS (SELECT *, CASE WHEN strict_hit THEN 'strict' WHEN conduct_hit THEN 'conduct_multi' WHEN lang <> 'en' THEN 'control_flagged' ELSE 'control_unflagged' END AS stratum FROM f),
sizes AS (SELECT * FROM (VALUES ('strict', 12), ('conduct_multi', 8), ('control_flagged', 6), ('control_unflagged', 20)) t(stratum, size)),
av AS (SELECT stratum, count(*) AS available FROM s GROUP BY 1),
draw AS (SELECT doc_id, key, stratum, available, place FROM (SELECT *, (row_number() OVER (PARTITION BY stratum ORDER BY md5(key || '-' || doc_id || '-20260922'), key, doc_id))::INT AS place FROM s) JOIN av USING (stratum) JOIN sizes USING (stratum) WHERE place <= size),
g AS (SELECT l.doc_id, stratum, is_candidate AS flagged, CASE WHEN toxic = 1 THEN CASE WHEN quality = 1 THEN 'S3' ELSE 'S2' END WHEN l.doc_id % 10 = 0 THEN 'NA' WHEN quality = 0 THEN 'S1' ELSE 'S0' END AS status,
  {', '.join(f"n_{i}" for i in _N)} FROM labels l JOIN s USING (doc_id)),
u AS (SELECT *, status IN ('S3', 'S2') AS good, status = 'S3' AS best FROM g WHERE status <> 'NA')"""


def _scores(good: str, weight: str, source: str, by: str = "") -> str:
    cells = ", ".join(f"coalesce(sum(CASE WHEN {c} THEN {weight} END), 0)::DOUBLE AS {k}" for k, c in (("tp", f"flagged AND {good}"), ("fp", f"flagged AND NOT {good}"), ("fn", f"NOT flagged AND {good}"), ("tn", f"NOT flagged AND NOT {good}")))
    return f"""SELECT *, round_even(p, 4)::DOUBLE AS precision, round_even(r, 4)::DOUBLE AS recall, round_even(CASE WHEN p > 0 AND r > 0 THEN 2 * p * r / (p + r) END, 4)::DOUBLE AS f1 FROM (
        SELECT *, tp / nullif(tp + fp, 0) AS p, tp / nullif(tp + fn, 0) AS r FROM (SELECT {by} {cells} FROM {source} {'GROUP BY ' + by.rstrip(', ') if by else ''}))"""


def _kappa_sql(a: str, b: str) -> str:
    """Cohen's kappa of two columns of q."""
    chance = f"(SELECT sum(x.n * y.n) FROM (SELECT {a} AS v, count(*) AS n FROM q GROUP BY 1) x JOIN (SELECT {b} AS v, count(*) AS n FROM q GROUP BY 1) y USING (v))"
    return f"SELECT CASE WHEN n = 0 THEN NULL WHEN e = 1 THEN CASE WHEN o = 1 THEN 1.0 ELSE 0.0 END ELSE round_even((o - e) / (1 - e), 4) END::DOUBLE FROM (SELECT count(*) AS n, count(*) FILTER ({a} = {b}) / count(*) AS o, coalesce({chance}, 0) / (count(*) * count(*)) AS e FROM q)"


_RAW = """WITH raw AS (SELECT doc_id::VARCHAR AS id, ['strict', 'conduct_multi', 'control_unflagged', 'elsewhere'][(doc_id % 4 + 1)::INT] AS stratum, ['S3', '', 's2', 'S0', 'NA', 'Q'][(doc_id % 6 + 1)::INT] AS raw, ['A7;A7', '', 'MAFE;A3', 'zz'][(doc_id % 4 + 1)::INT] AS l2,
    upper(['M0', '', 'M5', 'M9', 'm1'][(doc_id % 5 + 1)::INT]) AS measure, ['D1', '', 'D7'][(doc_id % 3 + 1)::INT] AS domain, ['because', ''][(doc_id % 2 + 1)::INT] AS reason, ['3,5', '', '500', 'x', '2'][(doc_id % 5 + 1)::INT] AS spent,
    ['ann', ''][(doc_id % 2 + 1)::INT] AS annotator, ['2026-10-02', '05/10/2026', '', 'soon'][(doc_id % 4 + 1)::INT] AS day, ['v0.1', 'v0.2', ''][(doc_id % 3 + 1)::INT] AS version FROM labels),
  w AS (SELECT *, upper(raw) AS status, raw <> '' AND upper(raw) IN ('S3', 'S2', 'S1', 'S0', 'NA') AS known, list_filter(string_split(upper(l2), ';'), lambda x: x <> '') AS g, TRY_CAST(replace(spent, ',', '.') AS DOUBLE) AS mins FROM raw),
  x AS (SELECT *, known AND status <> 'NA' AS body, len(g) > 0 AS grounded FROM w)"""
#: Severity, column, test and message of each row rule.
_RULES = [
    ("warning", "stratum", "stratum NOT IN ('strict', 'strict_negated', 'conduct_multi', 'conduct_sanction', 'control_flagged', 'control_unflagged')", "unknown stratum"),
    ("warning", "label1_status", "raw = '' AND (l2 <> '' OR measure <> '' OR domain <> '' OR reason <> '')", "labels without a status: the row counts as open"),
    ("error", "label1_status", "raw <> '' AND NOT known", "not a status code"),
    ("warning", "label1_status", "known AND raw <> status", "lower-case status"),
    ("error", "label2_grounds", "known AND len(list_filter(g, lambda z: NOT regexp_full_match(z, 'A([1-9]|1[0-9]|20)|T1198|MAFE'))) > 0", "unknown ground code"),
    ("warning", "label2_grounds", "known AND len(list_distinct(g)) < len(g)", "repeated ground code"),
    ("error", "label3_measure", "known AND measure <> '' AND measure NOT IN ('M0', 'M1', 'M2', 'M3', 'M4', 'M5')", "not a measure code"),
    ("error", "label4_domain", "known AND domain <> '' AND domain NOT IN ('D1', 'D2', 'D3', 'D4', 'D5')", "not a domain code"),
    ("warning", "minutes_spent", "known AND spent = ''", "empty"),
    ("error", "minutes_spent", "known AND spent <> '' AND mins IS NULL", "not a number"),
    ("warning", "minutes_spent", "known AND (mins <= 0 OR mins > 240)", "implausible"),
    ("warning", "annotator", "known AND annotator = ''", "empty"),
    ("warning", "annotation_date", "known AND day = ''", "empty"),
    ("error", "annotation_date", "known AND day = 'soon'", "not a date"),
    ("warning", "protocol_version", "known AND version = ''", "empty"),
    ("warning", "protocol_version", "known AND version NOT IN ('', 'v0.1')", "another protocol version"),
    ("warning", "label1_status", "known AND status = 'NA' AND (grounded OR measure <> '' OR domain <> '')", "NA with grounds, measure or domain"),
    ("warning", "justification", "body AND reason = ''", "empty"),
    ("warning", "label4_domain", "body AND domain = ''", "empty"),
    ("warning", "label3_measure", "body AND measure = ''", "empty: use M0 for no measure"),
    ("warning", "label3_measure", "body AND status = 'S3' AND measure = 'M0'", "S3 presupposes a measure"),
    ("warning", "label2_grounds", "body AND status IN ('S3', 'S2') AND NOT grounded", "signalled without grounds"),
    ("warning", "label2_grounds", "body AND status = 'S0' AND grounded", "S0 with grounds"),
    ("warning", "label2_grounds", "body AND list_contains(g, 'MAFE') AND len(list_filter(g, lambda z: regexp_full_match(z, 'A([1-9]|1[0-9]|20)'))) > 0", "MAFE excludes annex grounds"),
    ("warning", "label3_measure", "body AND measure = 'M5' AND reason = ''", "M5 needs a justification"),
]
_ISSUES = (
    f"{_RAW} SELECT severity, \"column\", message, count(*) AS rows FROM ("
    + " UNION ALL ".join(f"SELECT '{s}' AS severity, '{c}' AS \"column\", '{m}' AS message FROM x WHERE {t}" for s, c, t, m in _RULES)
    + " UNION ALL SELECT 'error', 'doc_id', 'doc_id repeated ' || count(*) || ' times' FROM x GROUP BY id HAVING count(*) > 1) GROUP BY ALL"
)

_SHEET = """WITH w AS (SELECT doc_id::VARCHAR AS doc_id, doc_id AS i, ['strict', 'conduct_multi', 'control_unflagged', 'elsewhere'][(doc_id % 4 + 1)::INT] AS stratum, ['S3', '', 's2', 'S0', 'NA', 'Q'][(doc_id % 6 + 1)::INT] AS st,
  [3.5, NULL, NULL, NULL, 2.0][(doc_id % 5 + 1)::INT] AS m, [DATE '2026-10-02', DATE '2026-10-05', NULL, NULL][(doc_id % 4 + 1)::INT] AS d,
  CASE doc_id % 4 WHEN 0 THEN 0 WHEN 1 THEN 2 WHEN 2 THEN 5 ELSE 6 END AS rank FROM labels)"""
_PLAN = f"""{_SHEET}, o AS (SELECT *, (row_number() OVER (ORDER BY rank, stratum, sha256('20260922:' || doc_id), doc_id))::INT AS ordem FROM w),
  pl AS (SELECT ordem, ((ordem - 1) // 25 + 1)::INT AS lote, stratum, doc_id, st <> '' AS feito FROM o)"""
ORACLE_SQL = {
    "strata_available": f"{_F} SELECT * FROM av",
    "stratified_sample": f"{_F} SELECT * FROM draw",
    "blind_sample": f"{_F} SELECT doc_id, key FROM draw ORDER BY md5(doc_id || '-20260922-blind'), doc_id LIMIT 5",
    "seeded_sample": "SELECT o_orderkey, o_custkey FROM orders ORDER BY md5(o_orderkey || '-42'), o_orderkey LIMIT 100",
    "gold_metrics": f"{_F} SELECT tp, fp, fn, tn, precision, recall, f1 FROM ({_scores('good', '1', 'u')})",
    "gold_metrics_by_stratum": f"{_F} SELECT stratum, tp, fp, fn, tn, precision, recall, f1 FROM ({_scores('best', '1', 'u', 'stratum, ')})",
    "masked_estimates": f"{_F}, lw AS (SELECT stratum, available / count(*) AS w FROM g JOIN av USING (stratum) GROUP BY stratum, available), uw AS (SELECT u.*, w FROM u JOIN lw USING (stratum))"
    + " UNION ALL ".join(f" SELECT '{n}' AS positive, '{k}' AS kind, round(tp, 6) AS tp, round(fp, 6) AS fp, round(fn, 6) AS fn, round(tn, 6) AS tn, precision, recall, f1 FROM ({_scores(c, w, 'uw')})" for n, c in (("S3+S2", "good"), ("S3", "best")) for k, w in (("raw", "1"), ("weighted", "w"))),
    "stratum_weights": f"{_F} SELECT stratum, available / least(size, available) AS weight FROM av JOIN sizes USING (stratum)",
    "estimability": f"""{_F}, e AS (SELECT coalesce(a.stratum, b.stratum) AS stratum, sampled, coalesce(n, 0) AS labelled, coalesce(u, 0) AS usable, coalesce(a.stratum, b.stratum) IN ('strict', 'strict_negated', 'conduct_multi', 'conduct_sanction') AS flagged
          FROM (SELECT stratum, least(size, available) AS sampled FROM av JOIN sizes USING (stratum)) a FULL JOIN (SELECT stratum, count(*) AS n, count(*) FILTER (status <> 'NA') AS u FROM g GROUP BY 1) b ON a.stratum = b.stratum)
        SELECT p AS precision, precision_scope, precision_covers_all_candidates, p AND c AS recall, annotation_complete, per_pattern_precision, p AND c AS f1 FROM (SELECT count(*) FILTER (flagged AND usable > 0) > 0 AS p,
          coalesce(array_to_string(list_sort(list(stratum) FILTER (flagged AND usable > 0)), ';'), '') AS precision_scope, count(*) FILTER (flagged AND sampled > 0 AND labelled < sampled) = 0 AS precision_covers_all_candidates,
          count(*) FILTER (stratum = 'control_unflagged' AND usable > 0) > 0 AS c, count(*) FILTER (sampled IS NOT NULL AND labelled < sampled) = 0 AS annotation_complete, coalesce(sum(usable), 0) > 0 AS per_pattern_precision FROM e)""",
    "per_pattern_precision": f"{_F} SELECT pattern_id, annotated, CASE WHEN annotated >= 5 THEN signalled END AS signalled, CASE WHEN annotated >= 5 THEN round_even(signalled / annotated, 4)::DOUBLE END AS precision, annotated < 5 AS suppressed FROM ("
    + " UNION ALL ".join(f"SELECT '{i}' AS pattern_id, count(*) AS annotated, count(*) FILTER (good) AS signalled FROM u WHERE n_{i} > 0" for i in _N)
    + ") WHERE annotated > 0",
    "ground_counts": f"{_F} SELECT ground, CASE WHEN n >= 20 THEN n END AS documents, n < 20 AS suppressed FROM ("
    + " UNION ALL ".join(f"SELECT 'A{a}' AS ground, count(*) AS n FROM g WHERE {' OR '.join(f'n_{p.id} > 0' for p in PLAIN.patterns if a in p.annex_a)}" for a in sorted({a for p in PLAIN.patterns for a in p.annex_a}))
    + ") WHERE n > 0",
    "cohen_kappa": f"""{_F} SELECT n, round_even((o - e) / (1 - e), 4)::DOUBLE AS kappa FROM (SELECT count(*) AS n, count(*) FILTER (flagged = good) / count(*) AS o,
        (count(*) FILTER (flagged) * count(*) FILTER (good) + count(*) FILTER (NOT flagged) * count(*) FILTER (NOT good)) / (count(*) * count(*)) AS e FROM u)""",
    "kappa_two_rounds": f"""WITH l AS (SELECT doc_id, ['S3', NULL, 'S2', 'S0', 'NA', NULL][(doc_id % 6 + 1)::INT] AS s, ['A7', '', 'MAFE;A3', ''][(doc_id % 4 + 1)::INT] AS g FROM labels),
        p AS (SELECT a.s AS s1, CASE WHEN a.doc_id % 5 = 0 THEN 'S1' ELSE b.s END AS s2, a.g AS g1, CASE WHEN a.doc_id % 3 = 0 THEN 'A3' ELSE b.g END AS g2 FROM l a JOIN l b USING (doc_id) WHERE doc_id % 2 = 0 AND a.s IS NOT NULL),
        q AS (SELECT * FROM p WHERE s2 IS NOT NULL) SELECT (SELECT count(*) FROM q) AS n, ({_kappa_sql('s1', 's2')}) AS kappa_status, ({_kappa_sql('g1', 'g2')}) AS kappa_grounds""",
    "worksheet_issues": _ISSUES,
    "go_no_go": f"""{_F}, m AS ({_scores('good', '1', 'u')}) SELECT 'candidates reviewed' AS criterion, 399.0::DOUBLE AS value, 1000.0::DOUBLE AS threshold_go, 'in progress' AS verdict, true AS provisional
        UNION ALL SELECT 'confirmed with reasons (S3 or S2)', tp + fn, 300.0, CASE WHEN tp + fn >= 300 THEN 'go' ELSE 'in progress' END, true FROM m
        UNION ALL SELECT 'lexical trigger precision', precision, 0.3, CASE WHEN precision >= 0.3 THEN 'go' WHEN precision >= 0.15 THEN 'reformulate' ELSE 'no-go' END, true FROM m
        UNION ALL SELECT 'annotation agreement (Cohen kappa)', 0.7, 0.75, 'reformulate', true UNION ALL SELECT 'bridge to cases', 0.5, 0.7, 'reformulate', true UNION ALL SELECT 'trajectory found', NULL, 0.7, 'not measured yet', true""",
    "worksheet_progress": f"""{_SHEET} SELECT stratum, count(*) AS total, count(*) FILTER (st <> '') AS done, count(*) FILTER (st = '') AS remaining, round(100 * count(*) FILTER (st <> '') / count(*), 1)::DOUBLE AS pct, count(*) FILTER (st = 'NA') AS na,
        coalesce(sum(m) FILTER (st <> ''), 0)::DOUBLE AS minutes, count(m) FILTER (st <> '') AS minutes_rows FROM w GROUP BY stratum""",
    "worksheet_pace": f"""{_SHEET} SELECT total, done, total - done AS remaining, round(100 * done / total, 1)::DOUBLE AS pct_done, round((total - done) * 2.0 / 60, 1)::DOUBLE AS hours_at_2_min, round((total - done) * 4.0 / 60, 1)::DOUBLE AS hours_at_4_min, p AS own_pace, round((total - done) * p / 60, 1)::DOUBLE AS hours_at_own_pace
        FROM (SELECT count(*) AS total, count(*) FILTER (st <> '') AS done, round(avg(m) FILTER (st <> ''), 2)::DOUBLE AS p FROM w)""",
    "batch_plan": f"{_PLAN} SELECT * FROM pl",
    "next_batch": f"{_PLAN} SELECT min(lote) AS next_batch, count(DISTINCT lote) AS batches_left FROM pl WHERE NOT feito",
    "blind_schedule": f"{_SHEET} SELECT count(*) AS documents, 0::BIGINT AS missing_from_gold, count(*) AS done_first, 0::BIGINT AS pending, 0::BIGINT AS undated, max(d) AS last_first_date, max(d) + 14 AS earliest_start FROM w WHERE st <> '' AND d IS NOT NULL",
    "blind_gaps": f"{_SHEET}, p AS (SELECT d, CASE WHEN i % 3 = 0 THEN DATE '2026-10-12' ELSE DATE '2026-11-01' END AS d2 FROM w WHERE st <> '') SELECT count(*) AS pairs, count(*) FILTER (d2 - d < 14) AS too_soon, count(*) FILTER (d IS NULL) AS undated FROM p",
}

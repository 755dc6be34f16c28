"""Checks of an annotation worksheet, progress, and the schedule of its blind round. All columns are texts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.dates import worksheet_date
from ..functions.labels import DOMAINS, GROUND, MEASURES, STATUSES, codes
from .sampling import STRATA, stratum_rank

# Columns of the worksheet, version of the protocol, least days before the blind round.
LABEL_COLUMNS = (
    "label1_status", "label2_grounds", "label3_measure", "label4_domain", "justification",
    "minutes_spent", "annotator", "annotation_date", "protocol_version",
)
REQUIRED = ("doc_id", "stratum", *LABEL_COLUMNS)
PROTOCOL, MIN_DAYS, MINUTES = "v0.1", 14, (2, 4)


def _text(name: str) -> Column:
    return F.trim(F.coalesce(F.col(name), F.lit("")))


def minutes(name: str = "minutes_spent") -> Column:
    return F.replace(_text(name), F.lit(","), F.lit(".")).try_cast("double")


def missing_columns(columns: list[str]) -> list[tuple[str, str, str, str]]:
    return [("error", "-", c, "required column is missing") for c in REQUIRED if c not in columns]


def row_issues() -> Column:
    """array<struct<severity, column, message>> of a row; codes are compared, never rewritten."""
    raw = _text("label1_status")
    status, measure, domain = F.upper(raw), F.upper(_text("label3_measure")), F.upper(_text("label4_domain"))
    grounds, spent, reason = codes(F.col("label2_grounds")), _text("minutes_spent"), _text("justification")
    date, version = _text("annotation_date"), _text("protocol_version")
    blank, known, na = raw == "", status.isin(*STATUSES), status == "NA"
    has_grounds, annex = F.size(grounds) > 0, F.exists(grounds, lambda g: g.rlike("^A([1-9]|1[0-9]|20)$"))
    on, body = ~blank & known, ~blank & known & ~na
    e, w = "error", "warning"
    rules = [
        (w, "stratum", ~_text("stratum").isin(*(s.name for s in STRATA)), "unknown stratum"),
        (w, "label1_status", blank & ((_text("label2_grounds") != "") | (measure != "") | (domain != "") | (reason != "")), "labels without a status: the row counts as open"),
        (e, "label1_status", ~blank & ~known, "not a status code"),
        (w, "label1_status", on & (raw != status), "lower-case status"),
        (e, "label2_grounds", on & F.exists(grounds, lambda g: ~g.rlike(GROUND)), "unknown ground code"),
        (w, "label2_grounds", on & (F.size(F.array_distinct(grounds)) < F.size(grounds)), "repeated ground code"),
        (e, "label3_measure", on & (measure != "") & ~measure.isin(*MEASURES), "not a measure code"),
        (e, "label4_domain", on & (domain != "") & ~domain.isin(*DOMAINS), "not a domain code"),
        (w, "minutes_spent", on & (spent == ""), "empty"),
        (e, "minutes_spent", on & (spent != "") & minutes().isNull(), "not a number"),
        (w, "minutes_spent", on & ((minutes() <= 0) | (minutes() > 240)), "implausible"),
        (w, "annotator", on & (_text("annotator") == ""), "empty"),
        (w, "annotation_date", on & (date == ""), "empty"),
        (e, "annotation_date", on & (date != "") & worksheet_date(F.col("annotation_date")).isNull(), "not a date"),
        (w, "protocol_version", on & (version == ""), "empty"),
        (w, "protocol_version", on & (version != "") & (version != PROTOCOL), "another protocol version"),
        (w, "label1_status", on & na & (has_grounds | (measure != "") | (domain != "")), "NA with grounds, measure or domain"),
        (w, "justification", body & (reason == ""), "empty"),
        (w, "label4_domain", body & (domain == ""), "empty"),
        (w, "label3_measure", body & (measure == ""), "empty: use M0 for no measure"),
        (w, "label3_measure", body & (status == "S3") & (measure == "M0"), "S3 presupposes a measure"),
        (w, "label2_grounds", body & status.isin("S3", "S2") & ~has_grounds, "signalled without grounds"),
        (w, "label2_grounds", body & (status == "S0") & has_grounds, "S0 with grounds"),
        (w, "label2_grounds", body & F.array_contains(grounds, "MAFE") & annex, "MAFE excludes annex grounds"),
        (w, "label3_measure", body & (measure == "M5") & (reason == ""), "M5 needs a justification"),
    ]
    found = [F.when(F.coalesce(test, F.lit(False)), F.struct(F.lit(s).alias("severity"), F.lit(c).alias("column"), F.lit(m).alias("message"))) for s, c, test, m in rules]
    return F.array_compact(F.array(*found))


def issues(rows: DataFrame) -> DataFrame:
    """severity, doc_id, column, message: header, repeated or missing ids, then each row's. No row rules without the ids."""
    spark, out = rows.sparkSession, "severity string, doc_id string, column string, message string"
    header = missing_columns(rows.columns)
    if any(c in ("doc_id", "label1_status") for _, _, c, _ in header):
        return spark.createDataFrame(header, out)
    for c in REQUIRED:
        rows = rows if c in rows.columns else rows.withColumn(c, F.lit(""))
    doc = _text("doc_id")
    ids = rows.groupBy(doc.alias("doc_id")).agg(F.count("*").alias("n")).where("doc_id = '' OR n > 1")
    told = F.when(F.col("doc_id") == "", F.concat(F.col("n").cast("string"), F.lit(" rows without doc_id"))).otherwise(F.concat(F.lit("doc_id repeated "), F.col("n").cast("string"), F.lit(" times")))
    ids = ids.select(F.lit("error").alias("severity"), F.coalesce(F.nullif("doc_id", F.lit("")), F.lit("?")).alias("doc_id"), F.lit("doc_id").alias("column"), told.alias("message"))
    each = rows.select(F.coalesce(F.nullif(doc, F.lit("")), F.lit("?")).alias("doc_id"), F.inline(row_issues())).select("severity", "doc_id", "column", "message")
    return spark.createDataFrame(header, out).unionByName(ids).unionByName(each)


def is_labelled() -> Column:
    return _text("label1_status") != ""


def progress(rows: DataFrame) -> DataFrame:
    """A row a stratum: total, done, remaining, pct, na, minutes and the rows they come from, in labelling order."""
    name = F.coalesce(F.nullif(_text("stratum"), F.lit("")), F.lit("?")).alias("stratum")
    done, m = is_labelled(), minutes()
    timed = done & (m > 0) & (m <= 240)
    out = rows.groupBy(name).agg(
        F.count("*").alias("total"), F.count_if(done).alias("done"), F.count_if(~done).alias("remaining"), F.round(100 * F.count_if(done) / F.count("*"), 1).alias("pct"),
        F.count_if(done & (F.upper(_text("label1_status")) == "NA")).alias("na"), F.coalesce(F.sum(F.when(timed, m)), F.lit(0.0)).alias("minutes"), F.count_if(timed).alias("minutes_rows"),
    )
    return out.orderBy(stratum_rank(F.col("stratum")), "stratum")


def pace(rows: DataFrame) -> DataFrame:
    """One row: total, done, remaining, pct, hours left at the usual pace (low, high) and at the annotator's own."""
    p = progress(rows).agg(*(F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("total", "done", "remaining", "minutes", "minutes_rows")))
    own = F.round(F.col("minutes") / F.nullif("minutes_rows", F.lit(0)), 2)
    hours = lambda per: F.round(F.col("remaining") * per / 60, 1)
    return p.select(
        "total", "done", "remaining", F.round(100 * F.col("done") / F.nullif("total", F.lit(0)), 1).alias("pct_done"),
        *(hours(F.lit(float(m))).alias(f"hours_at_{m}_min") for m in MINUTES), own.alias("own_pace"), hours(own).alias("hours_at_own_pace"),
    )


def blind_schedule(gold: DataFrame, ids: DataFrame, min_days: int = MIN_DAYS) -> DataFrame:
    """One row: when the blind round of ids (doc_id) may start; null until all are labelled and dated."""
    first = gold.select(_text("doc_id").alias("doc_id"), is_labelled().alias("done"), worksheet_date(F.col("annotation_date")).alias("day"), F.lit(True).alias("known"))
    j = ids.select(F.trim("doc_id").alias("doc_id")).where("doc_id <> ''").join(first, "doc_id", "left")
    done = F.coalesce("done", F.lit(False))
    out = j.agg(
        F.count("*").alias("documents"), F.count_if(F.col("known").isNull()).alias("missing_from_gold"), F.count_if(done).alias("done_first"), F.count_if(~done).alias("pending"),
        F.count_if(done & F.col("day").isNull()).alias("undated"), F.max(F.when(done, F.col("day"))).alias("last_first_date"),
    )
    ready = (F.col("pending") == 0) & (F.col("undated") == 0)
    return out.withColumn("earliest_start", F.when(ready, F.date_add("last_first_date", min_days)))


def blind_gaps(gold: DataFrame, second: DataFrame, min_days: int = MIN_DAYS) -> DataFrame:
    """One row: labelled pairs of both rounds, those too close in time, those without a date."""
    day = worksheet_date(F.col("annotation_date"))
    a = gold.select(_text("doc_id").alias("doc_id"), day.alias("d1")).dropDuplicates(["doc_id"])
    j = second.where(is_labelled()).select(_text("doc_id").alias("doc_id"), day.alias("d2")).join(a, "doc_id", "left")
    undated = F.col("d1").isNull() | F.col("d2").isNull()
    return j.agg(F.count("*").alias("pairs"), F.count_if(~undated & (F.datediff("d2", "d1") < min_days)).alias("too_soon"), F.count_if(undated).alias("undated"))

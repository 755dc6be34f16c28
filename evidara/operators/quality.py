"""Integrity of event tables, duplicates, coverage, and reports that hide small cells."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import stored
from . import skew

K = 5


def duplicates(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Key values of more than one row, with their number."""
    return rows.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1")


def backward_steps(events: DataFrame, unit: list[str], order: list[str], at: str, hot: int | None = None) -> DataFrame:
    """Events that come before the one that precedes them in their unit.

    Units of usual size are windows. Hot ones (see skew.apart; hot: rows from which a unit may be one) are dealt by ranges of
    order, and the time of each range's last event is carried to the first of the unit's next range.
    """
    usual, large = skew.apart(events, unit, hot)
    before = F.lag(at).over(Window.partitionBy(*unit).orderBy(*order))
    out = usual.withColumn("before", before).where(F.col(at) < F.col("before")).drop("before")
    return out if large is None else out.unionByName(_backward_in_ranges(large, unit, order, at).select(*events.columns))


def _backward_in_ranges(events: DataFrame, unit: list[str], order: list[str], at: str) -> DataFrame:
    parts = max(2, int(events.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    dealt = stored(events.repartitionByRange(parts, *unit, *order).withColumn("_range", F.spark_partition_id()), "ranges")  # drawn anew if evaluated twice
    inside = Window.partitionBy("_range", *unit).orderBy(*order)
    last = dealt.groupBy("_range", *unit).agg(F.max_by(at, F.struct(*order)).alias("_last"))
    carried = last.withColumn("_carried", F.lag("_last").over(Window.partitionBy(*unit).orderBy("_range"))).select(*(F.col(c).alias(f"_of_{c}") for c in ("_range", *unit)), "_carried")
    # A row a range and unit: as many as ranges, and one more for each hot unit at most.
    both = dealt.join(F.broadcast(carried), [dealt[c].eqNullSafe(carried[f"_of_{c}"]) for c in ("_range", *unit)])
    before = F.when(F.row_number().over(inside) == 1, F.col("_carried")).otherwise(F.lag(at).over(inside))
    return both.withColumn("_before", before).where(F.col(at) < F.col("_before"))


def named_counts(checks: dict[str, DataFrame]) -> DataFrame:
    """(check, violations): a row for each named frame of offending rows."""
    out = None
    for name, rows in checks.items():
        one = rows.agg(F.count("*").alias("violations")).select(F.lit(name).alias("check"), "violations")
        out = one if out is None else out.unionByName(one)
    return out


def trajectory_integrity(targets: DataFrame, cases: DataFrame, events: DataFrame, features: DataFrame) -> DataFrame:
    """Six counts that must be zero."""
    key = ["numero_processo", "alias"]
    return named_counts({
        "cases without a target": cases.join(targets.select(*key).distinct(), key, "left_anti"),
        "events without a case": events.join(cases.select("es_id").distinct(), "es_id", "left_anti"),
        "duplicate feature rows": duplicates(features, [*key, "grupo"]),
        "duplicate event numbers": duplicates(events, ["es_id", "ordem"]),
        "events out of order": backward_steps(events, ["es_id"], ["ordem"], "data_hora"),
        "targets without a feature row": targets.join(features.select(*key).distinct(), key, "left_anti"),
    })


def inflation(rows: DataFrame, keys: list[str]) -> DataFrame:
    """One row: rows, distinct keys and their ratio."""
    n = rows.groupBy(*keys).agg(F.count("*").alias("n")).agg(F.coalesce(F.sum("n"), F.lit(0)).alias("rows"), F.count("*").alias("distinct_rows"))
    return n.withColumn("ratio", F.round(F.col("rows") / F.nullif(F.col("distinct_rows"), F.lit(0)), 3))


def suppressed(rows: DataFrame, by: list[str | Column], least: int = K, **aggregates: Column) -> DataFrame:
    """Counts by group without groups of fewer than `least` rows."""
    return rows.groupBy(*by).agg(F.count("*").alias("n"), *(c.alias(k) for k, c in aggregates.items())).where(F.col("n") >= least)


def top_groups(rows: DataFrame, by: str, k: int) -> DataFrame:
    """The k commonest values, ties by value."""
    return rows.groupBy(by).agg(F.count("*").alias("n")).orderBy(F.col("n").desc(), F.col(by).asc_nulls_last()).limit(k)


def text_coverage(documents: DataFrame, texts: DataFrame) -> DataFrame:
    """key, meta_rows, text_rows, pct: documents of each file key that have a text."""
    have = texts.select("seq_documento").distinct().withColumn("has", F.lit(1))
    rows = documents.join(have, "seq_documento", "left").groupBy("key").agg(F.count("*").alias("meta_rows"), F.count("has").alias("text_rows"))
    return rows.withColumn("pct", F.round(100.0 * F.col("text_rows") / F.nullif(F.col("meta_rows"), F.lit(0)), 1))


def low_coverage(coverage: DataFrame) -> DataFrame:
    return coverage.where((F.col("meta_rows") > 0) & (F.col("text_rows") < 0.5 * F.col("meta_rows")))


def missing_keys(coverage: DataFrame, expected: DataFrame) -> DataFrame:
    return expected.join(coverage.where("meta_rows > 0").select("key"), "key", "left_anti")


def latest(log: DataFrame, key: list[str], at: str = "run_at") -> DataFrame:
    """The last row of each key in an append-only run log."""
    return log.withColumn("_n", F.row_number().over(Window.partitionBy(*key).orderBy(F.col(at).desc()))).where("_n = 1").drop("_n")


def undone(work: DataFrame, log: DataFrame, key: list[str]) -> DataFrame:
    """Work whose key the run log does not have."""
    return work.join(log.select(*key).distinct(), key, "left_anti")


def field_profile(rows: DataFrame, fields: list[str] | None = None) -> DataFrame:
    """field, rows, filled, missing, distinct_values of each column; empty texts count as missing.

    Values are counted field by field, each from its own column alone, and values are combined before the shuffle: distinct
    counts of several fields in one aggregation would carry every row once for each of them.
    """
    out = None
    for c in fields or rows.columns:
        values = rows.groupBy(F.nullif(F.trim(F.col(c).cast("string")), F.lit("")).alias("value")).agg(F.count("*").alias("n"))
        total, filled = F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum(F.when(F.col("value").isNotNull(), F.col("n"))), F.lit(0))
        one = values.agg(total.alias("rows"), filled.alias("filled"), F.count("value").alias("distinct_values"))
        one = one.select(F.lit(c).alias("field"), "rows", "filled", (F.col("rows") - F.col("filled")).alias("missing"), "distinct_values")
        out = one if out is None else out.union(one)
    return out


def terms(rows: DataFrame, fields: list[str], k: int) -> DataFrame:
    """field, value, n: the k commonest values of each field, ties by value, and with a null value the rows without one."""
    out = None
    for c in fields:
        value = F.nullif(F.trim(F.col(c).cast("string")), F.lit("")).alias("value")
        counts = rows.groupBy(value).agg(F.count("*").alias("n")).select(F.lit(c).alias("field"), "value", "n")
        top = counts.where("value IS NOT NULL").orderBy(F.col("n").desc(), "value").limit(k)
        none = counts.where("value IS NULL")
        out = top.union(none) if out is None else out.union(top).union(none)
    return out

"""Record linkage by exact keys, coverage of one table by another, and agreement of two sources."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def coverage(left: DataFrame, right: DataFrame, on: list[str], by: list[str]) -> DataFrame:
    """Rows of left and those whose key is in right, by group; right counts once a key."""
    seen = right.select(*on).distinct().withColumn("seen", F.lit(1))
    joined = left.join(seen, on, "left")
    return joined.groupBy(*by).agg(F.count("*").alias("n"), F.count("seen").alias("matched"), F.round(100.0 * F.count("seen") / F.nullif(F.count("*"), F.lit(0)), 1).alias("pct"))


def linked(documents: DataFrame, links: DataFrame, candidates: DataFrame) -> DataFrame:
    """Documents with their cases and the candidate row, if any; a registry number of several cases gives several rows."""
    return documents.join(links, "numero_registro").join(candidates, ["key", "seq_documento"], "left")


def overlap(known: DataFrame, new: DataFrame, on: str) -> DataFrame:
    """One row: distinct keys on both sides, only known, only new."""
    a, b = known.select(F.col(on).alias("k")).distinct().withColumn("a", F.lit(1)), new.select(F.col(on).alias("k")).distinct().withColumn("b", F.lit(1))
    both = a.join(b, "k", "full")
    return both.agg(F.count_if(F.col("a").isNotNull() & F.col("b").isNotNull()).alias("both"), F.count_if(F.col("b").isNull()).alias("only_known"), F.count_if(F.col("a").isNull()).alias("only_new"))


def per_key(rows: DataFrame, key: str, flags: list[str]) -> DataFrame:
    """Rows collapsed to their key; a flag holds if it holds for any of them."""
    return rows.groupBy(key).agg(F.count("*").alias("rows"), *(F.coalesce(F.max(f), F.lit(False)).alias(f) for f in flags))


def agreement(left: DataFrame, right: DataFrame, key: str, flag: str) -> DataFrame:
    """2 x 2 table of a flag over keys that both sides have (each side collapsed to the key first)."""
    a = per_key(left, key, [flag]).select(key, F.col(flag).alias("l"))
    b = per_key(right, key, [flag]).select(key, F.col(flag).alias("r"))
    l, r = F.col("l"), F.col("r")
    return a.join(b, key).agg(
        F.count("*").alias("shared"), F.count_if(l & r).alias("both_flagged"), F.count_if(l & ~r).alias("left_only"), F.count_if(~l & r).alias("right_only"), F.count_if(~l & ~r).alias("neither"),
        F.round(100.0 * F.count_if(l == r) / F.nullif(F.count("*"), F.lit(0)), 1).alias("pct_agree"),
    )


def orphans(child: DataFrame, parent: DataFrame, on: list[str]) -> DataFrame:
    """Rows of child without a parent."""
    return child.join(parent.select(*on).distinct(), on, "left_anti")

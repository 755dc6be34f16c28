"""Seeded samples that stay the same on every machine and only grow when more is asked for."""

from __future__ import annotations

import datetime as dt
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.hashing import seeded_md5, seeded_order


@dataclass(frozen=True)
class Stratum:
    name: str
    size: int
    where: str


# Strata of the annotation sample, in the order in which they are labelled.
STRATA = (
    Stratum("strict", 600, "strict_hit AND NOT negated_all"),
    Stratum("strict_negated", 120, "strict_hit AND negated_all"),
    Stratum("conduct_multi", 300, "NOT strict_hit AND n_conduct_patterns >= 2"),
    Stratum("conduct_sanction", 180, "NOT strict_hit AND conduct_hit AND sanction_hit AND n_conduct_patterns < 2"),
    Stratum("control_flagged", 100, "NOT is_candidate AND prefiltered"),
    Stratum("control_unflagged", 150, "NOT is_candidate AND NOT prefiltered"),
)
SEED, BLIND = 20260922, 0.10


def seeded_sample(rows: DataFrame, n: int, seed: str | int, *key: str) -> DataFrame:
    """n rows by the md5 of their key and the seed: a top-n, not a sort."""
    return rows.orderBy(seeded_md5(seed, *(F.col(k) for k in key)), *key).limit(n)


def stratum_of(strata: tuple[Stratum, ...] = STRATA) -> Column:
    """The first stratum whose condition holds."""
    out = F.lit(None).cast("string")
    for s in reversed(strata):
        out = F.when(F.expr(s.where), F.lit(s.name)).otherwise(out)
    return out


def stratified(rows: DataFrame, seed: str | int, key: list[str], strata: tuple[Stratum, ...] = STRATA, stratum: Column | None = None) -> DataFrame:
    """Up to each stratum's size of its rows, with available (rows in the stratum) and place.

    The window has a rank limit, so every task passes on at most the largest size of each stratum; available is a
    count of its own.
    """
    held = rows.withColumn("stratum", stratum_of(strata) if stratum is None else stratum).where("stratum IS NOT NULL")
    size = F.create_map(*(F.lit(x) for s in strata for x in (s.name, s.size)))[F.col("stratum")]
    order = Window.partitionBy("stratum").orderBy(seeded_md5(seed, *(F.col(k) for k in key)), *key)
    drawn = held.withColumn("place", F.row_number().over(order)).where(F.col("place") <= max(s.size for s in strata)).where(F.col("place") <= size)
    return drawn.join(F.broadcast(held.groupBy("stratum").agg(F.count("*").alias("available"))), "stratum")


def blind_round(sample: DataFrame, total: int, seed: str | int, fraction: float = BLIND, hints: tuple[str, ...] = ()) -> DataFrame:
    """A tenth of the sample, one at least, without its hints."""
    return seeded_sample(sample, max(1, round(total * fraction)), f"{seed}-blind", "doc_id").drop(*hints)


def quota_matched(pool: DataFrame, wanted: DataFrame, cell: list[str], ratio: float, seed: str | int, key: list[str]) -> DataFrame:
    """From pool, ceil(ratio * rows of wanted) rows in each cell; a higher ratio only adds rows."""
    quota = wanted.groupBy(*cell).agg(F.ceil(F.count("*") * ratio).alias("quota"))
    most = quota.agg(F.max("quota")).first()[0] or 0  # known beforehand, it limits what a task ranks and passes on
    order = Window.partitionBy(*cell).orderBy(seeded_md5(seed, *(F.col(k) for k in key)), *key)
    return pool.join(quota, cell).withColumn("place", F.row_number().over(order)).where(F.col("place") <= most).where("place <= quota")


def top_per_key(rows: DataFrame, key: list[str], order: list[Column], most: int, columns: list[str]) -> DataFrame:
    """The first rows of each key side by side: column_1 .. column_most."""
    ranked = rows.withColumn("place", F.row_number().over(Window.partitionBy(*key).orderBy(*order))).where(F.col("place") <= most)
    return ranked.groupBy(*key).agg(*(F.max(F.when(F.col("place") == i, F.col(c))).alias(f"{c}_{i}") for i in range(1, most + 1) for c in columns))


def stratum_rank(stratum: Column, strata: tuple[Stratum, ...] = STRATA) -> Column:
    out = F.lit(len(strata))
    for i, s in enumerate(strata):
        out = F.when(stratum == s.name, F.lit(i)).otherwise(out)
    return out


def batch_plan(rows: DataFrame, per_day: int = 25, seed: int = SEED) -> DataFrame:
    """ordem, lote, stratum, doc_id, feito for each row of an annotation worksheet.

    The order begins with stratum and seeded hash, so rows are placed within a stratum and the first two digits of the
    hash, and a table of these, 256 rows a stratum, says how many come before: no task orders all rows.
    """
    if per_day < 1:
        raise ValueError("per_day must be 1 or more")
    name, doc = F.trim(F.coalesce("stratum", F.lit(""))), F.trim(F.coalesce("doc_id", F.lit("")))
    done = F.length(F.trim(F.coalesce("label1_status", F.lit("")))) > 0
    drawn = rows.select(stratum_rank(name).alias("rank"), name.alias("stratum"), seeded_order(doc, seed).alias("hash"), doc.alias("doc_id"), done.alias("feito"))
    part = ["rank", "stratum", "head"]
    drawn = drawn.withColumn("head", F.substring("hash", 1, 2))
    before = F.coalesce(F.sum("n").over(Window.orderBy(*part).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    sizes = drawn.groupBy(*part).agg(F.count("*").alias("n")).select(*part, before.alias("before"))
    own = F.row_number().over(Window.partitionBy(*part).orderBy("hash", "doc_id"))
    placed = drawn.withColumn("own", own).join(F.broadcast(sizes), part).withColumn("ordem", (F.col("before") + F.col("own")).cast("int"))
    return placed.select("ordem", (F.floor((F.col("ordem") - 1) / per_day) + 1).cast("int").alias("lote"), "stratum", "doc_id", "feito")


def next_batch(plan: DataFrame) -> DataFrame:
    """One row: the first batch with open rows, and how many such batches there are."""
    return plan.where("NOT feito").agg(F.min("lote").alias("next_batch"), F.count_distinct("lote").alias("batches_left"))


def batch_dates(batches: int, start: dt.date, weekdays_only: bool = True) -> list[dt.date]:
    days = (start + dt.timedelta(n) for n in range(2 * batches + 7))
    return [d for d in days if not weekdays_only or d.weekday() < 5][:batches]

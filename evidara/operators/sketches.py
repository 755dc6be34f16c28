"""Overlaps of sets of keys from mergeable sketches, one for each group (a year of a source, say), instead of the keys.

A theta sketch keeps the keys of least hash, up to about 2**lg_k of them: a few dozen kilobytes for any number of keys. Sketches
are made with a partial aggregate and stored; any union, intersection or difference of groups comes from them without another
look at the rows. Of sets that together have no more than 2**lg_k keys all numbers are exact; beyond, each is within
4 * |union| / sqrt(2**lg_k) of the true one but in one of some 10,000 cases (four standard errors of an estimate of the union, an
upper bound for those of its parts). Null keys are no keys; a group of none has an empty sketch.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LG_K = 12


def key_sketches(rows: DataFrame, key: str, by: list[str], lg_k: int = LG_K) -> DataFrame:
    """by and sketch: a row a group."""
    return rows.groupBy(*by).agg(F.theta_sketch_agg(F.col(key), lg_k).alias("sketch"))


def merged(sketches: DataFrame, by: list[str], lg_k: int = LG_K) -> DataFrame:
    """Sketches of coarser groups, from those of finer ones."""
    return sketches.groupBy(*by).agg(F.theta_union_agg("sketch", lg_k).alias("sketch"))


def estimates(known: Column, new: Column, lg_k: int = LG_K) -> list[Column]:
    """both, only_known, only_new, as linkage.overlap counts them, and error: how far each may be off."""
    of = F.theta_sketch_estimate
    union = of(F.theta_union(known, new, lg_k))
    error = F.when(union > (1 << lg_k), F.ceil(4 * union / F.sqrt(F.lit(float(1 << lg_k))))).otherwise(0).cast("bigint")
    return [
        of(F.theta_intersection(known, new)).alias("both"), of(F.theta_difference(known, new)).alias("only_known"),
        of(F.theta_difference(new, known)).alias("only_new"), error.alias("error"),
    ]

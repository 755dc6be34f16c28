import pytest
from pyspark.sql import functions as F

from evidara.operators import linkage, sketches

OWN = ["both", "only_known", "only_new"]


def sides(spark, shift, n):
    a = spark.range(n).select(F.col("id").alias("k"), (F.col("id") % 3).alias("g"))
    return a.union(a), spark.range(shift, shift + n).select(F.col("id").alias("k"), F.lit(0).alias("g"))


@pytest.mark.parametrize("shift, n, lg_k", [(100, 400, 12), (0, 300, 12), (5_000, 5_000, 12), (3_000, 60_000, 12), (30_000, 60_000, 8)])
def test_overlaps_are_within_the_stated_error(spark, shift, n, lg_k):
    known, new = sides(spark, shift, n)
    exact = linkage.overlap(known, new, "k").first()
    fine = sketches.key_sketches(known, "k", ["g"], lg_k)
    a = sketches.merged(fine, [], lg_k).select(F.col("sketch").alias("a"))
    b = sketches.key_sketches(new, "k", [], lg_k).select(F.col("sketch").alias("b"))
    got = a.join(b, F.lit(True)).select(*sketches.estimates(F.col("a"), F.col("b"), lg_k)).first()
    assert all(abs(got[c] - exact[c]) <= got.error for c in OWN)
    assert (got.error == 0) == (n + shift <= 1 << lg_k)


def test_nulls_and_empty_groups(spark):
    rows = spark.createDataFrame([("x", None), ("x", 1), ("y", None), (None, 1)], "g string, k bigint")
    s = sketches.key_sketches(rows, "k", ["g"])
    assert {r.g: r.n for r in s.select("g", F.theta_sketch_estimate("sketch").alias("n")).collect()} == {"x": 1, "y": 0, None: 1}
    assert sketches.key_sketches(rows.where("false"), "k", ["g"]).count() == 0

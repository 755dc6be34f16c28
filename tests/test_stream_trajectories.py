import pytest
from pyspark.sql import functions as F

from evidara.operators import trajectory
from evidara.sources.config import load_groups
from evidara.streaming import trajectories as S
from evidara.streaming.ingest import new_rows

GROUPS = load_groups({"version": "1", "groups": [{"id": "judged", "codes": ["7"]}, {"id": "appeal", "name_contains": ["appeal"]}]})
KIND = "numero bigint, codigo string, nome string, quando timestamp_ntz, orgao string, case string"
FIRST = [(1, "7", "judged", "2024-01-05", "a"), (1, "8", "zz", "2024-01-03", None), (1, "8", "zz", "2024-01-03", None), (None, "7", None, None, "b"), (2, None, "an APPEAL", "1969-12-31 23:59:59.999999", "")]
#: Late, repeated, and repeated under a lesser name that belongs to another group.
SECOND = [(1, "7", "judged", "2024-01-05", "a"), (1, "8", "appeal", "2024-01-03", None), (1, "9", "x", "2023-12-01", "a"), (2, None, "zz", "1969-12-31 23:59:59.999999", ""), (3, "7", "", "2024-02-01", "c")]
NAMES = {"code": "codigo", "name": "nome", "at": "quando", "organ": "orgao"}


def add(spark, path, rows):
    df = spark.createDataFrame([(*r, "clash") for r in rows], KIND.replace("timestamp_ntz", "string")).withColumn("quando", F.col("quando").cast("timestamp_ntz"))
    df.write.mode("append").parquet(path)
    return df


def drained(spark, tmp_path, **more):
    S.drain_events(new_rows(spark, f"{tmp_path}/in", KIND), GROUPS, f"{tmp_path}/out", f"{tmp_path}/done", ("numero",), **NAMES, **more)
    return S.current(spark, f"{tmp_path}/out", GROUPS, "numero bigint")


def expected(spark, tmp_path):
    return trajectory.event_summary(spark.read.schema(KIND).parquet(f"{tmp_path}/in"), GROUPS, ("numero",), **NAMES)


def rows(df, columns):
    return sorted(map(repr, df.select(*columns).collect()))


@pytest.mark.parametrize("held", [S.HELD, 1])
def test_a_drained_stream_equals_the_batch(spark, tmp_path, held):
    for part in (FIRST, SECOND, []):
        add(spark, f"{tmp_path}/in", part)
        got, want = drained(spark, tmp_path, held=held), expected(spark, tmp_path)
        assert rows(got, want.columns) == rows(want, want.columns)


def test_empty_stream(spark, tmp_path):
    spark.createDataFrame([], KIND).write.parquet(f"{tmp_path}/in")
    assert drained(spark, tmp_path).count() == 0


def test_state_is_kept_by_spark_and_holds_an_event_once(spark, tmp_path):
    """No Python worker takes part, a repeated event is not written again, and a changed checkpoint setting is put back."""
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    for n in range(2):
        add(spark, f"{tmp_path}/in", FIRST)
        drained(spark, tmp_path)
    assert spark.read.parquet(f"{tmp_path}/out").count() == 4
    assert spark.conf.get("spark.sql.streaming.stateStore.providerClass") == before
    stream = S.facts(new_rows(spark, f"{tmp_path}/in", KIND), ("numero",), **NAMES).dropDuplicates()
    assert "Python" not in stream._jdf.queryExecution().logical().toString() and "transformwithstate" not in stream._jdf.queryExecution().logical().toString().lower()

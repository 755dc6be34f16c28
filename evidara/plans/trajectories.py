"""Event trajectories over events (cases are users) and customer (targets)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import figures, quality, trajectory
from ..sources.config import load_groups
from .tables import table

GROUPS = load_groups({
    "version": "1",
    "groups": [
        {"id": "problem", "label": "Problem", "codes": ["error"]},
        {"id": "interest", "label": "Interest", "codes": ["view"], "name_contains": ["click"]},
        {"id": "commitment", "label": "Commitment", "name_contains": ["SIGN", "purch"]},
    ],
})
CASE = ("user_id",)


def _features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row a customer, with the trajectory of the user of that number; customers without events stay."""
    return features_of(table(spark, sf_dir, "events"), table(spark, sf_dir, "customer"))


def features_of(log: DataFrame, customers: DataFrame) -> DataFrame:
    return features_from(trajectory.event_summary(log, GROUPS, CASE, "event_type", "event_type", "ts", "props"), customers)


def features_from(summary: DataFrame, customers: DataFrame) -> DataFrame:
    targets = customers.select(F.col("c_custkey").alias("user_id"), F.col("c_mktsegment").alias("segment"), (F.col("c_acctbal") > 5000).alias("wealthy"))
    j = targets.join(summary.withColumn("found", F.lit(True)), "user_id", "left")
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    days = trajectory.days_between(F.col("primeiro_movimento"), F.col("ultimo_movimento")).cast("bigint")
    return j.select(
        "user_id", "segment", "wealthy", zero("n_movimentos"), zero("n_codigos_distintos"), zero("n_orgaos_movimento"), "primeiro_movimento", "ultimo_movimento",
        days.alias("dias_entre_movimentos"), *(x for g in GROUPS.groups for x in (zero(f"n_{g.id}"), F.col(f"primeiro_{g.id}"))), F.col("found").isNull().alias("nao_encontrado"),
    )


_SQL = """
WITH e AS (SELECT user_id, event_type, ts, props, min(event_id) AS event_id FROM events GROUP BY ALL),
m AS (SELECT user_id, count(*) AS n, count(DISTINCT event_type) AS codes, count(DISTINCT props) AS organs, min(ts) AS a, max(ts) AS b,
  count(*) FILTER (event_type IN ('error')) AS n1, min(ts) FILTER (event_type IN ('error')) AS p1,
  count(*) FILTER (event_type IN ('view') OR event_type ILIKE '%click%') AS n2, min(ts) FILTER (event_type IN ('view') OR event_type ILIKE '%click%') AS p2,
  count(*) FILTER (event_type ILIKE '%SIGN%' OR event_type ILIKE '%purch%') AS n3, min(ts) FILTER (event_type ILIKE '%SIGN%' OR event_type ILIKE '%purch%') AS p3
  FROM e GROUP BY user_id),
f AS (SELECT c_custkey AS user_id, c_mktsegment AS segment, c_acctbal > 5000 AS wealthy, coalesce(n, 0)::BIGINT AS n_movimentos, coalesce(codes, 0)::BIGINT AS n_codigos_distintos,
  coalesce(organs, 0)::BIGINT AS n_orgaos_movimento, a AS primeiro_movimento, b AS ultimo_movimento, date_diff('day', a, b)::BIGINT AS dias_entre_movimentos,
  coalesce(n1, 0)::BIGINT AS n_problem, p1 AS primeiro_problem, coalesce(n2, 0)::BIGINT AS n_interest, p2 AS primeiro_interest, coalesce(n3, 0)::BIGINT AS n_commitment, p3 AS primeiro_commitment,
  m.user_id IS NULL AS nao_encontrado FROM customer LEFT JOIN m ON m.user_id = c_custkey)
"""


def _comparison(by: tuple[str, ...]):
    return lambda spark, sf_dir: trajectory.comparison(_features(spark, sf_dir), by, GROUPS)


def _comparison_sql(by: str) -> str:
    shares = ", ".join(f"round(100 * count(*) FILTER (NOT nao_encontrado AND n_{g.id} > 0) / nullif(count(*) FILTER (NOT nao_encontrado), 0)::DOUBLE, 2) AS pct_{g.id}" for g in GROUPS.groups)
    stats = ", ".join(f"round({f}({c}) FILTER (NOT nao_encontrado), 2)::DOUBLE AS {n}" for f, c, n in (("avg", "n_movimentos", "mean_events"), ("median", "n_movimentos", "median_events"), ("avg", "dias_entre_movimentos", "mean_days"), ("median", "dias_entre_movimentos", "median_days")))
    return f"{_SQL} SELECT {by}, count(*) AS n, count(*) FILTER (nao_encontrado) AS n_not_found, {stats}, {shares} FROM f GROUP BY {by} HAVING count(*) >= 5"


def _vocabulary(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events")
    targets = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("user_id"), "c_mktsegment")
    return trajectory.vocabulary(events, targets, "c_mktsegment", 20, CASE, ("event_type",))


def _inflation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.inflation(table(spark, sf_dir, "events"), ["user_id", "event_type"])


def _gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines shipped before the line numbered before them, by order."""
    return quality.backward_steps(table(spark, sf_dir, "lineitem"), ["l_orderkey"], ["l_linenumber", "l_partkey", "l_suppkey", "l_shipdate"], "l_shipdate").select("l_orderkey", "l_linenumber", "l_partkey", "l_shipdate")


def _hot_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same where a unit holds a large part of all lines: order by order within each return flag."""
    order = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_shipdate"]
    return quality.backward_steps(table(spark, sf_dir, "lineitem"), ["l_returnflag"], order, "l_shipdate", hot=1000).select("l_returnflag", "l_orderkey", "l_linenumber", "l_partkey", "l_shipdate")


def _shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Share of customers with each event group in two segments, side by side."""
    return figures.group_shares(_comparison(("segment",))(spark, sf_dir), GROUPS, "segment", "BUILDING", "MACHINERY")


QUERIES = {
    "figure_shares": _shares,
    "trajectory_features": _features,
    "group_comparison": _comparison(("segment",)),
    "group_comparison_two_keys": _comparison(("segment", "wealthy")),
    "event_vocabulary": _vocabulary,
    "dedupe_inflation": _inflation,
    "backward_steps": _gaps,
    "backward_steps_hot": _hot_gaps,
}
ORACLE_SQL = {
    "figure_shares": " UNION ALL ".join(
        f"SELECT '{g.label_en or g.label}' AS label, max(pct_{g.id}) FILTER (segment = 'BUILDING') AS signalled, max(pct_{g.id}) FILTER (segment = 'MACHINERY') AS other FROM ({_comparison_sql('segment')}) HAVING signalled IS NOT NULL AND other IS NOT NULL"
        for g in GROUPS.groups
    ),
    "trajectory_features": f"{_SQL} SELECT * FROM f",
    "group_comparison": _comparison_sql("segment"),
    "group_comparison_two_keys": _comparison_sql("segment, wealthy"),
    "event_vocabulary": """SELECT event_type, c_mktsegment, count(*) AS cases FROM (SELECT DISTINCT user_id, event_type FROM events) e JOIN customer ON c_custkey = user_id
        GROUP BY ALL HAVING count(*) >= 5 ORDER BY cases DESC, event_type, c_mktsegment LIMIT 20""",
    "dedupe_inflation": """SELECT sum(n)::BIGINT AS rows, count(*) AS distinct_rows, round(sum(n) / count(*), 3)::DOUBLE AS ratio FROM (SELECT count(*) AS n FROM events GROUP BY user_id, event_type)""",
    "backward_steps": """SELECT l_orderkey, l_linenumber, l_partkey, l_shipdate FROM (SELECT *, lag(l_shipdate) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_shipdate) AS b FROM lineitem) WHERE l_shipdate < b""",
    "backward_steps_hot": """SELECT l_returnflag, l_orderkey, l_linenumber, l_partkey, l_shipdate FROM (SELECT *, lag(l_shipdate) OVER (PARTITION BY l_returnflag ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey, l_shipdate) AS b FROM lineitem) WHERE l_shipdate < b""",
}

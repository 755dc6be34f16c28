"""Resumable ingestion as a query: documents arrive as a file stream and are scanned batch by batch."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import lexicon as L
from ..session import scratch
from ..streaming import trajectories
from ..streaming.ingest import drain, new_rows
from .lexicons import _CANDIDATE, _N, PLAIN
from .tables import table
from .trajectories import _SQL, CASE, GROUPS, features_from


def _stream_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Candidates by language, from a stream that is drained, and drained again without finding anything new."""
    out, done = scratch(spark, "stream-out"), scratch(spark, "stream-done")

    def each(batch: DataFrame, number: int) -> None:
        docs = batch.select(F.col("doc_id").alias("seq_documento"), F.col("lang").alias("key"), "text")
        L.summaries(L.scan(docs, PLAIN), PLAIN).write.mode("overwrite").parquet(f"{out}/batch={number}")

    schema = table(spark, sf_dir, "documents").schema
    for _ in range(2):
        drain(new_rows(spark, f"{sf_dir}/documents.parquet", schema), done, each)
    rows = spark.read.parquet(out).where("is_candidate")
    return rows.groupBy(F.col("key").alias("lang")).agg(F.count("*").alias("candidates"), F.count_if("strict_hit").alias("strict"))


def _stream_trajectories(spark: SparkSession, sf_dir: str) -> DataFrame:
    """trajectory_features from a stream of events: every other one comes first, then all, so that half of them repeat."""
    events, (arriving, out, done) = table(spark, sf_dir, "events"), (scratch(spark, f"trajectory-{x}") for x in ("in", "out", "done"))
    for part in (events.where("event_id % 2 = 1"), events):
        part.write.mode("append").parquet(arriving)
        stream = new_rows(spark, arriving, events.schema)
        trajectories.drain_events(stream, GROUPS, out, done, CASE, "event_type", "event_type", "ts", "props")
    summary = trajectories.current(spark, out, GROUPS, "user_id bigint")
    return features_from(summary, table(spark, sf_dir, "customer"))


QUERIES = {"stream_candidates": _stream_candidates, "stream_trajectories": _stream_trajectories}
ORACLE_SQL = {
    "stream_trajectories": f"{_SQL} SELECT * FROM f",
    "stream_candidates": f"SELECT lang, count(*) AS candidates, count(*) FILTER ({_N['insult']} > 0) AS strict FROM documents WHERE {_CANDIDATE} GROUP BY lang",
}

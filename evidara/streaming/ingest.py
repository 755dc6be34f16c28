"""Keyed batches that resume where they stopped, as Structured Streaming queries with the availableNow trigger.

The checkpoint records which files are done. Its folder carries the lexicon's version, so a new version scans all again.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

from ..operators.lexicon import hit_rows, scan, summaries
from ..sources.config import Lexicon


def new_rows(spark: SparkSession, path: str, schema: StructType, files_a_batch: int = 1000) -> DataFrame:
    """Rows of Parquet files that the query has not seen."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_a_batch).option("recursiveFileLookup", "true").parquet(path)


def drain(rows: DataFrame, checkpoint: str, each: Callable[[DataFrame, int], None]) -> None:
    """Run each(batch, number) over all that is there, then stop. A batch may come again after a failure, with its number."""
    rows.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def scan_new(spark: SparkSession, texts: str, schema: StructType, lexicon: Lexicon, out: str, checkpoint: str) -> None:
    """Scan new texts (seq_documento, key, text); candidates, near misses and hits go to folders of out, by batch."""

    def each(batch: DataFrame, number: int) -> None:
        scanned = scan(batch.select("seq_documento", "key", "text"), lexicon).select("seq_documento", "key", "hits").persist()
        summary = summaries(scanned, lexicon)
        for name, df in (("candidates", summary.where("is_candidate")), ("near_miss", summary.where("NOT is_candidate")), ("candidate_hits", hit_rows(scanned))):
            df.write.mode("overwrite").parquet(f"{out}/{name}/version={lexicon.version}/batch={number}")
        scanned.unpersist()

    drain(new_rows(spark, texts, schema), f"{checkpoint}/scan-{lexicon.version}", each)

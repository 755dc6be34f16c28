"""Views over a data root: one folder of Parquet shards for each table."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession

# Names of the stored tables.
TABLES = (
    "documents", "document_text", "candidates", "near_miss", "candidate_hits", "candidates_espelhos", "bridge",
    "espelhos", "espelho_citations", "espelho_legislation", "datajud_cases", "datajud_movimentos", "datajud_targets", "datajud_features",
)


def read_table(spark: SparkSession, root: str, name: str) -> DataFrame:
    """All Parquet shards of a table, by name and whatever the depth."""
    return spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", "*.parquet").parquet(f"{root}/{name}")


def create_views(spark: SparkSession, root: str, only: tuple[str, ...] = TABLES, count: bool = True) -> dict[str, int | None]:
    """A temporary view for each table that has data; its row count, or None where there is none."""
    found: dict[str, int | None] = {}
    for name in only:
        try:
            df = read_table(spark, root, name)
        except AnalysisException:
            found[name] = None
            continue
        df.createOrReplaceTempView(name)
        found[name] = df.count() if count else None
    return found


def document(spark: SparkSession, root: str, key: str, seq: int, table: str = "document_text") -> DataFrame:
    """One document by its two keys; both filters reach the Parquet scan."""
    df = read_table(spark, root, table)
    return df.where((df.key == key) & (df.seq_documento == seq)).limit(1)

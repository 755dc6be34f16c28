"""Trajectories over a stream: the state is which events have been seen, so late and repeated events count once.

Structured Streaming's own dropDuplicates holds the state, in RocksDB, which keeps it on disk: a key for each event and name it
came under, dealt by all of the key, so a case that holds a large part of all events is spread over all tasks. Each batch appends
what is new of it; `current` sums up all of that, as a batch query, by trajectory.event_summary, hot cases included.

The drained stream equals trajectory.event_summary over all that came, in whatever order and however often. State is kept for
good: a time-out would let an event that comes again after it count twice. Where a repeated event comes with a lesser name,
groups count it by that name: both rows are there, and the summary takes the least. Nulls in keys are values like any other; null
codes and organs are not counted as such.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..operators.trajectory import event_summary
from ..sources.config import EventGroups
from .ingest import drain

#: Rows of a file of new events at most.
HELD = 1_000_000
_CONF = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.boundedMemoryUsage": "true",  # of all partitions of an executor together
}


def facts(events: DataFrame, case: tuple[str, ...], code: str, name: str, at: str, organ: str) -> DataFrame:
    """case (a struct), code, name, at, organ: what of an event decides how it counts."""
    return events.select(F.struct(*case).alias("case"), F.col(code).alias("code"), F.col(name).alias("name"), F.col(at).cast("timestamp_ntz").alias("at"), F.col(organ).alias("organ"))


def drain_events(
    events: DataFrame, groups: EventGroups, out: str, checkpoint: str, case: tuple[str, ...], code: str, name: str, at: str, organ: str, held: int = HELD
) -> None:
    """Take in all that events, a stream, has; events not seen before go to a folder of out for each batch. Groups are read by current."""
    spark = events.sparkSession
    new = facts(events, case, code, name, at, organ)

    def each(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").option("maxRecordsPerFile", held).parquet(f"{out}/batch={number}")

    spark.createDataFrame([], new.schema).write.mode("overwrite").parquet(f"{out}/batch=-1")  # there is always one to read
    before = {k: spark.conf.get(k, None) for k in _CONF}
    for k, v in _CONF.items():
        spark.conf.set(k, v)
    try:
        drain(new.dropDuplicates(), checkpoint, each)
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def current(spark: SparkSession, out: str, groups: EventGroups, case: str) -> DataFrame:
    """The columns of trajectory.event_summary for each case seen; case is the DDL of its columns."""
    fields = StructType.fromDDL(case).fields
    own = [f"_case{i}" for i in range(len(fields))]
    rows = spark.read.parquet(out).select(*(F.col(f"case.`{f.name}`").cast(f.dataType).alias(n) for f, n in zip(fields, own)), "code", "name", "at", "organ")
    return event_summary(rows, groups, tuple(own), "code", "name", "at", "organ").withColumnsRenamed({n: f.name for f, n in zip(fields, own)})

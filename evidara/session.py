"""Session settings that the library's plans count on."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def session(name: str = "evidara", master: str | None = None, **conf: str) -> SparkSession:
    """A session with UTC timestamps, adaptive execution with skew handling, and zstd Parquet."""
    builder = SparkSession.builder.appName(name)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.parquet.compression.codec": "zstd",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
    }
    for key, value in (settings | {k.replace("__", "."): v for k, v in conf.items()}).items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def scratch(spark: SparkSession, name: str) -> str:
    """A path for new files under spark.checkpoint.dir, which all executors share; they go with the session. Where that is
    unset, a temporary folder; a local master only, as on a cluster each executor would write to a disk of its own."""
    import re
    import tempfile
    import uuid

    root = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not root and not re.fullmatch(r"local(\[[^]]*\])?", spark.sparkContext.master):
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    root = root or "file://" + tempfile.mkdtemp(prefix="evidara-")
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex}")
    store = folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    store.mkdirs(folder)  # what does not exist is not deleted
    store.deleteOnExit(folder)
    return f"{folder}/data"


def stored(df: DataFrame, name: str) -> DataFrame:
    """df written once to a scratch path and read back, for plans that use it more than once."""
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)

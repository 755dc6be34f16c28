"""Annotation worksheets as CSV, with ',' or ';' and with or without a byte order mark, or as workbooks; all columns are texts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from .workbook import MOST_BYTES, sheet


def separator(spark: SparkSession, path: str) -> str:
    """';' where the header line has more of them than of ','."""
    first = spark.read.text(path).limit(1).collect()
    line = first[0].value if first else ""
    return ";" if line.count(";") > line.count(",") else ","


def read_worksheet(spark: SparkSession, path: str) -> DataFrame:
    """Trimmed header, blank cells as empty texts. Of a workbook (.xlsx, .xlsm) the first sheet is read, on the driver."""
    if path.lower().endswith((".xlsx", ".xlsm")):
        (found,) = spark.read.format("binaryFile").load(path).where(F.col("length") <= MOST_BYTES).select("content").head(1) or [None]
        if found is None:
            raise ValueError(f"no workbook of at most {MOST_BYTES} bytes at {path}")
        head, rows = sheet(bytes(found.content))
        return spark.createDataFrame(rows, StructType([StructField(h, StringType()) for h in head]))
    raw = spark.read.csv(path, header=True, sep=separator(spark, path), multiLine=True, quote='"', escape='"', inferSchema=False, nullValue="\x00", encoding="UTF-8")
    named = raw.toDF(*(c.replace("﻿", "").strip() for c in raw.columns))
    return named.select(*(F.coalesce(F.col(f"`{c}`"), F.lit("")).alias(c) for c in named.columns))

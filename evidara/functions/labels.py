"""Normalised annotation labels."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Codes of the annotation protocol.
STATUSES = ("S3", "S2", "S1", "S0", "NA")
MEASURES = ("M0", "M1", "M2", "M3", "M4", "M5")
DOMAINS = ("D1", "D2", "D3", "D4", "D5")
GROUND = "^(A([1-9]|1[0-9]|20)|T1198|MAFE)$"


def status(value: Column) -> Column:
    """S0 to S3 or NA; digits and common variants are understood, anything else is null."""
    v = F.regexp_replace(F.upper(F.trim(value)), " ", "")
    v = F.when(v.rlike("^[0-3]$"), F.concat(F.lit("S"), v)).when(v == "N/A", "NA").when(v.isin("NAO", "NÃO", "SO"), "S0").otherwise(v)
    return F.when(v.isin(*STATUSES), v)


def measure(value: Column) -> Column:
    v = F.regexp_replace(F.upper(F.trim(value)), " ", "")
    v = F.when(v.rlike("^[0-5]$"), F.concat(F.lit("M"), v)).otherwise(v)
    return F.when(v.isin(*MEASURES), v)


def codes(value: Column) -> Column:
    """Upper-case parts between ';', ',' and '/', empty ones left out."""
    return F.filter(F.transform(F.split(F.coalesce(value, F.lit("")), "[;,/]"), lambda p: F.upper(F.trim(p))), lambda p: p != "")


def grounds(value: Column) -> Column:
    """Known ground codes, each once and in order."""
    return F.array_distinct(F.filter(codes(value), lambda p: p.rlike(GROUND)))

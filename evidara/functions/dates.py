"""Date parsers of the sources. All are null on bad input, none depends on the session's time zone."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def stamp14(value: Column) -> Column:
    """yyyyMMddHHmmss with any separators; at least eight digits, the rest padded with zeros."""
    d = F.regexp_replace(value.cast("string"), r"\D", "")
    padded = F.substring(F.rpad(d, 14, "0"), 1, 14)
    split = F.regexp_replace(padded, r"^(\d{4})(\d\d)(\d\d)(\d\d)(\d\d)(\d\d)$", "$1-$2-$3 $4:$5:$6")
    return F.when(F.length(d) >= 8, split.try_cast("timestamp_ntz"))


def iso_seconds(value: Column) -> Column:
    """ISO date and time to the second; fractions and zones are ignored."""
    head = F.regexp_extract(value.cast("string"), r"^\d{4}-\d{2}-\d{2}[T ]\d{2}:\d{2}:\d{2}", 0)
    return F.when(head != "", head.try_cast("timestamp_ntz"))


def metadata_date(value: Column) -> Column:
    """Epoch milliseconds (11 digits or more; three hours west of UTC) or an ISO date in the first ten characters."""
    s = F.trim(value.cast("string"))
    days = F.floor((s.try_cast("bigint") / 1000 - 3 * 3600) / 86400).cast("int")
    iso = F.substring(s, 1, 10)
    iso = F.when(iso.rlike(r"^\d{8}$"), F.regexp_replace(iso, r"^(\d{4})(\d\d)(\d\d)$", "$1-$2-$3")).when(iso.rlike(r"^\d{4}-\d{2}-\d{2}$"), iso)
    return F.when(s.rlike(r"^\d{11,}$"), F.date_add(F.lit("1970-01-01").cast("date"), days)).otherwise(iso.try_cast("date"))


def publication(value: Column) -> Column:
    """Struct journal, published of a text such as 'DJE        DATA:19/06/2024'."""
    day = F.regexp_extract(value, r"DATA:\s*(\d{2}/\d{2}/\d{4})", 1)
    journal = F.get(F.split(value, r"\s+"), F.lit(0))
    return F.struct(F.when(journal != "", journal).alias("journal"), F.when(day != "", F.try_to_date(day, "dd/MM/yyyy")).alias("published"))


def compact_date(value: Column) -> Column:
    """Exactly eight digits, yyyyMMdd."""
    return F.when(value.rlike(r"^\d{8}$"), F.regexp_replace(value, r"^(\d{4})(\d\d)(\d\d)$", "$1-$2-$3").try_cast("date"))


def worksheet_date(value: Column) -> Column:
    """2026-10-02, 02/10/2026, 02/10/26 or 2026/10/02, a time after it ignored."""
    v = F.trim(value)
    head, word = F.substring(v, 1, 10), F.get(F.split(v, r"\s+"), F.lit(0))
    tried = [
        F.when(head.rlike(r"^\d{4}-\d{1,2}-\d{1,2}$"), F.try_to_date(head, "yyyy-M-d")),
        F.when(word.rlike(r"^\d{1,2}/\d{1,2}/\d{4}$"), F.try_to_date(word, "d/M/yyyy")),
        F.when(word.rlike(r"^\d{1,2}/\d{1,2}/\d{2}$"), F.try_to_date(word, "d/M/yy")),
        F.when(head.rlike(r"^\d{4}/\d{1,2}/\d{1,2}$"), F.try_to_date(head, "yyyy/M/d")),
    ]
    return F.coalesce(*tried)


def days_between(first: Column, last: Column) -> Column:
    """Calendar days from first to last: midnights passed, not whole days elapsed."""
    return F.datediff(last, first)

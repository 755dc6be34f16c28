import datetime as dt

import pytest
from pyspark.sql import functions as F

from evidara.functions import casenumber, dates, labels, parsing, text


def values(spark, column, *given):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(given)], "i int, v string")
    return [r[0] for r in df.select(column(F.col("v")).alias("x"), "i").orderBy("i").collect()]


@pytest.mark.parametrize(
    ("digits", "court", "year"),
    [("10615145420258260100", "8.26", 2025), ("08134596420268140000", "8.14", 2026), ("00000371120134058402", "4.05", 2013), ("00445025320144013400", "4.01", 2014)],
)
def test_case_numbers(spark, digits, court, year):
    good, bad, short = values(spark, casenumber.case_number, digits, digits[:7] + "00" + digits[9:], "123")
    assert (good.tribunal, good.year, good.valid, good.digits) == (court, year, True, digits)
    assert good.formatted == f"{digits[:7]}-{digits[7:9]}.{digits[9:13]}.{digits[13]}.{digits[14:16]}.{digits[16:]}"
    assert not bad.valid and short is None


def test_odd_case_numbers(spark):
    """No number, and texts of 20 digits among others, or of digits that are not ASCII."""
    none, empty, more, among, foreign = values(spark, casenumber.case_number, None, "", "1" * 21, " 1061514-54.2025.8.26.0100x", "٠" * 20)
    assert none is None and empty is None and more is None and foreign is None
    assert (among.digits, among.segment, among.origin, among.valid) == ("10615145420258260100", "8", "0100", True)
    assert values(spark, casenumber.endpoint_alias, None, "") == [None, None] and values(spark, casenumber.segment_name, None) == ["desconhecido"]


def test_segments_and_aliases(spark):
    assert values(spark, casenumber.segment_name, "8", "0") == ["Justiça Estadual", "desconhecido"]
    assert values(spark, casenumber.endpoint_alias, "8.26", "4.06", "9.13") == ["api_publica_tjsp", "api_publica_trf6", None]
    assert len(casenumber.ALIASES) == 34


def test_dates(spark):
    assert values(spark, dates.stamp14, "20221022085739", "20240325", "99999999999999", "", None) == [dt.datetime(2022, 10, 22, 8, 57, 39), dt.datetime(2024, 3, 25), None, None, None]
    assert values(spark, dates.metadata_date, "1686711600000", "2023-06-14T00:00", "20230614", "x") == [dt.date(2023, 6, 14)] * 3 + [None]
    assert values(spark, dates.compact_date, "20240617", "20240231", "2024") == [dt.date(2024, 6, 17), None, None]
    assert values(spark, dates.iso_seconds, "2026-07-02T14:55:29.000Z", "2026-13-02T00:00:00", "no") == [dt.datetime(2026, 7, 2, 14, 55, 29), None, None]
    one, two = values(spark, dates.publication, "DJE        DATA:19/06/2024", "DJE DATA:99/06/2024")
    assert tuple(one) == ("DJE", dt.date(2024, 6, 19)) and tuple(two) == ("DJE", None)
    assert values(spark, dates.worksheet_date, "2026-10-02", "02/10/2026", "02/10/26", "2026/10/02", "2026-10-02 14:30", "soon", "") == [dt.date(2026, 10, 2)] * 5 + [None] * 2


def test_texts(spark):
    assert values(spark, text.subject_leaves, "1.9596,2.7,3.9596", "3372;014689, x", None, "None") == ["9596;7", "3372;14689", None, None]
    assert values(spark, text.clean_placeholder, " None ", "-", "NaN", "a ") == [None, None, None, "a"]
    assert values(spark, text.file_key, "/x/textos20230614.zip", "metadados202202.json", "none") == ["20230614", "202202", None]
    assert values(spark, text.fold_accents, "PETIÇÕES ção ñ") == ["PETICOES cao n"]


def test_marks_and_spaces(spark):
    """Of any script; what SQL's functions do where they differ."""
    assert values(spark, text.fold_accents, "\u1ea1\u03ac\u0439", "e\u0301", "\ud55c", None) == ["a\u03b1\u0438", "e", "\ud55c", None]
    assert values(spark, text.strip_marks, "\ud55c\u0301", "a\u0903", None) == ["\u1112\u1161\u11ab", "a\u0903", None]
    assert values(spark, lambda v: text.strip_marks(v, sql=True), "\u1112\u1161\u11ab", "a\u0903", None) == ["\ud55c", "a", None]
    assert values(spark, text.collapse, "a\u00a0\x0bb ") == ["a b"] and values(spark, lambda v: text.collapse(v, sql=True), "a\t\nb\u00a0c\u00a0") == ["a b\u00a0c"]
    assert values(spark, text.clean, "\u00a0None\u3000", "\u00a0x") == [None, "x"]


def test_labels(spark):
    assert values(spark, labels.status, "s3", "2", "N/A", "NÃO", "x", "", None) == ["S3", "S2", "NA", "S0", None, None, None]
    assert values(spark, labels.grounds, "A11; a12 ,T1198/A11;A99", None) == [["A11", "A12", "T1198"], []]
    assert values(spark, labels.measure, "m3", "4", "M9") == ["M3", "M4", None]


def test_parsed_fields():
    assert parsing.items_of("['a', 'None', 'b']") == ["a", "b"] and parsing.items_of("[broken") == ["[broken"] and parsing.items_of("None") == []
    one, two = parsing.citations_of("STJ (tema de exemplo) - <<REsp  1816742>>-SP e STF <<RE 1>>")
    assert one == {"court": "STJ", "reference": "REsp 1816742", "uf": "SP", "topic": "tema de exemplo"}
    assert two["court"] == "STF" and two["uf"] is None
    a, b = parsing.laws_of("['LEG:FED LEI:010406 ANO:2002 ART:00966 PAR:00001 LEG:FED LEI:013105']")
    assert (a["number"], a["year"], a["articles"], b["number"], b["year"]) == ("10406", "2002", "ART:00966;PAR:00001", "13105", None)
    assert parsing.laws_of("nothing")[0]["number"] is None

import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).parent))
from oracle import assert_same, database  # noqa: E402

from evidara.plans import ORACLE_SQL, QUERIES  # noqa: E402


@pytest.fixture(scope="module")
def tables(small):
    return database(small)


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query_matches_sql(spark, small, tables, name):
    assert_same(QUERIES[name](spark, small), tables, ORACLE_SQL[name])


def test_every_query_has_its_sql():
    assert set(QUERIES) == set(ORACLE_SQL)


def test_entry(spark):
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert set(QUERIES) <= set(entry.queries())
    assert entry.entry(spark).count() > 0


def test_odd_texts_match_sql(spark, tmp_path):
    """Scripts other than Latin, loose marks, Hangul in letters, wide and odd white space, placeholders, empty and null texts and ids."""
    import pyarrow as pa
    import pyarrow.parquet as pq

    odd = [
        None, "", " ", " \t\n ", "None", " null ", "NaN", " - ", "\u00a0", "\u3000x\u00a0", "\u00a0a\u00a0 \u2003b\u2028c\x0bd\x85e", "e\u0301\u0323", "\u0301a", "\u03ac\u0439\u1ea1\u0958\u2126\u212b", "\u1112\u1161\u11ab \uae00",
        "\u1112\u0301\u1161", "a\u0488\u0903", "\U0001d15e", "\ufb01 \u24d0", "a\tb\r\f c",
    ]
    texts = [x for x in odd for _ in range(5)] + ["\u00e9 x", "y"]
    ids = [*range(5 * len(odd)), 123456789, None]
    n = len(ids)
    pq.write_table(pa.table({"doc_id": pa.array(ids, pa.int64()), "text": texts, "lang": ["en"] * n, "source": ["s"] * n, "n_chars": [0] * n}), tmp_path / "documents.parquet")
    assert assert_same(QUERIES["text_functions"](spark, str(tmp_path)), database(str(tmp_path)), ORACLE_SQL["text_functions"]) == n

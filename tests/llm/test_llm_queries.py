import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).parents[1]))
from oracle import assert_same, database  # noqa: E402

from evidara.llm.queries import ORACLE_SQL, QUERIES  # noqa: E402

COLUMNS = {
    "op1_topk": "query_id:bigint rank:int vec_id:bigint score:bigint",
    "op2_winnowing": "doc_id:bigint n_words:bigint n_hit:bigint n_items:bigint items_sha256:string contaminated:boolean",
    "op3_substrings": "doc_id:bigint n_words:bigint n_removed:bigint kept_sha256:string",
    "op4_crf": "doc_id:bigint held_out:boolean score:double predicted:int",
    "op5_warc": "page_id:bigint payload_bytes:bigint payload_digest:string record_type:string refers_to:bigint",
    "op6_bootstrap": "doc_id:bigint n_email:bigint n_ip:bigint n_card:bigint n_phone:bigint base_sha256:string spans:string",
    "op7_cnn": "doc_id:bigint held_out:boolean score:double predicted:int",
    "op8_tokens": "doc_id:bigint start:bigint n_tokens:bigint ids_crc32:bigint",
    "op9_mixing": "doc_id:bigint size:bigint source_size:bigint target:double taken:bigint",
    "op10_simhash": "doc_id:bigint fingerprint:string component_id:bigint",
    "op11_viterbi": "conv_id:bigint gaps:bigint blank:bigint duplicate:bigint truncated:bigint illegal:bigint cost:bigint audit:string repaired_sha256:string",
    "op12_alignment": "doc_id:bigint n_a:bigint n_b:bigint n_groups:bigint n_links:bigint n_best:bigint count_sum:bigint groups_sha256:string",
    "op13_minhash": "doc_id:bigint n_shingles:bigint component_id:bigint kept:boolean",
}


def test_all_of_them():
    assert sorted(QUERIES) == sorted(COLUMNS)


@pytest.mark.parametrize("name", sorted(COLUMNS))
def test_columns_and_rows(spark, small, name):
    df = QUERIES[name](spark, small)
    assert [f"{c}:{k}" for c, k in df.dtypes] == COLUMNS[name].split()
    if name in ORACLE_SQL:
        assert assert_same(df, database(small), ORACLE_SQL[name]) > 0
    elif name != "op1_topk":
        assert df.count() == spark.read.parquet(f"{small}/documents.parquet").count()

"""Queries of the training-data operators over the driver's tables, and the SQL that must give the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import alignment, conversations, decontaminate, minhash, mixing, pii, quality, simhash, substrings, token_files, topk, toxicity, warc
from .common import table


def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of all documents whose 3-word SimHash fingerprints differ in two bits at most."""
    return simhash.simhash_groups(table(spark, sf_dir, "documents"))


def word_tokenizer() -> str:
    """The path of the vocabulary file that op8 and the pipeline encode with."""
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op1_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten best other vectors of every hundredth vec_id, by integer inner product."""
    return topk.top_k(table(spark, sf_dir, "embeddings"))


def op2_winnowing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of each document that stand in ten-word windows of benchmark items, and the items."""
    return decontaminate.decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).drop("items")


def op3_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document without the words of 20-word windows that start earlier."""
    return substrings.remove_repeats(table(spark, sf_dir, "documents"))


def op4_crf(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of each document, learned from labels outside its fold."""
    return toxicity.toxicity_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")).drop("spans")


def op5_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each page as written to archives and read back, repeated payloads as revisits."""
    return warc.archive_round_trip(table(spark, sf_dir, "pages"))


def op6_bootstrap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data of each document: base spans, and with those that contexts add."""
    return pii.personal_data(table(spark, sf_dir, "documents"))


def op7_cnn(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality of each document, learned from labels outside its fold."""
    return quality.quality_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op8_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document in the token files: where it starts, how many ids, their checksum."""
    return token_files.token_output(table(spark, sf_dir, "documents"), word_tokenizer())


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of each document that the mix by source weights takes."""
    return mixing.mix(table(spark, sf_dir, "documents"))


def op11_viterbi(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every conversation, damaged by its rows' checksums: faults, cheapest repair, digest of the repaired turns."""
    return conversations.repair_report(table(spark, sf_dir, "conversations"))


def op12_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document under two tokenizers: token groups, links between ids, and how common these are."""
    import public_tokenizers

    return alignment.align(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")).documents


def op13_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of all documents whose sets of 2-word shingles have a similarity of 0.8 or more."""
    return minhash.minhash_groups(table(spark, sf_dir, "documents"))


QUERIES = {
    "op1_topk": op1_topk,
    "op2_winnowing": op2_winnowing,
    "op3_substrings": op3_substrings,
    "op4_crf": op4_crf,
    "op5_warc": op5_warc,
    "op6_bootstrap": op6_bootstrap,
    "op7_cnn": op7_cnn,
    "op8_tokens": op8_tokens,
    "op9_mixing": op9_mixing,
    "op10_simhash": op10_simhash,
    "op11_viterbi": op11_viterbi,
    "op12_alignment": op12_alignment,
    "op13_minhash": op13_minhash,
}
ORACLE_SQL: dict[str, str] = {"op1_topk": topk.ORACLE, "op2_winnowing": decontaminate.ORACLE, "op3_substrings": substrings.ORACLE, "op5_warc": warc.ORACLE, "op9_mixing": mixing.ORACLE, "op11_viterbi": conversations.ORACLE}

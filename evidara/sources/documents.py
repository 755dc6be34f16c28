"""Document metadata (drifting JSON) and document texts (ZIP of .txt members)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .. import schemas
from ..functions.dates import metadata_date
from ..functions.hashing import pseudonym24
from ..functions.text import clean, file_key, fold_accents, subject_leaves, to_ascii
from . import zip_members
from .records import read_records


def read_metadata(spark: SparkSession, path: str, salt: bytes) -> DataFrame:
    """schemas.DOCUMENTS of metadata files. Field names match without case or accents; NM_MINISTRO is ministro."""
    r = read_records(spark, path)
    # Two spellings of one field in one record would clash as map keys; the last one wins.
    entries = F.transform(F.map_entries("record"), lambda e: F.struct(F.lower(fold_accents(e["key"])).alias("key"), e["value"].alias("value")))
    entries = F.transform(entries, lambda e: F.struct(F.when(e["key"] == "nm_ministro", "ministro").otherwise(e["key"]).alias("key"), e["value"].alias("value")))
    r = r.withColumn("e", entries)
    field = lambda name: F.element_at(F.filter("e", lambda e: e["key"] == name), -1)["value"]
    has = lambda name: F.when(F.exists("e", lambda e: e["key"] == name), clean(field(name)))
    seq, case = has("seqdocumento"), has("processo")
    kind = F.regexp_extract(case, "^[A-Za-z]+", 0)
    return r.select(
        F.when(seq.rlike(r"^\d+$"), seq.try_cast("bigint")).alias("seq_documento"),
        file_key(F.col("source_file")).alias("key"),
        metadata_date(has("datapublicacao")).alias("data_publicacao"),
        F.nullif(F.upper(to_ascii(has("tipodocumento"))), F.lit("")).alias("tipo_documento"),
        has("numeroregistro").alias("numero_registro"),
        case.alias("processo"),
        F.when(kind != "", kind).alias("classe"),
        metadata_date(has("datarecebimento")).alias("data_recebimento"),
        metadata_date(has("datadistribuicao")).alias("data_distribuicao"),
        pseudonym24(has("ministro"), salt).alias("relator_hash"),
        *(has(n).alias(a) for n, a in (("recurso", "recurso"), ("teor", "teor"), ("descricaomonocratica", "descricao_monocratica"), ("assuntos", "assuntos_raw"))),
        subject_leaves(has("assuntos")).alias("assuntos_leaf"),
        "source_file",
    ).to(schemas.DOCUMENTS)


def read_texts(spark: SparkSession, path: str) -> DataFrame:
    """schemas.DOCUMENT_TEXT of ZIP files, members read in tasks of their own; of members with one number in a file the first stays."""
    base, number = F.element_at(F.split("member", "/"), -1), F.regexp_extract(F.element_at(F.split("member", "/"), -1), r"\d+", 0)
    named = zip_members.members(spark, path).where(F.lower("member").endswith(".txt") & base.rlike(r"\d"))
    named = named.withColumn("seq_documento", number.cast("bigint"))
    first = Window.partitionBy("file", "seq_documento").orderBy("place")
    wanted = named.withColumn("n", F.row_number().over(first)).where("n = 1")

    # In the JVM: an Arrow batch of another worker would hold thousands of texts, whatever their bytes.
    decoded = F.make_valid_utf8(F.col("content").cast("string"))
    text = F.replace(F.regexp_replace(decoded, r"(?i)<br\s*/?>", "\n"), F.lit("\r"), F.lit(""))
    rows = zip_members.contents(wanted).withColumn("text", text)
    key = F.nullif(F.regexp_extract(F.element_at(F.split("file", "/"), -1), r"\d{6,8}", 0), F.lit(""))
    return rows.select(
        F.regexp_extract(F.element_at(F.split("member", "/"), -1), r"\d+", 0).cast("bigint").alias("seq_documento"), key.alias("key"), "member",
        F.length("text").cast("bigint").alias("nchar"), F.sha2("content", 256).alias("text_sha256"), "text",
    ).select(*schemas.DOCUMENT_TEXT.names).to(schemas.DOCUMENT_TEXT)


def kept_texts(texts: DataFrame, documents: DataFrame) -> DataFrame:
    """Texts whose number is in the metadata."""
    return texts.join(documents.select("seq_documento"), "seq_documento", "left_semi")

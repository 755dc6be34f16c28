"""Readers of the published sources, over files that are first written from the tables in the sources' own shapes."""

from __future__ import annotations

import zipfile
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import trajectory
from ..session import scratch
from ..sources import cases, decisions, documents, links, records
from .scalars import _D, _STATES, case_text
from .tables import table

SALT = b"salt"


def _json(df: DataFrame, name: str, gz: bool = False) -> str:
    """The path of df as JSON lines, fields without a value left out."""
    path = scratch(df.sparkSession, name)
    writer = df.write.option("compression", "gzip") if gz else df.write
    writer.json(path)
    return f"{path}/part-*"


def _links(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    i = F.col("o_orderkey")
    path = _json(
        o.select(
            case_text().alias("numeroUnico"), F.when(i % 6 > 0, F.concat(F.lit(" "), F.col("o_custkey").cast("string"))).alias("numeroRegistro"), F.lit("AREsp").alias("siglaClasse"),
            F.when(i % 2 == 0, F.date_format("o_orderdate", "yyyyMMdd")).otherwise(F.lit("")).alias("dataUltimaDistribuicao"), F.lit("someone").alias("nomeParte"), F.lit("a minister").alias("nomeMinistroRelator"),
        ), "links-json",
    )
    found = links.read_links(spark, path, "acervo", SALT)
    return found.groupBy("numero_registro", "cnj_digits", "cnj_valid", "cnj_year", "tribunal", "datajud_alias", "sigla_classe", "data_distribuicao").agg(F.count("*").alias("n"))


def _metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("doc_id")
    even = i % 2 == 0
    path = _json(
        table(spark, sf_dir, "documents").select(
            i.alias("SeqDocumento"), F.when(even, F.date_format(F.date_add(F.lit("2021-01-01").cast("date"), (i % 700).cast("int")), "yyyy-MM-dd")).alias("dataPublicacao"),
            F.when(~even, F.lit(1686711600000) + i % 50 * 86400000).alias("dataPublicação"), F.concat(F.lit("AREsp "), i.cast("string")).alias("processo"), F.when(i % 3 == 0, F.lit("ACÓRDÃO")).otherwise(F.lit("null")).alias("tipoDocumento"),
            F.concat(F.lit("7.10."), (i % 90).cast("string"), F.lit(",3372")).alias("assuntos"), F.lit("Ação").alias("NM_MINISTRO"),
        ), "metadata-json", gz=True,
    )
    return documents.read_metadata(spark, path, SALT).select("seq_documento", "data_publicacao", "tipo_documento", "processo", "classe", "assuntos_leaf", (F.length("relator_hash") == 24).alias("hashed"))


def _decisions(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    i = F.col("doc_id")
    text = i.cast("string")
    path = _json(
        table(spark, sf_dir, "documents").select(
            F.when(i % 4 > 0, text).alias("id"), F.when(i % 3 > 0, F.concat(F.lit("r"), text)).alias("numeroRegistro"), F.when(i % 5 > 0, F.col("text")).otherwise(F.lit(" - ")).alias("ementa"),
            F.concat(F.lit("DJE        DATA:"), F.date_format(F.date_add(F.lit("2020-01-31").cast("date"), (i % 500).cast("int")), "dd/MM/yyyy")).alias("dataPublicacao"), F.when(i % 7 > 0, F.lit("20240229")).otherwise(F.lit("20230229")).alias("dataDecisao"),
            F.when(i % 2 == 0, F.concat(F.lit("(um tema longo) STJ <<REsp "), text, F.lit(">>-SP <<HC 1>>"))).alias("jurisprudenciaCitada"), F.when(i % 3 == 1, F.concat(F.lit("['LEG:FED LEI:0"), text, F.lit(" ART:1', 'x']"))).alias("referenciasLegislativas"),
        ), "decisions-json",
    )
    return decisions.read_decisions(spark, path, "corte", SALT)


def _decision_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = _decisions(spark, sf_dir)[0]
    return d.select("espelho_id", "numero_registro", F.length("ementa").cast("bigint").alias("chars"), "journal", "data_publicacao", "data_decisao", "n_citations", "n_legislation")


def _decision_children(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, cited, laws = _decisions(spark, sf_dir)
    of = lambda rows, kind, value: rows.select("espelho_id", F.lit(kind).alias("kind"), F.col(value).alias("value"))
    return of(cited, "citation", "reference").union(of(laws, "law", "number"))


def _large_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders from pretty-printed JSON, each file read in ranges of 128 KB by as many tasks."""
    path = scratch(spark, "large-json")
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", F.struct("o_orderstatus", F.concat(F.lit('}"{\\'), F.col("o_orderpriority")).alias("odd")).alias("deep"))
    o.select(F.to_json(F.struct("*"), {"pretty": "true"})).write.option("lineSep", ",\n").text(path)
    r = records.read_large_records(spark, f"{path}/part-*", 128 << 10).select("record")
    deep = F.from_json(F.col("record")["deep"], "o_orderstatus string, odd string")
    return r.select(F.col("record")["o_orderkey"].cast("bigint").alias("o_orderkey"), F.col("record")["o_custkey"].cast("bigint").alias("o_custkey"), deep["o_orderstatus"].alias("status"), deep["odd"].alias("odd"))


def _texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents from ZIP archives of some 100 members, read by members; a second member of a number, and others' kinds, are left out."""
    folder = scratch(spark, "zip-texts")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        context, archive = TaskContext.get(), None
        store, root = fs.FileSystem.from_uri(folder)
        store.create_dir(root, recursive=True)
        name = f"{root}/2024{context.partitionId():04d}.zip"
        draft = f"{root}/.{context.taskAttemptId()}.draft"  # an archive has its name once it is whole, whichever attempt made it
        with store.open_output_stream(draft) as out, zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as archive:
            for b in batches:
                for i, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                    archive.writestr(f"texts/{i}.txt", text or "", zipfile.ZIP_STORED if i % 3 == 0 else zipfile.ZIP_DEFLATED)
                    if i % 10 == 0:
                        archive.writestr(f"again/{i}.TXT", "a later one")
                        archive.writestr(f"texts/{i}.pdf", "no text")
        store.move(draft, name)
        yield pa.RecordBatch.from_pydict({"name": [name]})

    docs = table(spark, sf_dir, "documents").select("doc_id", F.concat_ws("<BR />\r", "lang", "text").alias("text"))
    parts = max(1, docs.count() // 100)
    docs.repartition(parts, F.floor(F.col("doc_id") / 100)).mapInArrow(write, "name string").write.format("noop").mode("overwrite").save()
    found = documents.read_texts(spark, f"{folder}/*.zip")
    return found.select("seq_documento", "nchar", "text_sha256", F.md5("text").alias("text_md5"), (F.length("key") == 8).alias("keyed"))


def _source(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events of each user as a case document of the index, movements out of order and some of them undated."""
    e = table(spark, sf_dir, "events")
    named = lambda code: F.struct(code.alias("codigo"), F.lit("org").alias("nome"))
    stamp: Column = F.when(F.col("event_id") % 10 > 0, F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.000'Z'"))
    move = F.struct(
        (F.col("event_id") % 100).cast("string").alias("codigo"), F.col("event_type").alias("nome"), stamp.alias("dataHora"),
        F.array(F.struct(F.lit("7").alias("codigo"), F.col("event_id").cast("string").alias("valor"))).alias("complementosTabelados"), named(F.lit(" 55 ")).alias("orgaoJulgador"),
    )
    place = F.pmod(F.col("event_id") * 7919, F.lit(10_007))
    grouped = e.groupBy("user_id").agg(F.array_sort(F.collect_list(F.struct(place.alias("place"), "event_id", move.alias("m")))).alias("moves"))
    empty = lambda kind: F.lit(None).cast(kind)
    pair = "struct<codigo: string, nome: string>"
    return grouped.select(
        F.concat(F.lit("es"), F.col("user_id").cast("string")).alias("id"), F.col("user_id").cast("string").alias("numeroProcesso"), F.lit("TJSP").alias("tribunal"), F.lit("G1").alias("grau"),
        F.lit("20200102030405").alias("dataAjuizamento"), F.lit(0).alias("nivelSigilo"), empty(pair).alias("classe"), empty(f"array<{pair}>").alias("assuntos"),
        empty("struct<codigo: string, nome: string, codigoMunicipioIBGE: string>").alias("orgaoJulgador"), empty(pair).alias("sistema"), empty(pair).alias("formato"),
        empty("string").alias("dataHoraUltimaAtualizacao"), F.transform("moves", lambda x: x["m"]).alias("movimentos"),
    )


def _movements(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cases.movements(_source(spark, sf_dir), "tjsp").select("es_id", "ordem", "codigo", "nome", "data_hora", "orgao_codigo", "complementos")


def _filing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Days from filing to the last event, only where both dates make sense."""
    last = table(spark, sf_dir, "events").groupBy("user_id").agg(F.max("ts").alias("last"))
    i = F.col("c_custkey")
    filed = F.when(i % 5 == 0, F.lit("1989-06-01 00:00:00")).when(i % 7 == 0, F.lit("2031-01-01 00:00:00")).when(i % 3 > 0, F.lit("2001-02-03 04:05:06")).cast("timestamp_ntz")
    c = table(spark, sf_dir, "customer").select(i.alias("user_id"), filed.alias("filed")).join(last, "user_id", "left")
    return c.select("user_id", trajectory.since_filing(F.col("filed"), F.col("last").cast("timestamp_ntz")).alias("days"))


QUERIES = {"read_links": _links, "read_metadata": _metadata, "read_large_json": _large_json, "read_texts": _texts, "read_decisions": _decision_rows, "read_decision_children": _decision_children, "read_movements": _movements, "filing_plausibility": _filing}

_ID = "CASE WHEN doc_id % 4 > 0 THEN doc_id::VARCHAR WHEN doc_id % 3 > 0 THEN 'corte:r' || doc_id END"
ORACLE_SQL = {
    "read_links": f"""SELECT o_custkey::VARCHAR AS numero_registro, d AS cnj_digits, substr(d, 8, 2)::INT = 98 - ((substr(d, 1, 7) || substr(d, 10, 11) || '00')::HUGEINT % 97) AS cnj_valid, substr(d, 10, 4)::INT AS cnj_year, substr(d, 14, 1) || '.' || substr(d, 15, 2) AS tribunal,
        CASE WHEN substr(d, 14, 3) BETWEEN '801' AND '827' THEN 'api_publica_tj' || {_STATES}[substr(d, 15, 2)::INT] WHEN substr(d, 14, 3) BETWEEN '401' AND '406' THEN 'api_publica_trf' || substr(d, 16, 1) WHEN substr(d, 14, 3) = '300' THEN 'api_publica_stj' END AS datajud_alias,
        'AREsp' AS sigla_classe, CASE WHEN o_orderkey % 2 = 0 THEN strftime(o_orderdate, '%Y%m%d') END AS data_distribuicao, count(*) AS n FROM (SELECT *, {_D} AS d FROM orders) WHERE d IS NOT NULL AND o_orderkey % 6 > 0 GROUP BY ALL""",
    "read_metadata": """SELECT doc_id AS seq_documento, CASE WHEN doc_id % 2 = 0 THEN DATE '2021-01-01' + (doc_id % 700)::INT ELSE DATE '2023-06-14' + (doc_id % 50)::INT END AS data_publicacao, CASE WHEN doc_id % 3 = 0 THEN 'ACORDAO' END AS tipo_documento, 'AREsp ' || doc_id AS processo, 'AREsp' AS classe,
        doc_id % 90 || ';3372' AS assuntos_leaf, true AS hashed FROM documents""",
    "read_large_json": """SELECT o_orderkey, o_custkey, o_orderstatus AS status, '}"{\\' || o_orderpriority AS odd FROM orders""",
    "read_texts": """SELECT doc_id AS seq_documento, length(t)::BIGINT AS nchar, sha256(concat_ws('<BR />' || chr(13), lang, text)) AS text_sha256, md5(t) AS text_md5, true AS keyed
        FROM (SELECT *, replace(regexp_replace(concat_ws('<BR />' || chr(13), lang, text), '<br\\s*/?>', chr(10), 'gi'), chr(13), '') AS t FROM documents)""",
    "read_decisions": f"""SELECT {_ID} AS espelho_id, CASE WHEN doc_id % 3 > 0 THEN 'r' || doc_id END AS numero_registro, CASE WHEN doc_id % 5 > 0 AND trim(text) <> '' THEN length(trim(text)) END AS chars, 'DJE' AS journal, DATE '2020-01-31' + (doc_id % 500)::INT AS data_publicacao,
        CASE WHEN doc_id % 7 > 0 THEN DATE '2024-02-29' END AS data_decisao, CASE WHEN doc_id % 2 = 0 THEN 2 ELSE 0 END AS n_citations, CASE WHEN doc_id % 3 = 1 THEN 2 ELSE 0 END AS n_legislation FROM documents WHERE {_ID} IS NOT NULL""",
    "read_decision_children": f"""SELECT {_ID} AS espelho_id, 'citation' AS kind, unnest(['REsp ' || doc_id, 'HC 1']) AS value FROM documents WHERE doc_id % 2 = 0 AND {_ID} IS NOT NULL
        UNION ALL SELECT {_ID}, 'law', unnest([doc_id::VARCHAR, NULL]) FROM documents WHERE doc_id % 3 = 1 AND {_ID} IS NOT NULL""",
    "read_movements": """SELECT 'es' || user_id AS es_id, (row_number() OVER (PARTITION BY user_id ORDER BY event_id % 10 = 0, CASE WHEN event_id % 10 > 0 THEN date_trunc('second', ts) END, event_id * 7919 % 10007, event_id))::INT AS ordem, (event_id % 100)::INT AS codigo, event_type AS nome,
        CASE WHEN event_id % 10 > 0 THEN date_trunc('second', ts) END AS data_hora, '55' AS orgao_codigo, '7:' || event_id AS complementos FROM events WHERE user_id IS NOT NULL""",
    "filing_plausibility": """SELECT c_custkey AS user_id, CASE WHEN c_custkey % 5 = 0 OR c_custkey % 7 = 0 OR c_custkey % 3 = 0 THEN NULL ELSE date_diff('day', DATE '2001-02-03', last::DATE) END::BIGINT AS days
        FROM customer LEFT JOIN (SELECT user_id, max(ts) AS last FROM events GROUP BY 1) ON user_id = c_custkey""",
}

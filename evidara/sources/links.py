"""Links between registry numbers and case numbers, from a snapshot (acervo) or distribution minutes (ata)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schemas
from ..functions.casenumber import case_number, endpoint_alias
from ..functions.hashing import pseudonym32
from .records import read_records

# The only fields that are read from each source, beside the rapporteur's name, which is hashed.
SNAPSHOT_FIELDS = tuple(
    "numeroUnico numeroRegistro Data siglaClasse codigoClasseCNJ numeroNaClasse processo dataRecebimento codigoOrgaoJulgador codigoAssuntoCNJ "
    "listaAssuntos segredoJustica pedidoDeLiminar sobrestado localProcesso origem UF dataUltimaDecisao dataPublicacao dataUltimaDistribuicao".split()
)
MINUTES_FIELDS = tuple(
    "numeroUnico numeroRegistro dataHoraDistribuicao descFormaDistribuicao codigoClasse siglaClasse codigoClasseCNJ numeroNaClasse codigoDestino "
    "descDestino codigoOrgaoJulgador codigoAssuntoCNJ".split()
)
NAME = "nomeMinistroRelator"


def link_fields(records: DataFrame, source: str, salt: bytes) -> DataFrame:
    """schemas.BRIDGE of records (source_file, record): rows without both ids or with a case number that has not 20 digits go."""
    allowed = SNAPSHOT_FIELDS if source == "acervo" else MINUTES_FIELDS
    get: dict[str, Column] = {k: F.try_element_at("record", F.lit(k)) if k in (*allowed, NAME) else F.lit(None).cast("string") for k in (*SNAPSHOT_FIELDS, *MINUTES_FIELDS, NAME)}
    text = lambda k: F.nullif(F.trim(get[k]), F.lit(""))
    r = records.select("source_file", text("numeroRegistro").alias("numero_registro"), text("numeroUnico").alias("numero_unico"), "record")
    r = r.withColumn("c", case_number(F.col("numero_unico"))).where("numero_registro IS NOT NULL AND c IS NOT NULL")
    return schemas.without_personal_fields(
        r.select(
            "numero_registro", "numero_unico", F.col("c.digits").alias("cnj_digits"), F.col("c.formatted").alias("cnj_formatted"),
            F.col("c.valid").alias("cnj_valid"), F.col("c.year").alias("cnj_year"), "c.segment", "c.tribunal", F.col("c.origin").alias("origin_unit"),
            endpoint_alias(F.col("c.tribunal")).alias("datajud_alias"), get["siglaClasse"].alias("sigla_classe"),
            get["codigoClasseCNJ"].alias("codigo_classe_cnj"), get["codigoAssuntoCNJ"].alias("codigo_assunto_cnj"),
            text("codigoOrgaoJulgador").alias("codigo_orgao_julgador"), get["UF"].alias("uf"),
            F.coalesce(F.nullif(get["dataUltimaDistribuicao"], F.lit("")), F.nullif(get["dataHoraDistribuicao"], F.lit(""))).alias("data_distribuicao"),
            get["dataRecebimento"].alias("data_recebimento"), get["dataUltimaDecisao"].alias("data_ultima_decisao"),
            pseudonym32(get[NAME], salt).alias("relator_hash"), F.lit(source).alias("source"), "source_file",
        ).to(schemas.BRIDGE)
    )


def read_links(spark: SparkSession, path: str, source: str, salt: bytes, limit: int | None = None) -> DataFrame:
    """Links of one source; personal fields are dropped while files are read."""
    allowed = SNAPSHOT_FIELDS if source == "acervo" else MINUTES_FIELDS
    return link_fields(read_records(spark, path, (*allowed, NAME), limit), source, salt)

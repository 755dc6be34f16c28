"""Published decision summaries: one parent table, and citations and laws as child tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schemas
from ..functions.dates import compact_date, publication
from ..functions.hashing import pseudonym32
from ..functions.parsing import citations, legislation, repr_list
from ..functions.text import clean_placeholder
from .records import read_records

# Column of the stored table for each text field of the source.
FIELDS = {
    "numero_processo": "numeroProcesso", "numero_documento": "numeroDocumento", "sigla_classe": "siglaClasse", "descricao_classe": "descricaoClasse",
    "classe_padronizada": "classePadronizada", "orgao_julgador": "nomeOrgaoJulgador", "tipo_decisao": "tipoDeDecisao", "tema": "tema",
    "tese_juridica": "teseJuridica", "ementa": "ementa", "decisao": "decisao", "notas": "notas",
    "informacoes_complementares": "informacoesComplementares", "termos_auxiliares": "termosAuxiliares",
}


def decision_frames(records: DataFrame, body: str, salt: bytes) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(decisions, citations, laws) of records (source_file, record); records without both ids go."""
    get = lambda k: F.try_element_at("record", F.lit(k))
    own = lambda k: clean_placeholder(get(k))
    r = records.select(
        "source_file", "record", own("numeroRegistro").alias("numero_registro"), own("id").alias("id"),
        citations(get("jurisprudenciaCitada")).alias("cited"), legislation(get("referenciasLegislativas")).alias("laws"), repr_list(get("acordaosSimilares")).alias("similar"),
    ).where("numero_registro IS NOT NULL OR id IS NOT NULL")
    r = r.withColumn("espelho_id", F.coalesce("id", F.concat(F.lit(f"{body}:"), "numero_registro"))).withColumn("orgao_slug", F.lit(body))
    issued = publication(own("dataPublicacao"))
    parent = r.select(
        "espelho_id", "orgao_slug", "numero_registro", *(own(v).alias(k) for k, v in FIELDS.items()), pseudonym32(own("ministroRelator"), salt).alias("relator_hash"),
        issued["journal"].alias("journal"), issued["published"].alias("data_publicacao"), compact_date(own("dataDecisao")).alias("data_decisao"),
        F.size("cited").alias("n_citations"), F.size("laws").alias("n_legislation"), F.size("similar").alias("n_similar"), "source_file",
    )
    head = ["espelho_id", "orgao_slug", "numero_registro"]
    child = lambda c, schema: r.select(*head, F.inline(c)).to(schema)
    return parent.to(schemas.DECISIONS), child("cited", schemas.CITATIONS), child("laws", schemas.LEGISLATION)


def read_decisions(spark: SparkSession, path: str, body: str, salt: bytes, limit: int | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """JSON or ZIP files of one judging body."""
    return decision_frames(read_records(spark, path, limit=limit), body, salt)


def decision_text(decisions: DataFrame) -> DataFrame:
    """Rows to scan: (seq_documento = 0, key = body:id, text of summary, decision, notes and further information)."""
    parts = [F.coalesce(c, F.lit("")) for c in ("ementa", "decisao", "notas", "informacoes_complementares")]
    return decisions.select(F.lit(0).cast("bigint").alias("seq_documento"), F.concat_ws(":", "orgao_slug", "espelho_id").alias("key"), F.concat_ws(" ", *parts).alias("text"))

"""Declared schemas of the stored tables. Timestamps are TIMESTAMP_NTZ: never shifted by a session's zone."""

from __future__ import annotations

from pyspark.sql.types import BooleanType, DateType, IntegerType, LongType, StringType, StructField, StructType, TimestampNTZType

_KINDS = {"string": StringType(), "bigint": LongType(), "int": IntegerType(), "boolean": BooleanType(), "date": DateType(), "timestamp_ntz": TimestampNTZType()}


def flat(columns: str) -> StructType:
    """Schema of 'name kind, name kind'; unlike a DDL string it needs no session."""
    return StructType([StructField(name, _KINDS[kind]) for name, kind in (c.split() for c in columns.split(","))])


# Names and kinds of the stored columns.
_text = lambda names: ", ".join(f"{n} string" for n in names.split())

DOCUMENTS = flat(
    "seq_documento bigint, key string, data_publicacao date, tipo_documento string, numero_registro string, processo string, classe string, "
    "data_recebimento date, data_distribuicao date, relator_hash string, recurso string, teor string, descricao_monocratica string, "
    "assuntos_raw string, assuntos_leaf string, source_file string"
)
DOCUMENT_TEXT = flat("seq_documento bigint, key string, member string, nchar bigint, text_sha256 string, text string")
HITS = flat(
    "seq_documento bigint, key string, pattern_id string, tier string, annex_a string, start bigint, match string, context string, "
    "negated_hint boolean, excluded_by string"
)
CANDIDATES = flat(
    "seq_documento bigint, key string, n_hits bigint, n_patterns bigint, patterns string, tiers string, annex_a_items string, "
    "strict_hit boolean, conduct_hit boolean, sanction_hit boolean, normative_hit boolean, neighbour_hit boolean, negated_all boolean, "
    "n_excluded bigint, is_candidate boolean, lexicon_version string"
)
BRIDGE = flat(
    _text("numero_registro numero_unico cnj_digits cnj_formatted") + ", cnj_valid boolean, cnj_year int, "
    + _text("segment tribunal origin_unit datajud_alias sigla_classe codigo_classe_cnj codigo_assunto_cnj codigo_orgao_julgador uf")
    + ", " + _text("data_distribuicao data_recebimento data_ultima_decisao relator_hash source source_file")
)
DECISIONS = flat(
    _text("espelho_id orgao_slug numero_registro numero_processo numero_documento sigla_classe descricao_classe classe_padronizada orgao_julgador")
    + ", " + _text("relator_hash tipo_decisao journal") + ", data_publicacao date, data_decisao date, "
    + _text("tema tese_juridica ementa decisao notas informacoes_complementares termos_auxiliares")
    + ", n_citations int, n_legislation int, n_similar int, source_file string"
)
CITATIONS = flat(_text("espelho_id orgao_slug numero_registro court reference uf topic"))
LEGISLATION = flat(_text("espelho_id orgao_slug numero_registro sphere kind number year articles raw"))
CASES = flat(
    _text("alias numero_processo tribunal grau es_id") + ", data_ajuizamento timestamp_ntz, nivel_sigilo int, "
    + _text("classe_codigo classe_nome orgao_codigo orgao_nome") + ", municipio_ibge int, " + _text("sistema_nome formato_nome assuntos_codigos assuntos_nomes")
    + ", n_movimentos int, primeiro_movimento timestamp_ntz, ultimo_movimento timestamp_ntz, atualizado_em timestamp_ntz"
)
MOVEMENTS = flat(
    _text("alias numero_processo grau es_id") + ", ordem int, codigo int, nome string, data_hora timestamp_ntz, orgao_codigo string, complementos string"
)
TARGETS = flat("numero_processo string, alias string, grupo string, pub_year string, strict_hit boolean, n_documentos int")

#: Personal fields that no stored table may carry.
FORBIDDEN = frozenset(
    "partes advogados nomeParte numeroCNPJ codigoOAB nomeAdvogado poloAtivo poloPassivo numeroDocumento".split()
)


def without_personal_fields(df):
    """df, or an error if it carries a personal field."""
    if found := FORBIDDEN & set(df.columns):
        raise ValueError(f"personal fields in the output: {sorted(found)}")
    return df

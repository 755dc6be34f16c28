"""Case documents of the court index: request batching, a data source over stored answers, cases and movements."""

from __future__ import annotations

import html
import json
import re
from collections.abc import Callable, Iterator, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from .. import schemas
from ..functions.dates import iso_seconds, stamp14

# The fields that are read from each document, and one that is known and left.
CASE_FIELDS = tuple("id numeroProcesso tribunal grau dataAjuizamento nivelSigilo classe assuntos orgaoJulgador sistema formato dataHoraUltimaAtualizacao movimentos".split())
IGNORED = ("@timestamp",)
NAMED = "struct<codigo: string, nome: string>"
SOURCE = (
    f"id string, numeroProcesso string, tribunal string, grau string, dataAjuizamento string, nivelSigilo int, classe {NAMED}, assuntos array<{NAMED}>, "
    f"orgaoJulgador struct<codigo: string, nome: string, codigoMunicipioIBGE: string>, sistema {NAMED}, formato {NAMED}, dataHoraUltimaAtualizacao string, "
    f"movimentos array<struct<codigo: string, nome: string, dataHora: string, complementosTabelados: array<struct<codigo: string, valor: string>>, orgaoJulgador: {NAMED}>>"
)


def public_key(page: str) -> str:
    """The API key that a public page states."""
    found = re.search(r"APIKey\s+([A-Za-z0-9+/=]{30,})", html.unescape(re.sub("<[^>]+>", " ", page)))
    if not found:
        raise ValueError("no public API key on the page")
    return found[1]


def batched(items: Sequence, size: int) -> Iterator[list]:
    if size < 1:
        raise ValueError("size must be 1 or more")
    yield from (list(items[a : a + size]) for a in range(0, len(items), size))


def terms_body(numbers: Sequence[str], size: int = 1000) -> dict:
    """Request body that asks for all documents of some case numbers at once."""
    return {"size": size, "query": {"terms": {"numeroProcesso": list(numbers)}}, "_source": list(CASE_FIELDS)}


def total_hits(answer: dict) -> int:
    total = (answer.get("hits") or {}).get("total") or 0
    return int((total.get("value") or 0) if isinstance(total, dict) else total)


def sources(answer: dict) -> Iterator[dict]:
    for hit in (answer.get("hits") or {}).get("hits") or []:
        if isinstance(doc := hit.get("_source"), dict):
            yield doc | {"id": doc.get("id") or hit.get("_id")}


def fetch(ask: Callable[[dict], dict], numbers: Sequence[str], size: int = 1000) -> Iterator[dict]:
    """Documents of numbers; a request that has more of them than `size` is split in two until each half fits."""
    answer = ask(terms_body(numbers, size))
    if total_hits(answer) > size and len(numbers) > 1:
        half = len(numbers) // 2
        yield from fetch(ask, numbers[:half], size)
        yield from fetch(ask, numbers[half:], size)
    else:
        yield from sources(answer)


class Transient(Exception):
    """An answer worth asking again for: 408, 429 or 5xx."""


def with_retries(ask: Callable[[dict], dict], wait: Callable[[float], None], attempts: int = 5) -> Callable[[dict], dict]:
    """ask, repeated after 1, 2, 4 ... seconds while it raises Transient."""

    def call(body: dict) -> dict:
        for n in range(attempts):
            try:
                return ask(body)
            except Transient:
                if n == attempts - 1:
                    raise
                wait(2.0**n)
        raise AssertionError

    return call


class CaseIndex(DataSource):
    """spark.read.format("case_index"): documents of the case numbers in option numbers (comma-joined), a partition a batch.

    Option `transport` is a module:function that answers request bodies: an HTTP client on line, stored answers in tests.
    """

    @classmethod
    def name(cls) -> str:
        return "case_index"

    def schema(self) -> str:
        return "source string"

    def reader(self, schema) -> DataSourceReader:
        return CaseReader(self.options)


class CaseReader(DataSourceReader):
    def __init__(self, options):
        self.numbers = [n for n in options.get("numbers", "").split(",") if n]
        self.batch, self.size, self.transport = int(options.get("batch", 500)), int(options.get("size", 1000)), options["transport"]

    def partitions(self) -> list[InputPartition]:
        return [InputPartition(b) for b in batched(self.numbers, self.batch)] or [InputPartition([])]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        import importlib
        import time

        module, _, function = self.transport.partition(":")
        ask = with_retries(getattr(importlib.import_module(module), function), time.sleep)
        if partition.value:
            for doc in fetch(ask, partition.value, self.size):
                yield (json.dumps({k: v for k, v in doc.items() if k in CASE_FIELDS}, ensure_ascii=False),)


def read_answers(spark: SparkSession, path: str) -> DataFrame:
    """Documents of stored JSON lines (gzip or not), with the declared fields only."""
    return spark.read.schema(SOURCE).json(path)


def _code(c: Column) -> Column:
    return F.nullif(F.trim(c), F.lit(""))


def _joined(items: Column, sep: str) -> Column:
    return F.nullif(F.array_join(F.filter(items, lambda x: x.isNotNull() & (x != "")), sep), F.lit(""))


def cases(docs: DataFrame, alias: str) -> DataFrame:
    """schemas.CASES of documents (SOURCE)."""
    moves = F.filter(F.coalesce("movimentos", F.expr("array()")), lambda m: m.isNotNull())
    stamps = F.filter(F.transform(moves, lambda m: iso_seconds(m["dataHora"])), lambda t: t.isNotNull())
    subjects = F.coalesce("assuntos", F.expr("array()"))
    return schemas.without_personal_fields(
        docs.select(
            F.lit(alias).alias("alias"), _code(F.col("numeroProcesso")).alias("numero_processo"), _code(F.col("tribunal")).alias("tribunal"), _code(F.col("grau")).alias("grau"),
            _code(F.col("id")).alias("es_id"), stamp14(F.col("dataAjuizamento")).alias("data_ajuizamento"), F.col("nivelSigilo").alias("nivel_sigilo"),
            _code(F.col("classe.codigo")).alias("classe_codigo"), F.col("classe.nome").alias("classe_nome"), _code(F.col("orgaoJulgador.codigo")).alias("orgao_codigo"),
            F.col("orgaoJulgador.nome").alias("orgao_nome"), F.col("orgaoJulgador.codigoMunicipioIBGE").try_cast("int").alias("municipio_ibge"),
            F.col("sistema.nome").alias("sistema_nome"), F.col("formato.nome").alias("formato_nome"), _joined(F.transform(subjects, lambda a: F.trim(a["codigo"])), ";").alias("assuntos_codigos"),
            _joined(F.transform(subjects, lambda a: a["nome"]), "|").alias("assuntos_nomes"), F.size(moves).alias("n_movimentos"),
            F.array_min(stamps).alias("primeiro_movimento"), F.array_max(stamps).alias("ultimo_movimento"), iso_seconds(F.col("dataHoraUltimaAtualizacao")).alias("atualizado_em"),
        ).to(schemas.CASES)
    )


def movements(docs: DataFrame, alias: str) -> DataFrame:
    """schemas.MOVEMENTS: a row a movement, numbered by time within its document; undated ones come last, in their order.

    The numbering sorts each document's own array, so nothing is shuffled.
    """
    raw = F.filter(F.coalesce("movimentos", F.expr("array()")), lambda m: m.isNotNull())
    keyed = F.transform(raw, lambda m, i: F.struct(iso_seconds(m["dataHora"]).isNull().alias("undated"), iso_seconds(m["dataHora"]).alias("at"), i.alias("place"), m.alias("m")))
    # Structs sort by their fields in turn; the place is unique, so the movement itself is never compared.
    places = F.array_sort(F.transform(keyed, lambda k: F.struct(k["undated"], k["at"], k["place"])))
    ordered = F.transform(places, lambda p: F.struct(p["at"].alias("at"), F.get(raw, p["place"]).alias("m")))
    rows = docs.select(F.col("numeroProcesso"), "grau", "id", F.posexplode(ordered).alias("n", "x"))
    extra = F.transform(F.coalesce("x.m.complementosTabelados", F.expr("array()")), lambda c: F.concat_ws(":", F.coalesce(_code(c["codigo"]), F.lit("None")), F.coalesce(_code(c["valor"]), F.lit("None"))))
    return rows.select(
        F.lit(alias).alias("alias"), _code(F.col("numeroProcesso")).alias("numero_processo"), _code(F.col("grau")).alias("grau"), _code(F.col("id")).alias("es_id"),
        (F.col("n") + 1).alias("ordem"), F.col("x.m.codigo").try_cast("int").alias("codigo"), F.col("x.m.nome").alias("nome"), F.col("x.at").alias("data_hora"),
        _code(F.col("x.m.orgaoJulgador.codigo")).alias("orgao_codigo"), F.nullif(F.array_join(extra, ";"), F.lit("")).alias("complementos"),
    ).to(schemas.MOVEMENTS)

"""Event trajectories: an event log to one row a case, and comparisons of groups of cases."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.dates import days_between
from ..sources.config import EventGroups
from . import skew

CASE = ("numero_processo", "alias")


def distinct_events(events: DataFrame, keys: tuple[str, ...] = (*CASE, "codigo", "data_hora", "orgao_codigo"), name: str = "nome") -> DataFrame:
    """Each event once: a case published twice repeats its events. Nulls in keys count as equal; the least name stays."""
    return events.groupBy(*keys).agg(F.min(name).alias(name))


def totals(groups: EventGroups, code: str, name: str, at: str) -> list[Column]:
    """Number, first and last time of events, and number and first time of each group's."""
    columns: list[Column] = [F.count("*").alias("n_movimentos"), F.min(at).alias("primeiro_movimento"), F.max(at).alias("ultimo_movimento")]
    for g in groups.groups:
        hit = g.matches(code, name)
        columns += [F.count_if(hit).alias(f"n_{g.id}"), F.min(F.when(hit, F.col(at))).alias(f"primeiro_{g.id}")]
    return columns


def event_summary(events: DataFrame, groups: EventGroups, case: tuple[str, ...] = CASE, code: str = "codigo", name: str = "nome", at: str = "data_hora", organ: str = "orgao_codigo") -> DataFrame:
    """Counts and first times of a case's distinct events (by case, code, time and organ; the least name counts), overall and for
    each group, with the numbers of distinct codes and organs.

    Events are dealt by case once. In the order of organ, code and time an event is new, and an organ is, where the row before
    differs; codes are ranked in an order of their own; everything then meets in one aggregation on the same partitioning.
    Nothing of a case is held but what a sort may spill. Hot cases, if there are any, are summed by partial aggregates.
    """
    usual, hot = skew.apart(events, case)
    dealt = _dealt_summary(usual, groups, case, code, name, at, organ)
    return dealt if hot is None else dealt.unionByName(_combined_summary(hot, groups, case, code, name, at, organ))


def _dealt_summary(events: DataFrame, groups: EventGroups, case: tuple[str, ...], code: str, name: str, at: str, organ: str) -> DataFrame:
    own = list(dict.fromkeys((*case, organ, code, at, name)))
    of_case, last = Window.partitionBy(*case), F.col(name).asc_nulls_last()
    event = F.struct(F.col(organ).alias("organ"), F.col(code).alias("code"), F.col(at).alias("at"))
    rows = events.select(*own).repartition(*case).withColumn("_before", F.lag(event).over(of_case.orderBy(organ, code, at, last)))
    rows = rows.where(~event.eqNullSafe(F.col("_before"))).withColumn("_organ", F.col(organ).isNotNull() & ~F.col(organ).eqNullSafe(F.col("_before.organ"))).drop("_before")
    rows = rows.withColumn("_code", F.dense_rank().over(of_case.orderBy(F.col(code).asc_nulls_last())))
    codes = F.coalesce(F.max(F.when(F.col(code).isNotNull(), F.col("_code"))), F.lit(0)).cast("bigint")
    return rows.groupBy(*case).agg(*totals(groups, code, name, at), codes.alias("n_codigos_distintos"), F.count_if("_organ").alias("n_orgaos_movimento"))


def _combined_summary(events: DataFrame, groups: EventGroups, case: tuple[str, ...], code: str, name: str, at: str, organ: str) -> DataFrame:
    """The same without dealing a case to one task. Distinct codes and organs are counted apart, from pairs that need no other
    column: beside so many aggregates a distinct count would carry all of their buffers for each pair."""
    out = distinct_events(events, (*case, code, at, organ), name) if name not in (code, at, organ) else events.select(*case, code, at, organ).distinct()
    out = out.groupBy(*case).agg(*totals(groups, code, name, at))
    own = [c for c in out.columns if c not in case]
    for column, count in ((code, "n_codigos_distintos"), (organ, "n_orgaos_movimento")):
        pairs = events.select(*case, F.col(column).alias("_of")).where("_of IS NOT NULL").distinct()
        out = out.unionByName(pairs.groupBy(*case).agg(F.count("*").alias(count)), allowMissingColumns=True)
    # One row a case and part: the union is small, and null cases meet as well.
    return out.groupBy(*case).agg(*(F.max(c).alias(c) for c in own), *(F.coalesce(F.max(c), F.lit(0)).alias(c) for c in ("n_codigos_distintos", "n_orgaos_movimento")))


def case_summary(cases: DataFrame) -> DataFrame:
    """One row a case from its documents (one for each instance)."""
    return cases.groupBy(*CASE).agg(
        F.count("*").alias("n_documentos"), F.nullif(F.array_join(F.array_sort(F.collect_set("grau")), ";"), F.lit("")).alias("graus"),
        F.min("data_ajuizamento").alias("data_ajuizamento"), F.max("nivel_sigilo").alias("nivel_sigilo"), F.min("classe_codigo").alias("classe_codigo"),
        F.min("classe_nome").alias("classe_nome"), F.min("assuntos_codigos").alias("assuntos_codigos"), F.max("municipio_ibge").alias("municipio_ibge"),
        F.count_distinct("orgao_codigo").alias("n_orgaos_caso"),
    )


def since_filing(filed: Column, last: Column) -> Column:
    """Calendar days from filing to the last event; null where filing comes later or before 1990."""
    return F.when((filed <= last) & (F.year(filed) >= 1990), days_between(filed, last)).cast("bigint")


def features(cases: DataFrame, events: DataFrame, targets: DataFrame, groups: EventGroups) -> DataFrame:
    """One row a target, found or not; both sides are summed by case before the joins, which use the same partitioning."""
    e = event_summary(events, groups)
    t = targets.select(*CASE, "grupo", "pub_year", "strict_hit", F.col("n_documentos").alias("n_docs_corpus")).distinct()
    joined = t.join(case_summary(cases).withColumn("found", F.lit(True)), [*CASE], "left").join(e, [*CASE], "left")
    count = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return joined.select(
        *t.columns, "n_documentos", "graus", "n_orgaos_caso", "nivel_sigilo", "classe_codigo", "classe_nome", "assuntos_codigos", "municipio_ibge",
        "data_ajuizamento", "primeiro_movimento", "ultimo_movimento", count("n_movimentos"), count("n_codigos_distintos"), count("n_orgaos_movimento"),
        days_between(F.col("primeiro_movimento"), F.col("ultimo_movimento")).cast("bigint").alias("dias_entre_movimentos"),
        since_filing(F.col("data_ajuizamento"), F.col("ultimo_movimento")).alias("dias_desde_ajuizamento"),
        *(c for g in groups.groups for c in (count(f"n_{g.id}"), F.col(f"primeiro_{g.id}"))), F.col("found").isNull().alias("nao_encontrado"),
    )


def comparison(rows: DataFrame, by: tuple[str, ...], groups: EventGroups, days: str = "dias_entre_movimentos", least: int = 5) -> DataFrame:
    """Cases, cases not found, mean and median events and days, share with each event group; small cells left out."""
    found = ~F.col("nao_encontrado")
    n = F.nullif(F.count_if(found), F.lit(0))
    share = [F.round(100 * F.count_if(found & (F.col(f"n_{g.id}") > 0)) / n, 2).alias(f"pct_{g.id}") for g in groups.groups]
    stat = lambda f, c: F.round(f(F.when(found, F.col(c))), 2)
    return rows.groupBy(*by).agg(
        F.count("*").alias("n"), F.count_if(~found).alias("n_not_found"), stat(F.avg, "n_movimentos").alias("mean_events"), stat(F.median, "n_movimentos").alias("median_events"),
        stat(F.avg, days).alias("mean_days"), stat(F.median, days).alias("median_days"), *share,
    ).where(F.col("n") >= least)


def vocabulary(events: DataFrame, targets: DataFrame, group: str, top: int, case: tuple[str, ...] = CASE, code: tuple[str, ...] = ("codigo", "nome"), least: int = 5) -> DataFrame:
    """Cases that have each event code, by group of cases; codes in `least` cases or more, the commonest first."""
    seen = events.select(*case, *code).distinct().join(targets.select(*case, group).distinct(), [*case])
    counted = seen.groupBy(*code, group).agg(F.count("*").alias("cases")).where(F.col("cases") >= least)
    return counted.orderBy(F.col("cases").desc(), *code, group).limit(top)

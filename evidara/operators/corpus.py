"""Whole steps over the stored tables: case targets, the annotation sample, agreement of two sources.

Grain: documents are made distinct first, as their table repeats some rows; a registry number may stand for several
cases, so links multiply documents on purpose and are distinct on their key.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import document_id
from ..sources.config import Lexicon
from ..sources.decisions import decision_text
from .lexicon import outputs
from .linkage import linked, per_key
from .sampling import BLIND, SEED, STRATA, Stratum, blind_round, quota_matched, stratified, top_per_key
from .worksheet import LABEL_COLUMNS

KEY = ["key", "seq_documento"]
# Names of the two groups of cases, and the columns of an annotation worksheet before its labels.
CANDIDATE, COMPARISON = "candidato", "comparacao_nao_sinalizado"
META = ("data_publicacao", "tipo_documento", "classe", "processo", "numero_registro", "assuntos_leaf")
HINTS = ("stratum", "patterns", "annex_a_items", "tiers", "n_hits", "negated_all", "context_1", "context_2", "context_3")
SHORTEST_CONTROL = 500


def year_of(key: str = "key") -> Column:
    return F.substring(key, 1, 4)


def targets(documents: DataFrame, links: DataFrame, candidates: DataFrame, ratio: float = 1.0, seed: int | str = SEED, years: tuple[str, ...] = ()) -> DataFrame:
    """schemas.TARGETS: cases of candidate documents, and `ratio` times as many others of the same court and year.

    A case with any candidate document is a candidate; no case is in both groups, whatever its court.
    """
    known = links.where("datajud_alias IS NOT NULL AND cnj_valid").select("numero_registro", F.col("cnj_digits").alias("numero_processo"), F.col("datajud_alias").alias("alias")).distinct()
    flags = candidates.where("is_candidate").select(*KEY, "strict_hit", F.lit(True).alias("flagged")).distinct()
    rows = linked(documents.select(*KEY, "numero_registro").distinct(), known, flags).withColumn("pub_year", year_of())
    rows = rows.where(F.col("pub_year").isin(*years)) if years else rows
    case = ["numero_processo", "alias"]
    of = lambda r: r.groupBy(*case).agg(F.min("pub_year").alias("pub_year"), F.coalesce(F.max("strict_hit"), F.lit(False)).alias("strict_hit"), F.count("*").cast("int").alias("n_documentos"))
    chosen, rest = of(rows.where("flagged")), of(rows.where("flagged IS NULL"))
    pool = rest.join(chosen.select("numero_processo").distinct(), "numero_processo", "left_anti").withColumn("strict_hit", F.lit(False))
    columns = [*case, "grupo", "pub_year", "strict_hit", "n_documentos"]
    out = chosen.withColumn("grupo", F.lit(CANDIDATE)).select(*columns)
    if ratio > 0:
        drawn = quota_matched(pool, chosen, ["alias", "pub_year"], ratio, seed, ["numero_processo"])
        out = out.unionByName(drawn.withColumn("grupo", F.lit(COMPARISON)).select(*columns))
    return out


def annotation_base(documents: DataFrame, texts: DataFrame, candidates: DataFrame, near_misses: DataFrame, hits: DataFrame, years: tuple[str, str] = ("0000", "9999")) -> DataFrame:
    """A row a document that can be drawn: its metadata, what the scan said, its best contexts and its stratum.

    Texts are compared by length only. Candidates and near misses need no text; unflagged controls need a long one.
    """
    m = documents.select(*KEY, *META).distinct().where(year_of().between(*years))
    t = texts.select(*KEY, "nchar").dropDuplicates(KEY)
    kept = hits.where("excluded_by IS NULL")
    rank = F.when(F.col("tier") == "strict", 0).when(F.col("tier") == "conduct", 1).when(F.col("tier") == "sanction", 2).otherwise(3)
    contexts = top_per_key(kept, KEY, [F.col("negated_hint"), rank, F.col("start"), F.col("pattern_id")], 3, ["context"])
    counts = kept.groupBy(*KEY).agg(*(F.count_distinct(F.when(F.col("tier") == x, F.col("pattern_id"))).alias(f"n_{x}_patterns") for x in ("conduct", "sanction")))
    said = [c for c in candidates.columns if c in ("patterns", "annex_a_items", "tiers", "n_hits", "negated_all", "strict_hit", "conduct_hit", "sanction_hit")]
    flagged = candidates.where("is_candidate").select(*KEY, *said, F.lit(True).alias("is_candidate"), F.lit(True).alias("prefiltered"))
    near = near_misses.select(*KEY, *said, F.lit(False).alias("is_candidate"), F.lit(True).alias("prefiltered"))
    scanned = flagged.unionByName(near)
    rows = m.join(scanned, KEY, "left").join(t, KEY, "left").join(contexts, KEY, "left").join(counts, KEY, "left")
    rows = rows.where(F.col("prefiltered") | (F.col("nchar") > SHORTEST_CONTROL))
    empty = {"patterns": "", "annex_a_items": "", "tiers": "", "n_hits": 0, "negated_all": False, "strict_hit": False, "conduct_hit": False, "sanction_hit": False, "is_candidate": False, "prefiltered": False, "n_conduct_patterns": 0, "n_sanction_patterns": 0}
    rows = rows.withColumns({k: F.coalesce(k, F.lit(v)) for k, v in empty.items() if k in rows.columns})
    conduct = (F.col("n_conduct_patterns") >= 1) & (F.col("n_sanction_patterns") >= 1)
    return rows.withColumns({"conduct_hit": conduct, "sanction_hit": conduct, "doc_id": document_id(F.col("key"), F.col("seq_documento"))})


def annotation_sample(base: DataFrame, seed: int | str = SEED, strata: tuple[Stratum, ...] = STRATA) -> DataFrame:
    """The worksheet: metadata, hints and empty labels of up to each stratum's size; a document is in one stratum."""
    drawn = stratified(base, seed, KEY, strata)
    blank = [F.lit("").alias(c) for c in LABEL_COLUMNS]
    return drawn.select("doc_id", *KEY, *META, "nchar", *HINTS, *blank).orderBy("stratum", F.col("data_publicacao").asc_nulls_last(), "doc_id")


def blind_sample(sample: DataFrame, total: int, seed: int | str = SEED) -> DataFrame:
    """A tenth of the sample for a second, blind labelling: of the hints only two contexts stay."""
    return blind_round(sample, total, seed, BLIND, tuple(h for h in HINTS if h not in ("context_1", "context_2")))


def decision_stats(decisions: DataFrame) -> DataFrame:
    """part (all, year or body), name, decisions, with_theme, with_citations, registrations (distinct).

    One aggregation by year, body and registration fills all parts; undated decisions are in no year.
    """
    cells = decisions.groupBy(F.year("data_publicacao").cast("string").alias("year"), F.col("orgao_slug").alias("body"), "numero_registro").agg(
        F.count("*").alias("n"), F.count("tema").alias("themed"), F.count_if(F.col("n_citations") > 0).alias("citing")
    )
    named = F.array(F.struct(F.lit("all").alias("part"), F.lit(None).cast("string").alias("name")), F.struct(F.lit("year").alias("part"), F.col("year").alias("name")), F.struct(F.lit("body").alias("part"), F.col("body").alias("name")))
    each = cells.select(F.inline(named), "numero_registro", "n", "themed", "citing").where("part <> 'year' OR name IS NOT NULL")
    by = each.groupBy("part", "name", "numero_registro").agg(*(F.sum(c).alias(c) for c in ("n", "themed", "citing")))
    return by.groupBy("part", "name").agg(F.sum("n").alias("decisions"), F.sum("themed").alias("with_theme"), F.sum("citing").alias("with_citations"), F.count("numero_registro").alias("registrations"))


def scan_decisions(decisions: DataFrame, lexicon: Lexicon) -> dict[str, DataFrame]:
    """Candidates and their hits among decision summaries; near misses are not kept. One scan feeds both, as in outputs."""
    out = outputs(decision_text(decisions), lexicon)
    return {k: out[k] for k in ("scanned", "candidates", "hits")}


def by_registry(documents: DataFrame, candidates: DataFrame, on: list[str]) -> DataFrame:
    """numero_registro, year (where documents have a key), strict, candidate: flags of any of its documents."""
    c = candidates.select(*on, F.col("strict_hit").alias("strict"), F.col("is_candidate").alias("candidate"))
    rows = documents.where("numero_registro IS NOT NULL").join(c, on, "left")
    flags = per_key(rows, "numero_registro", ["strict", "candidate"]).drop("rows")
    return flags.join(documents.groupBy("numero_registro").agg(F.min(year_of()).alias("year")), "numero_registro")


def source_agreement(left: DataFrame, right: DataFrame) -> DataFrame:
    """One row over the registry numbers of by_registry frames: sizes, what both flag and what one flags alone."""
    pair = lambda d, p: d.select("numero_registro", F.col("strict").alias(f"{p}s"), F.col("candidate").alias(f"{p}c"))
    j = pair(left, "l").join(pair(right, "r"), "numero_registro", "full")
    l, r, both = F.col("ls").isNotNull(), F.col("rs").isNotNull(), F.col("ls").isNotNull() & F.col("rs").isNotNull()
    counts = {"left": l, "right": r, "shared": both}
    for name, x in (("strict", "s"), ("candidate", "c")):
        a, b = F.col(f"l{x}"), F.col(f"r{x}")
        counts |= {f"both_{name}": both & a & b, f"{name}_left_only": both & a & ~b, f"{name}_right_only": both & ~a & b}
    out = j.agg(*(F.count_if(c).alias(k) for k, c in counts.items()))
    return out.withColumn("pct_strict_found_right", F.round(100.0 * F.col("both_strict") / F.nullif(F.col("both_strict") + F.col("strict_left_only"), F.lit(0)), 1))


def agreement_by_year(left: DataFrame, right: DataFrame, least: int = 5) -> DataFrame:
    """Strict registry numbers of the left source by year: those the right source has, and flags as strict too."""
    r = right.select("numero_registro", F.col("strict").alias("also"))
    n = left.where("strict").join(r, "numero_registro", "left").groupBy("year").agg(F.count("*").alias("strict"), F.count("also").alias("in_both"), F.count_if("also").alias("also_strict"))
    return n.where(F.col("strict") >= least).withColumn("pct", F.round(100.0 * F.col("also_strict") / F.nullif("in_both", F.lit(0)), 1))

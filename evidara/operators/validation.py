"""Gold-set statistics: confusion, precision, recall, F1 (raw and weighted), agreement, verdicts.

Annotated rows have doc_id, stratum, status (S3 .. S0, NA), flagged, patterns (array) and grounds (array).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import labels

# Strata that hold documents the lexicon flagged, and the one that gives recall its denominator.
FLAGGED_STRATA = ("strict", "strict_negated", "conduct_multi", "conduct_sanction")
RECALL_STRATUM = "control_unflagged"
K = 5


def annotated(worksheet: DataFrame, candidates: DataFrame | None = None) -> DataFrame:
    """Labelled rows of a worksheet; flagged is membership in candidates (doc_id), else that the stratum is flagged."""
    rows = worksheet.select(
        F.trim("doc_id").alias("doc_id"), F.trim("stratum").alias("stratum"), labels.status(F.col("label1_status")).alias("status"), labels.measure(F.col("label3_measure")).alias("measure"),
        F.filter(F.split(F.coalesce("patterns", F.lit("")), ";"), lambda p: p != "").alias("patterns"), labels.grounds(F.col("label2_grounds")).alias("grounds"),
    ).where("status IS NOT NULL")
    if candidates is None:
        return rows.withColumn("flagged", F.col("stratum").isin(*FLAGGED_STRATA))
    known = candidates.select("doc_id").distinct().withColumn("flagged", F.lit(True))
    return rows.join(known, "doc_id", "left").withColumn("flagged", F.coalesce("flagged", F.lit(False)))


def label_counts(worksheet: DataFrame) -> DataFrame:
    """One row: labelled, blank and unknown rows of a worksheet."""
    raw = F.trim(F.coalesce("label1_status", F.lit("")))
    known = labels.status(F.col("label1_status")).isNotNull()
    return worksheet.agg(F.count_if(known).alias("labelled"), F.count_if(raw == "").alias("blank"), F.count_if((raw != "") & ~known).alias("unknown"))


def signalled(include_s2: bool = True) -> Column:
    return F.col("status").isin(*(("S3", "S2") if include_s2 else ("S3",)))


def weights(strata: DataFrame, rows: DataFrame | None = None) -> DataFrame:
    """stratum, weight: available over sampled, or over the rows that carry a label (NA too) where rows are given."""
    if rows is not None:
        strata = strata.drop("sampled").join(rows.groupBy("stratum").agg(F.count("*").alias("sampled")), "stratum", "left")
    drawn = F.coalesce("sampled", F.lit(0))
    return strata.select("stratum", F.when(drawn > 0, F.coalesce("available", F.lit(0)) / drawn).otherwise(0.0).alias("weight"))


def confusion(rows: DataFrame, weight: DataFrame | None = None, include_s2: bool = True, by: tuple[str, ...] = ()) -> DataFrame:
    """tp, fp, fn, tn of flagged against signalled; NA rows are out, strata without a weight count once."""
    used = rows.where("status <> 'NA'")
    if weight is None:
        used = used.withColumn("weight", F.lit(1.0))
    else:
        used = used.join(F.broadcast(weight), "stratum", "left").withColumn("weight", F.coalesce("weight", F.lit(1.0)))
    good, hit = signalled(include_s2), F.col("flagged")
    cells = {"tp": hit & good, "fp": hit & ~good, "fn": ~hit & good, "tn": ~hit & ~good}
    return used.groupBy(*by).agg(*(F.coalesce(F.sum(F.when(c, F.col("weight"))), F.lit(0.0)).alias(k) for k, c in cells.items()))


def with_scores(cells: DataFrame) -> DataFrame:
    """cells with precision, recall and f1, four decimals, null where a denominator is zero."""
    p = F.col("tp") / F.nullif(F.col("tp") + F.col("fp"), F.lit(0.0))
    r = F.col("tp") / F.nullif(F.col("tp") + F.col("fn"), F.lit(0.0))
    f1 = F.when((p > 0) & (r > 0), 2 * p * r / (p + r))
    return cells.withColumns({"precision": F.bround(p, 4), "recall": F.bround(r, 4), "f1": F.bround(f1, 4)})


def metrics(rows: DataFrame, weight: DataFrame | None = None, include_s2: bool = True, by: tuple[str, ...] = ()) -> DataFrame:
    return with_scores(confusion(rows, weight, include_s2, by))


def estimability(rows: DataFrame, strata: DataFrame) -> DataFrame:
    """One row: which estimates the labelled strata support, and whether the labelling is complete.

    Precision needs usable rows of a flagged stratum, recall those of RECALL_STRATUM beside it.
    """
    done = rows.groupBy("stratum").agg(F.count("*").alias("labelled"), F.count_if(F.col("status") != "NA").alias("usable"))
    all_ = strata.select("stratum", F.coalesce("sampled", F.lit(0)).alias("sampled")).join(done, "stratum", "full")
    usable, labelled = F.coalesce("usable", F.lit(0)), F.coalesce("labelled", F.lit(0))
    flagged, full = F.col("stratum").isin(*FLAGGED_STRATA), labelled >= F.coalesce("sampled", F.lit(0))
    held = F.col("sampled").isNotNull()
    return all_.agg(
        (F.count_if(flagged & (usable > 0)) > 0).alias("precision"),
        F.array_sort(F.collect_set(F.when(flagged & (usable > 0), F.col("stratum")))).alias("precision_scope"),
        (F.count_if(flagged & held & (F.col("sampled") > 0) & ~full) == 0).alias("precision_covers_all_candidates"),
        ((F.count_if(flagged & (usable > 0)) > 0) & (F.count_if((F.col("stratum") == RECALL_STRATUM) & (usable > 0)) > 0)).alias("recall"),
        (F.count_if(held & ~full) == 0).alias("annotation_complete"),
        (F.sum(usable) > 0).alias("per_pattern_precision"),
    ).withColumn("f1", F.col("recall"))


def mask(scores: DataFrame, estimable: DataFrame) -> DataFrame:
    """scores with null for what is not estimable; estimable is one row."""
    e = estimable.select(F.col("precision").alias("_p"), F.col("recall").alias("_r"))
    both = scores.join(F.broadcast(e))
    return both.withColumns({"precision": F.when(F.col("_p"), F.col("precision")), "recall": F.when(F.col("_r"), F.col("recall")), "f1": F.when(F.col("_r"), F.col("f1"))}).drop("_p", "_r")


def estimates(rows: DataFrame, weight: DataFrame, estimable: DataFrame) -> DataFrame:
    """Four rows: S3 and S2, or S3 alone, each raw and weighted, masked. One aggregation fills all of them."""
    used = rows.where("status <> 'NA'").join(F.broadcast(weight), "stratum", "left").withColumn("weight", F.coalesce("weight", F.lit(1.0)))
    cases = [(p, k, signalled(p == "S3+S2"), F.col("weight") if k == "weighted" else F.lit(1.0)) for p in ("S3+S2", "S3") for k in ("raw", "weighted")]
    hit, sums, out = F.col("flagged"), [], []
    for i, (p, k, good, w) in enumerate(cases):
        cells = {"tp": hit & good, "fp": hit & ~good, "fn": ~hit & good, "tn": ~hit & ~good}
        sums += [F.coalesce(F.sum(F.when(c, w)), F.lit(0.0)).alias(f"{n}{i}") for n, c in cells.items()]
        out.append(F.struct(F.lit(p).alias("positive"), F.lit(k).alias("kind"), *(F.col(f"{n}{i}").alias(n) for n in cells)))
    return mask(with_scores(used.agg(*sums).select(F.inline(F.array(*out)))), estimable)


def per_pattern(rows: DataFrame, least: int = K, include_s2: bool = True) -> DataFrame:
    """pattern_id, annotated, signalled, precision; the last two null where annotated is under `least`."""
    each = rows.where("status <> 'NA'").select(signalled(include_s2).alias("good"), F.explode(F.array_distinct("patterns")).alias("pattern_id"))
    n = each.groupBy("pattern_id").agg(F.count("*").alias("annotated"), F.count_if("good").alias("signalled"))
    shown = F.col("annotated") >= least
    return n.select(
        "pattern_id", "annotated", F.when(shown, F.col("signalled")).alias("signalled"), F.when(shown, F.bround(F.col("signalled") / F.col("annotated"), 4)).alias("precision"), (~shown).alias("suppressed"),
    )


def ground_counts(rows: DataFrame, least: int = K) -> DataFrame:
    """ground, documents (null under `least`); NA rows count."""
    n = rows.select(F.explode(F.array_distinct("grounds")).alias("ground")).groupBy("ground").agg(F.count("*").alias("n"))
    return n.select("ground", F.when(F.col("n") >= least, F.col("n")).alias("documents"), (F.col("n") < least).alias("suppressed"))


def cohen_kappa(pairs: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """One row: kappa and n of two labels of the same items. Null without items; 1 or 0 where all labels are one."""
    cells = pairs.groupBy(F.col(a).alias("a"), F.col(b).alias("b")).agg(F.count("*").alias("n"))
    side = lambda c: cells.groupBy(F.col(c).alias("label")).agg(F.sum("n").alias(f"n_{c}"))
    chance = side("a").join(side("b"), "label").agg(F.coalesce(F.sum(F.col("n_a") * F.col("n_b")), F.lit(0)).alias("by_chance"))
    seen = cells.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.coalesce(F.sum(F.when(F.col("a") == F.col("b"), F.col("n"))), F.lit(0)).alias("same"))
    n = F.nullif(F.col("n"), F.lit(0)).cast("double")
    observed, expected = F.col("same") / n, F.col("by_chance") / (n * n)
    one = F.col("by_chance") == F.col("n") * F.col("n")
    kappa = F.when(one, F.when(F.col("same") == F.col("n"), 1.0).otherwise(0.0)).otherwise(F.bround((observed - expected) / F.nullif(1 - expected, F.lit(0.0)), 4))
    return seen.join(F.broadcast(chance)).select("n", F.when(F.col("n") > 0, kappa).alias("kappa"))


def round_agreement(first: DataFrame, second: DataFrame) -> DataFrame:
    """One row: documents labelled in both rounds (annotated frames), and kappa of their statuses and of their grounds."""
    side = lambda r, p: r.select("doc_id", F.col("status").alias(f"{p}s"), F.array_join("grounds", ";").alias(f"{p}g"))
    pairs = side(first, "a").join(side(second, "b"), "doc_id")
    status = cohen_kappa(pairs, "as", "bs").select("n", F.col("kappa").alias("kappa_status"))
    return status.join(F.broadcast(cohen_kappa(pairs, "ag", "bg").select(F.col("kappa").alias("kappa_grounds"))))


# Criterion, value column, threshold for go, threshold for reformulate.
CRITERIA = (
    ("candidates reviewed", "reviewed", 1000.0, 500.0),
    ("confirmed with reasons (S3 or S2)", "confirmed", 300.0, 150.0),
    ("lexical trigger precision", "precision", 0.30, 0.15),
    ("annotation agreement (Cohen kappa)", "kappa", 0.75, 0.60),
    ("bridge to cases", "bridge_rate", 0.70, 0.40),
    ("trajectory found", "trajectory_rate", 0.70, 0.40),
)


def verdicts(values: DataFrame, complete: bool | None = None) -> DataFrame:
    """A row a criterion: value, threshold_go, verdict; values is one row with the value columns.

    complete: whether the labelling is; if not, verdicts are provisional and counts under their goal are in progress.
    """
    rows = []
    for name, column, go, again in CRITERIA:
        v = F.col(column).cast("double")
        verdict = F.when(v.isNull(), "not measured yet").when(v >= go, "go").when(v >= again, "reformulate").otherwise("no-go")
        if complete is False and column in ("reviewed", "confirmed"):
            verdict = F.when(v.isNotNull() & (v < go), "in progress").otherwise(verdict)
        rows.append(F.struct(F.lit(name).alias("criterion"), v.alias("value"), F.lit(go).alias("threshold_go"), verdict.alias("verdict"), F.lit(complete is False).alias("provisional")))
    return values.select(F.inline(F.array(*rows)))


def linkage_rates(gold: DataFrame, documents: DataFrame, links: DataFrame, cases: DataFrame) -> DataFrame:
    """One row: signalled documents, those with a valid case number, those whose case was found (each document once)."""
    d = gold.where(signalled()).join(documents.select("doc_id", "numero_registro").distinct(), "doc_id", "left")
    k = links.where("cnj_valid").select("numero_registro", F.col("cnj_digits").alias("numero_processo")).distinct()
    c = cases.select("numero_processo").distinct().withColumn("found", F.lit(1))
    each = d.join(k, "numero_registro", "left").join(c, "numero_processo", "left").groupBy("doc_id").agg(F.count("numero_processo").alias("links"), F.count("found").alias("cases"))
    n = F.nullif(F.count("*"), F.lit(0))
    return each.agg(
        F.count("*").alias("confirmed"), F.count_if(F.col("links") > 0).alias("bridged"), F.count_if(F.col("cases") > 0).alias("found"),
        F.round(F.count_if(F.col("links") > 0) / n, 4).alias("bridge_rate"), F.round(F.count_if(F.col("cases") > 0) / F.nullif(F.count_if(F.col("links") > 0), F.lit(0)), 4).alias("trajectory_rate"),
    )

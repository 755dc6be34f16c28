"""The numbers behind the published figures; drawing them is left to whoever has a plotting library."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.config import EventGroups


def tiers_by_year(candidates: DataFrame, year: str = "year") -> DataFrame:
    """year, strict, conduct, sanction: candidate documents with a hit of each tier; a document may count in several."""
    flags = [F.count_if(F.col("is_candidate") & F.col(f"{t}_hit")).alias(t) for t in ("strict", "conduct", "sanction")]
    return candidates.groupBy(year).agg(*flags)


def pattern_bars(counts: DataFrame, top: int = 14, least: int = 5) -> DataFrame:
    """pattern_id, tier, documents of the commonest patterns (pattern_counts) with `least` documents or more."""
    return counts.where(F.col("documents") >= least).orderBy(F.col("documents").desc(), "pattern_id").limit(top).select("pattern_id", "tier", "documents")


def group_shares(comparison: DataFrame, groups: EventGroups, by: str, signalled: str, other: str, top: int = 20) -> DataFrame:
    """label, signalled, other: share of cases with each event group in two groups of cases (comparison), the largest first."""
    share = lambda g, who: F.max(F.when(F.col(by) == who, F.col(f"pct_{g.id}")))
    one = comparison.agg(*(share(g, w).alias(f"{n}{i}") for i, g in enumerate(groups.groups) for n, w in (("s", signalled), ("o", other))))
    bars = F.array(*(F.struct(F.lit(g.label_en or g.label).alias("label"), F.col(f"s{i}").alias("signalled"), F.col(f"o{i}").alias("other")) for i, g in enumerate(groups.groups)))
    rows = one.select(F.inline(bars)).where("signalled IS NOT NULL AND other IS NOT NULL")
    return rows.orderBy(F.greatest("signalled", "other").desc(), "label").limit(top)

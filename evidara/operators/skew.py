"""Keys that hold so many rows that one task should not get all of them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A key is hot with more than this part of all rows, and with more than so many rows; so there are fewer hot keys than the part says.
PART, LEAST = 4096, 1 << 20


def apart(rows: DataFrame, keys: tuple[str, ...] | list[str], least: int | None = None) -> tuple[DataFrame, DataFrame | None]:
    """(rows of other keys, rows of hot keys or None). Sizes are asked for beforehand, from the key columns alone; nulls are a key."""
    sizes = rows.groupBy(*keys).agg(F.count("*").alias("n"))
    total, most = sizes.agg(F.sum("n"), F.max("n")).first()
    share = max(LEAST if least is None else least, (total or 0) // PART)
    if (most or 0) <= share:
        return rows, None
    hot = F.broadcast(sizes.where(F.col("n") > share).select(*(F.col(k).alias(f"hot_{k}") for k in keys)))
    same = [rows[k].eqNullSafe(hot[f"hot_{k}"]) for k in keys]
    return rows.join(hot, same, "left_anti"), rows.join(hot, same, "left_semi")

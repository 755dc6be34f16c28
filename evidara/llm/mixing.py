"""Mixing sources to target weights: capped water-filling, then seeded whole and fractional repetitions.

A source's share of the mix is its weight's part of `share` times all words, but never more than `epochs` times its own
words: sources above that are clamped there, and what they leave goes to the others by weight until none is above. With
caps sorted by cap over weight this is one pass of running sums, target = min(cap, level * weight). The sums run over
ranges of sources and then over the ranges, so sources may be as many as hosts.

A source with target t and s words repeats each document floor(t / s) times. The rest t - floor(t / s) * s is drawn in
seeded order: a document's bin is the first three hex digits of the md5 of seed and doc_id, whole bins are taken in
order while they fit, and of the bin in which the rest runs out every document gives its first words, in proportion.
So a source's mix misses its target by no more than half a word for each document of one bin, nothing is ranked or
gathered by source (a histogram of 4,096 bins is summed before the shuffle), and reruns agree.

Size: words [^\\x20\\x09-\\x0D]+ of the whole text, 0 for null. Sources sort by code point, null (a source of its own)
last, and take the weights in turn. A null doc_id hashes as the word null; repeated doc_ids share a bin and are judged
row by row, as are repeated rows. Empty tables give no rows. Sources without words have target 0. A very long text is
counted whole; other columns pass through the mix, whatever their names, and are not read otherwise.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import broadcast_if_small, checkpointed, materialize, running_totals

WEIGHTS, SHARE, EPOCHS, SEED = (5, 2, 1), 1.5, 2.0, "mix-1:"
WORD = r"[^\x20\x09-\x0D]+"


def size(text: str = "text") -> Column:
    return F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("long")


def seeded_bin(doc_id: str = "doc_id") -> Column:
    digest = F.md5(F.concat(F.lit(SEED), F.coalesce(F.col(doc_id).cast("string"), F.lit("null"))).cast("binary"))
    return F.conv(F.substring(digest, 1, 3), 16, 10).cast("int")


def plan(sizes: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, epochs: float = EPOCHS) -> DataFrame:
    """A row a source of sizes (source, size, bin): source, source_size, target, whole, last_bin, part.

    whole: repetitions of every document; bins under last_bin give one more; of bin last_bin documents give part of it.
    """
    bins = checkpointed(sizes.groupBy("source", "bin").agg(F.sum("size").alias("words")))
    sources = bins.groupBy("source").agg(F.sum("words").alias("source_size"))
    by_name = [F.col("source").isNull(), F.col("source")]
    sources = running_totals(sources, by_name, {"place": F.lit(1).cast("bigint")})
    weight = F.element_at(F.array(*(F.lit(float(w)) for w in weights)), (F.col("place") % len(weights) + 1).cast("int"))
    sources = sources.withColumn("weight", weight).withColumn("cap", F.lit(epochs) * F.col("source_size").cast("double"))
    by_cap = [F.col("cap") / F.col("weight"), *by_name]
    sources = checkpointed(running_totals(sources, by_cap, {"caps": F.col("cap"), "weights": F.col("weight")}))
    every = sources.agg(F.sum("source_size").cast("double").alias("words"), F.sum("weight").alias("weights")).first()
    left = F.lit(share) * F.lit(every.words) - F.col("caps")
    sources = sources.withColumn("level", left / (F.lit(every.weights) - F.col("weights")))
    free = F.col("cap") / F.col("weight") > F.col("level")
    # The first source above its level, in order of cap over weight, has the level of all that are not clamped.
    level = sources.where(free).agg(F.min_by("level", F.struct(*(c.alias(f"o{i}") for i, c in enumerate(by_cap))))).first()[0]
    sources = sources.withColumn("target", F.when(free, F.col("weight") * F.lit(level).cast("double")).otherwise(F.col("cap")))
    sources = sources.withColumn("whole", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long"))
    sources = checkpointed(sources.select("source", "source_size", "target", "whole", (F.col("target") - F.col("whole") * F.col("source_size")).alias("rest")))
    upto = F.sum("words").over(Window.partitionBy("source").orderBy("bin"))
    s = sources.alias("s")
    cut = bins.withColumn("upto", upto).alias("b").join(s, F.expr("b.source <=> s.source"))
    cut = cut.where((F.col("upto") - F.col("words") < F.col("rest")) & (F.col("rest") <= F.col("upto")))
    cut = cut.groupBy("b.source").agg(F.min("bin").alias("last_bin"), F.min_by((F.col("rest") - (F.col("upto") - F.col("words"))) / F.col("words"), "bin").alias("part"))
    return s.join(cut.alias("c"), F.expr("s.source <=> c.source"), "left").select(
        "s.source", "source_size", "target", "whole", F.coalesce("last_bin", F.lit(-1)).alias("last_bin"), F.coalesce("part", F.lit(0.0)).alias("part")
    )


def extra() -> Column:
    """Words that a document gives beyond its whole repetitions."""
    cut = F.floor(F.col("size") * F.col("part") + 0.5).cast("long")
    return F.when(F.col("bin") < F.col("last_bin"), F.col("size")).when(F.col("bin") == F.col("last_bin"), cut).otherwise(0)


def mix(docs: DataFrame, **how) -> DataFrame:
    """A row per row of docs: doc_id, size, source_size, target, taken (words, repeats counted)."""
    sizes = docs.select("doc_id", F.col("source").cast("string"), size().alias("size"), seeded_bin().alias("bin"))
    sizes = materialize(sizes, "mix-sizes")
    p = broadcast_if_small(plan(sizes, **how))
    return sizes.alias("d").join(p.alias("p"), F.expr("d.source <=> p.source")).select(
        "doc_id", "size", "source_size", "target", (F.col("size") * F.col("whole") + extra()).cast("long").alias("taken")
    )


def mixed_documents(docs: DataFrame, **how) -> DataFrame:
    """The mix itself, with the columns of docs: a row for each repetition, cut to its first words where it gives a part."""
    kept = docs.columns
    quoted = [F.col("`" + c.replace("`", "``") + "`") for c in kept]
    own = docs.select(F.struct(*quoted).alias("row"), F.col("source").cast("string").alias("source"), size().alias("size"), seeded_bin().alias("bin"))
    p = broadcast_if_small(plan(own.select("source", "size", "bin"), **how))
    rows = own.alias("d").join(p.alias("p"), F.expr("d.source <=> p.source")).withColumn("extra", extra())
    turns = F.concat(F.expr("array_repeat(-1L, cast(whole as int))"), F.when(F.col("extra") > 0, F.array("extra")).otherwise(F.expr("cast(array() as array<bigint>)")))
    rows = rows.select("row", "size", F.explode(turns).alias("words"))
    part = (F.col("words") >= 0) & (F.col("words") < F.col("size"))
    text = F.when(part, F.array_join(F.slice(F.regexp_extract_all("row.text", F.lit(WORD), 0), 1, F.greatest("words", F.lit(1)).cast("int")), " ")).otherwise(F.col("row.text"))
    changed = {"text": text.alias("text"), "n_chars": F.when(part, F.length(text)).otherwise(F.col("row.n_chars")).alias("n_chars") if "n_chars" in kept else None}
    return rows.select(*(changed[c] if c in changed else F.col("row")[c].alias(c) for c in kept))


ORACLE = r"""
WITH d AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
         ('0x' || substr(md5('mix-1:' || coalesce(doc_id::VARCHAR, 'null')), 1, 3))::INT AS bin FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source NULLS LAST) AS rn FROM d GROUP BY source),
w AS (SELECT *, [5.0, 2.0, 1.0][((rn - 1) % 3 + 1)::INT]::DOUBLE AS weight, 2.0::DOUBLE * source_size::DOUBLE AS cap FROM s),
l AS (SELECT *, row_number() OVER o AS place,
        (1.5::DOUBLE * (sum(source_size) OVER ())::DOUBLE - coalesce(sum(cap) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0))
        / sum(weight) OVER (o ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
      FROM w WINDOW o AS (ORDER BY cap / weight, rn)),
t AS (SELECT *, CASE WHEN cap / weight > level THEN weight * (SELECT arg_min(level, place) FROM l WHERE cap / weight > level) ELSE cap END AS target FROM l),
r AS (SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size)::BIGINT ELSE 0 END AS whole FROM t),
b AS (SELECT source, bin, sum(size)::BIGINT AS words, (sum(sum(size)) OVER (PARTITION BY source ORDER BY bin))::BIGINT AS upto FROM d GROUP BY source, bin),
c AS (SELECT b.source, min(bin) AS last_bin, arg_min((target - whole * source_size - (upto - words)) / words, bin) AS part
      FROM b JOIN r ON b.source IS NOT DISTINCT FROM r.source
      WHERE upto - words < target - whole * source_size AND target - whole * source_size <= upto GROUP BY b.source)
SELECT d.doc_id, d.size, r.source_size, r.target,
  (d.size * r.whole + CASE WHEN d.bin < coalesce(c.last_bin, -1) THEN d.size WHEN d.bin = c.last_bin THEN floor(d.size * c.part + 0.5)::BIGINT ELSE 0 END)::BIGINT AS taken
FROM d JOIN r ON d.source IS NOT DISTINCT FROM r.source LEFT JOIN c ON d.source IS NOT DISTINCT FROM c.source
"""

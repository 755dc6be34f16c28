"""Stored hits by pattern, so that a changed lexicon scans again only what has changed.

What a pattern finds in a text depends on its expression, the engine, the windows and the cap: these make its fingerprint. Tiers, annex
numbers and context rules are read off stored contexts, so a change of these needs no text, nor does a new id. Documents come
in batches (a day, a folder); a batch and a fingerprint are scanned once.

    {root}/hits/{scan}/     what a scan found (FOUND), sorted by fingerprint within each file, so that row groups are skipped
    {root}/done/            batch, fingerprint, scan; appended when the hits of a scan are complete

A scan that fails leaves a folder that no line of done names: it is not read, and the next call scans again. Two calls at a time
for one batch may both scan; one of them is read. (seq_documento, key) names a document: rows that share it have their hits in
common when summed up. Null and empty texts have no hits. Documents that only the prefilter's relaxed expressions match have no
hit either, so near misses of that kind come from scanning texts (lexicon.outputs), not from here.
"""

from __future__ import annotations

import hashlib
import uuid
from functools import reduce

import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schemas
from ..sources.config import Lexicon, Pattern
from . import lexicon as L

FOUND = schemas.flat("fingerprint string, seq_documento bigint, key string, start bigint, match string, context string")
DONE = schemas.flat("batch string, fingerprint string, scan string")


def fingerprint(pattern: Pattern, lexicon: Lexicon) -> str:
    """Of all that decides what the pattern finds and how its contexts are cut."""
    what = (pattern.regex, *(int(lexicon.option(o)) for o in ("window_before", "window_after", "max_hits_per_pattern")))
    if (engine := lexicon.option("engine")) != "python":
        what += (engine,)
    return hashlib.sha256(repr(what).encode()).hexdigest()[:32]


def by_fingerprint(lexicon: Lexicon) -> dict[str, list[Pattern]]:
    """Patterns by fingerprint; those of equal expressions share one."""
    out: dict[str, list[Pattern]] = {}
    for p in lexicon.patterns:
        out.setdefault(fingerprint(p, lexicon), []).append(p)
    return out


def done(spark: SparkSession, root: str) -> DataFrame:
    """Which fingerprint of which batch is in which scan; the first by name, where several did the same."""
    try:
        lines = spark.read.schema(DONE).parquet(f"{root}/done")
    except AnalysisException as e:  # nothing has been scanned yet
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        lines = spark.createDataFrame([], DONE)
    return lines.groupBy("batch", "fingerprint").agg(F.min("scan").alias("scan"))


def to_scan(spark: SparkSession, root: str, batch: str, lexicon: Lexicon) -> list[Pattern]:
    """The patterns, one a fingerprint, that the batch has not been scanned with."""
    held = {r.fingerprint for r in done(spark, root).where(F.col("batch") == batch).collect()}
    return [p[0] for f, p in by_fingerprint(lexicon).items() if f not in held]


def scan_changed(docs: DataFrame, lexicon: Lexicon, root: str, batch: str) -> list[str]:
    """Scan docs (seq_documento, key, text), all of the batch, with the patterns it has not been scanned with; their ids.

    One pass over the texts, no shuffle: each task sorts and writes what it found.
    """
    spark = docs.sparkSession
    new = to_scan(spark, root, batch, lexicon)
    if not new:
        return []
    bare = Lexicon(lexicon.version, tuple(new), options=lexicon.options)
    scan = uuid.uuid4().hex
    prints = F.create_map(*(F.lit(x) for p in new for x in (p.id, fingerprint(p, lexicon))))
    found = docs.select("seq_documento", "key", F.inline(L.all_hits(F.col("text"), bare)))
    found.select(prints[F.col("pattern_id")].alias("fingerprint"), "seq_documento", "key", "start", "match", "context").to(FOUND).sortWithinPartitions("fingerprint").write.parquet(f"{root}/hits/{scan}")
    spark.createDataFrame([(batch, fingerprint(p, lexicon), scan) for p in new], DONE).coalesce(1).write.mode("append").parquet(f"{root}/done")
    return [p.id for p in new]


def judged(pattern_id: Column, context: Column, lexicon: Lexicon) -> Column:
    """struct<negated_hint, excluded_by> of hits, by the lexicon's rules."""
    scanner = L.Scanner(lexicon, ())

    @F.arrow_udf("struct<negated_hint: boolean, excluded_by: string>")
    def rules(ids: pa.Array, contexts: pa.Array) -> pa.Array:
        kind = pa.struct([("negated_hint", pa.bool_()), ("excluded_by", pa.string())])
        return pa.array([scanner.judged(i, c) for i, c in zip(ids.to_pylist(), contexts.to_pylist())], kind)

    return rules(pattern_id, context)


def stored_hits(spark: SparkSession, root: str, lexicon: Lexicon) -> DataFrame:
    """schemas.HITS of all batches, as a scan of their texts with the lexicon would give them; no text is read.

    An error where a batch has not been scanned with one of the patterns. The driver holds the lines of done alone, of which
    there are as many as batches times patterns.
    """
    wanted = by_fingerprint(lexicon)
    lines = done(spark, root)
    batches = {r.batch for r in lines.select("batch").distinct().collect()}
    held = lines.where(F.col("fingerprint").isin(*wanted)).collect()
    if short := sorted(batches - {b for b in batches if sum(r.batch == b for r in held) == len(wanted)}):
        raise ValueError(f"not scanned with every pattern: {', '.join(short)}")
    scans: dict[str, set[str]] = {}
    for r in held:
        scans.setdefault(r.scan, set()).add(r.fingerprint)
    # scans that are read for the same fingerprints are read together: there are as many plans as lexicons had changes
    alike: dict[tuple[str, ...], list[str]] = {}
    for scan, prints in scans.items():
        alike.setdefault(tuple(sorted(prints)), []).append(f"{root}/hits/{scan}")
    parts = [spark.read.schema(FOUND).parquet(*sorted(paths)).where(F.col("fingerprint").isin(*prints)) for prints, paths in sorted(alike.items())]
    found = reduce(DataFrame.unionByName, parts) if parts else spark.createDataFrame([], FOUND)
    named = F.create_map(*(
        x for f, patterns in wanted.items()
        for x in (F.lit(f), F.array(*(F.struct(F.lit(p.id).alias("pattern_id"), F.lit(p.tier).alias("tier"), F.lit(";".join(map(str, p.annex_a))).alias("annex_a")) for p in patterns)))
    ))
    rows = found.select("seq_documento", "key", "start", "match", "context", F.inline(named[F.col("fingerprint")]))
    return rows.withColumn("rules", judged(F.col("pattern_id"), F.col("context"), lexicon)).select("*", "rules.*").to(schemas.HITS)


def stored_candidates(spark: SparkSession, root: str, lexicon: Lexicon) -> DataFrame:
    """schemas.CANDIDATES of all batches, from stored hits. A document has at most as many as patterns times the cap."""
    fields = [f for f in schemas.HITS.names if f not in ("seq_documento", "key")]
    each = stored_hits(spark, root, lexicon).groupBy("seq_documento", "key").agg(F.collect_list(F.struct(*fields)).alias("hits"))
    return L.summaries(each, lexicon).where("is_candidate")

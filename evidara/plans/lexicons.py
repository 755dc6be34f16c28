"""Lexicon scans over documents, conversations and pages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import corpus, figures, rescan
from ..operators import lexicon as L
from ..operators.sampling import top_per_key
from ..session import scratch
from ..sources.config import load_lexicon
from .tables import LEXICON, SQL_ENGINE, table, texts

#: The lexicon without context rules, which SQL cannot follow, for the queries that SQL checks.
PLAIN = load_lexicon({"version": "plain-1", "patterns": [{"id": p.id, "tier": p.tier, "regex": p.regex, "annex_a": list(p.annex_a)} for p in LEXICON.patterns], "options": SQL_ENGINE})
PLACES = load_lexicon({"version": "places-1", "patterns": [{"id": "link", "tier": "strict", "regex": r'href="/[a-z]+'}], "options": SQL_ENGINE})


#: Words that wide_lexicon builds its patterns from.
WORDS = ("the", "of", "and", "to", "in", "is", "that", "it", "for", "was", "on", "with", "be", "by", "as", "this", "are", "at", "from", "an")
#: Patterns of each tier in a lexicon of the size that is in use: 53 in all.
MIX = {"strict": 7, "conduct": 18, "sanction": 8, "normative": 14, "neighbour": 6}


def wide_lexicon():
    """53 patterns by rule: a word, a stretch without a full stop, and one of two other words; in every third an alternation."""
    patterns, n = [], len(WORDS)
    for i, tier in enumerate(t for t, k in MIX.items() for _ in range(k)):
        a, b, c = WORDS[i % n], WORDS[(3 * i + 1) % n], WORDS[(7 * i + 2) % n]
        regex = rf"\b{a}\s+(?:{b}|{c})tion" if i % 3 else rf"\b{a}{b}\b[^.]{{0,40}}?\b{c}{a}"
        patterns.append({"id": f"p{i:02d}", "tier": tier, "regex": regex, "annex_a": [i % 20 + 1]})
    return load_lexicon({"version": "wide-1", "patterns": patterns, "options": SQL_ENGINE})


WIDE = wide_lexicon()
#: LEXICON before two of its patterns, a tier and the rules were changed.
EARLIER = load_lexicon({
    "version": "demo-0",
    "patterns": [
        {"id": "insult", "tier": "conduct", "regex": r"\bidiot\b"},
        {"id": "code", "tier": "normative", "regex": r"Apache License"},
        *({"id": p.id, "tier": "neighbour", "regex": p.regex} for p in LEXICON.patterns if p.id not in ("insult", "code")),
    ],
    "exclusions": [{"id": "all", "regex": r".", "applies_to": ["secret"]}],
    "options": LEXICON.options,
})


def _hits(regex: str, column: str = "text") -> str:
    return f"least(3, len(regexp_extract_all({column}, '(?is){regex}')))"


_N = {p.id: _hits(p.regex) for p in PLAIN.patterns}
_CANDIDATE = f"({' + '.join(_N[p.id] for p in PLAIN.of_tiers(PLAIN.candidate_tiers))}) > 0"


def _prefilter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return texts(spark, sf_dir).where(L.may_match(F.col("text"), LEXICON)).select("seq_documento", "key")


def _candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    scanned = L.scan(texts(spark, sf_dir), PLAIN)
    return L.summaries(scanned, PLAIN).where("is_candidate").drop("lexicon_version")


def _near_miss(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Prefiltered documents that are no candidates once exclusions apply."""
    return L.summaries(L.scan(texts(spark, sf_dir), LEXICON), LEXICON).where("NOT is_candidate")


def _hits_with_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.hit_rows(L.scan(texts(spark, sf_dir), LEXICON))


def _pattern_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.pattern_counts(L.hit_rows(texts(spark, sf_dir).withColumn("hits", L.all_hits(F.col("text"), PLAIN))))


def _by_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    every = texts(spark, sf_dir).withColumn("hits", L.all_hits(F.col("text"), PLAIN))
    c = L.summaries(every, PLAIN)
    return c.groupBy(F.col("key").alias("source")).agg(
        F.count("*").alias("documents"), F.count_if("is_candidate").alias("candidates"), F.round(100 * F.count_if("is_candidate") / F.count("*"), 2).alias("pct"),
        F.count_if("strict_hit").alias("strict"), F.count_if(F.col("strict_hit") & F.col("conduct_hit")).alias("strict_and_conduct"), F.count_if(F.col("strict_hit") & ~F.col("conduct_hit")).alias("strict_only"),
    )


def _first_places(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First link of each page: its match and start."""
    p = table(spark, sf_dir, "pages").withColumn("h", F.get(L.hits_of(F.col("html"), PLACES), F.lit(0))).where("h IS NOT NULL")
    return p.select("page_id", F.col("h.match").alias("match"), F.col("h.start").alias("start"))


def _conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "conversations").withColumn("hits", L.all_hits(F.col("text"), PLAIN))
    return c.groupBy("role").agg(F.count("*").alias("turns"), F.count_if(F.size("hits") > 0).alias("with_hits"), F.sum(F.size("hits")).cast("bigint").alias("hits"))


def _top_contexts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first three hits of each document by tier, then place, side by side."""
    hits = L.hit_rows(L.scan(texts(spark, sf_dir), LEXICON)).where("excluded_by IS NULL")
    rank = F.when(F.col("tier") == "strict", 0).when(F.col("tier") == "conduct", 1).when(F.col("tier") == "sanction", 2).otherwise(3)
    return top_per_key(hits, ["key", "seq_documento"], [F.col("negated_hint"), rank, F.col("start"), F.col("pattern_id")], 3, ["pattern_id", "context"])


def _marked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with a match of one pattern, its matches marked."""
    d = texts(spark, sf_dir).withColumn("hits", L.hits_of(F.col("text"), PLAIN, only=("insult",), prefilter=("strict",))).where("size(hits) > 0")
    return d.select("seq_documento", L.marked(F.col("text"), L.hit_spans(F.col("text"), PLAIN, ("insult",))).alias("marked"))


def _decision_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents as decision summaries of several fields."""
    i, t = F.col("doc_id"), F.col("text")
    return table(spark, sf_dir, "documents").select(
        F.concat(F.lit("e"), i.cast("string")).alias("espelho_id"), F.col("lang").alias("orgao_slug"), F.when(i % 5 > 0, t).alias("ementa"), F.when(i % 3 == 0, t).alias("decisao"),
        F.when(i % 7 == 0, F.lit("A moron")).alias("notas"), F.when(i % 2 == 0, F.lit("was WORTHLESS.")).alias("informacoes_complementares"),
    )


def _decision_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = corpus.scan_decisions(_decision_texts(spark, sf_dir), LEXICON)["candidates"]
    return c.select("seq_documento", "key", "n_hits", "n_patterns", "patterns", "negated_all", "n_excluded")


def _wide(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Candidates of a lexicon of 53 patterns."""
    c = L.summaries(L.scan(texts(spark, sf_dir), WIDE), WIDE).where("is_candidate")
    return c.select("seq_documento", "n_hits", "n_patterns", "patterns", "strict_hit", "conduct_hit")


def _figure_tiers(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = texts(spark, sf_dir).withColumn("year", (2019 + F.col("seq_documento") % 6).cast("string")).withColumn("hits", L.all_hits(F.col("text"), PLAIN))
    return figures.tiers_by_year(L.summaries(d, PLAIN, ("year",)))


def _figure_patterns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return figures.pattern_bars(_pattern_counts(spark, sf_dir), top=4)


def _inspect(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hits of one pattern by language, small cells left out."""
    d = texts(spark, sf_dir).withColumn("hits", L.all_hits(F.col("text"), PLAIN, ("scorn",)))
    return d.groupBy("lang").agg(F.count_if(F.size("hits") > 0).alias("documents"), F.sum(F.size("hits")).cast("bigint").alias("hits")).where("documents >= 5")


def _rescanned(spark: SparkSession, sf_dir: str) -> str:
    """The folder of a store of two batches, one of which was scanned with an earlier lexicon first."""
    root = scratch(spark, "hits")
    odd = F.col("seq_documento") % 2 == 1
    rescan.scan_changed(texts(spark, sf_dir).where(odd), EARLIER, root, "odd")
    rescan.scan_changed(texts(spark, sf_dir).where(odd), LEXICON, root, "odd")
    rescan.scan_changed(texts(spark, sf_dir).where(~odd | odd.isNull()), LEXICON, root, "other")
    return root


def _rescan_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rescan.stored_hits(spark, _rescanned(spark, sf_dir), LEXICON)


def _rescan_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rescan.stored_candidates(spark, _rescanned(spark, sf_dir), LEXICON)


QUERIES = {
    "lexicon_rescan_hits": _rescan_hits,
    "lexicon_rescan_candidates": _rescan_candidates,
    "lexicon_prefilter": _prefilter,
    "lexicon_candidates": _candidates,
    "lexicon_near_miss": _near_miss,
    "lexicon_hits": _hits_with_context,
    "lexicon_pattern_counts": _pattern_counts,
    "lexicon_by_source": _by_source,
    "lexicon_first_places": _first_places,
    "lexicon_conversations": _conversations,
    "lexicon_top_contexts": _top_contexts,
    "lexicon_marked": _marked,
    "lexicon_inspect": _inspect,
    "lexicon_decisions": _decision_candidates,
    "lexicon_wide": _wide,
    "figure_tiers": _figure_tiers,
    "figure_patterns": _figure_patterns,
}


def _sum(ids) -> str:
    return " + ".join(_N[i] for i in ids) or "0"


_IDS = [p.id for p in PLAIN.patterns]
_LIST = lambda pairs: "array_to_string(list_sort(list_distinct(list_filter([" + ", ".join(f"CASE WHEN {_N[i]} > 0 THEN '{v}' END" for i, v in pairs) + "], lambda x: x IS NOT NULL))), ';')"
_ANNEX = "array_to_string(list_transform(list_sort(list_distinct(list_filter([" + ", ".join(f"CASE WHEN {_N[p.id]} > 0 THEN {a} END" for p in PLAIN.patterns for a in p.annex_a) + "], lambda x: x IS NOT NULL))), lambda x: x::VARCHAR), ';')"
_FLAG = {p.tier: f"{_N[p.id]} > 0" for p in PLAIN.patterns}
#: All white space that Python knows, for expressions in SQL.
_SPACES = r"[\s\p{Z}\x0b\x1c-\x1f\x{85}]+"
_MAYBE = "regexp_matches(text, '(?is)" + "|".join(f"({p.regex})" for p in LEXICON.of_tiers(LEXICON.candidate_tiers)).replace("{0,40}?", "*?") + "')"


def _found(source: str) -> str:
    """CTEs that end in h, all hits of LEXICON in source (seq, key, text), with places and context rules.

    The text is cut at the matches; the lengths of the cuts and matches before one give its start.
    """
    each = " UNION ALL ".join(
        f"SELECT seq, key, text, '{p.id}' AS pattern_id, '{p.tier}' AS tier, '{';'.join(map(str, p.annex_a))}' AS annex_a, regexp_extract_all(text, '(?is){p.regex}') AS m, string_split_regex(text, '(?is){p.regex}') AS cuts FROM {source} WHERE text <> ''"
        for p in LEXICON.patterns
    )
    chars = "coalesce(list_sum(list_transform({}, lambda z: length(z))), 0)"
    before, after, most = (LEXICON.option(o) for o in ("window_before", "window_after", "max_hits_per_pattern"))
    excluded = " ".join(f"WHEN pattern_id IN ({', '.join(repr(a) for a in r.applies_to)}) AND regexp_matches(context, '(?is){r.regex}') THEN '{r.id}'" for r in LEXICON.exclusions)
    negated = " OR ".join(f"regexp_matches(context, '(?is){r.regex}')" for r in LEXICON.negations)
    return f"""every AS ({each}), nth AS (SELECT *, unnest(range(1, least({most}, len(m)) + 1)) AS k FROM every),
        placed AS (SELECT *, ({chars.format('cuts[1:k]')} + {chars.format('m[1:k - 1]')})::BIGINT AS start FROM nth),
        around AS (SELECT *, trim(regexp_replace(substr(text, greatest(0, start - {before}) + 1, start + length(m[k]) + {after} - greatest(0, start - {before})), '{_SPACES}', ' ', 'g')) AS context FROM placed),
        h AS (SELECT seq AS seq_documento, key, pattern_id, tier, annex_a, start, trim(regexp_replace(m[k], '{_SPACES}', ' ', 'g')) AS match, context, {negated} AS negated_hint, CASE {excluded} END AS excluded_by FROM around)"""


_LEX = f"WITH src AS (SELECT doc_id AS seq, source AS key, text FROM documents WHERE {_MAYBE}), {_found('src')}"
_KEPT = "h.pattern_id IS NOT NULL AND excluded_by IS NULL"
_OWN = f"{_KEPT} AND tier IN ({', '.join(repr(t) for t in LEXICON.candidate_tiers)})"
_SUMMARY = f"""SELECT seq AS seq_documento, src.key, count(*) FILTER ({_KEPT}) AS n_hits, count(DISTINCT pattern_id) FILTER ({_KEPT}) AS n_patterns, coalesce(string_agg(DISTINCT pattern_id, ';' ORDER BY pattern_id) FILTER ({_KEPT}), '') AS patterns,
    coalesce(string_agg(DISTINCT tier, ';' ORDER BY tier) FILTER ({_KEPT}), '') AS tiers,
    array_to_string(list_transform(list_sort(list_distinct(list_transform(list_filter(string_split(coalesce(string_agg(annex_a, ';') FILTER ({_KEPT}), ''), ';'), lambda x: x <> ''), lambda x: x::INT))), lambda x: x::VARCHAR), ';') AS annex_a_items,
    {', '.join(f"coalesce(bool_or(tier = '{t}') FILTER ({_KEPT}), false) AS {t}_hit" for t in L.TIERS)}, count(*) FILTER ({_OWN}) > 0 AND count(*) FILTER ({_OWN} AND NOT negated_hint) = 0 AS negated_all,
    count(excluded_by) AS n_excluded, count(*) FILTER ({_OWN}) > 0 AS is_candidate, '{LEXICON.version}' AS lexicon_version FROM src LEFT JOIN h ON seq = seq_documento AND src.key = h.key GROUP BY ALL"""
_TIER_RANK = "CASE tier WHEN 'strict' THEN 0 WHEN 'conduct' THEN 1 WHEN 'sanction' THEN 2 ELSE 3 END"
_DECIDED = """WITH src AS (SELECT 0 AS seq, lang || ':e' || doc_id AS key, CASE WHEN doc_id % 5 > 0 THEN coalesce(text, '') ELSE '' END || ' ' || CASE WHEN doc_id % 3 = 0 THEN coalesce(text, '') ELSE '' END || ' '
    || CASE WHEN doc_id % 7 = 0 THEN 'A moron' ELSE '' END || ' ' || CASE WHEN doc_id % 2 = 0 THEN 'was WORTHLESS.' ELSE '' END AS text FROM documents)"""
_W = {p.id: _hits(p.regex) for p in WIDE.patterns}
_WIDE_SUM = "(SELECT doc_id, " + ", ".join(f"{n} AS {i}" for i, n in _W.items()) + " FROM documents)"
_of = lambda tiers: " + ".join(p.id for p in WIDE.of_tiers(tiers))
_EVERY = f"WITH src AS (SELECT doc_id AS seq, source AS key, text FROM documents), {_found('src')}"
ORACLE_SQL = {
    "lexicon_rescan_hits": f"{_EVERY} SELECT * FROM h",
    "lexicon_rescan_candidates": f"{_EVERY} SELECT * FROM ({_SUMMARY}) WHERE is_candidate",
    "lexicon_hits": f"{_LEX} SELECT * FROM h",
    "lexicon_near_miss": f"{_LEX} SELECT * FROM ({_SUMMARY}) WHERE NOT is_candidate",
    "lexicon_top_contexts": f"{_LEX}, r AS (SELECT *, row_number() OVER (PARTITION BY key, seq_documento ORDER BY negated_hint, {_TIER_RANK}, start, pattern_id) AS place FROM h WHERE excluded_by IS NULL) SELECT key, seq_documento, "
    + ", ".join(f"max(pattern_id) FILTER (place = {i}) AS pattern_id_{i}, max(context) FILTER (place = {i}) AS context_{i}" for i in (1, 2, 3)) + " FROM r WHERE place <= 3 GROUP BY ALL",
    "lexicon_decisions": f"{_DECIDED}, {_found('src')} SELECT seq_documento::BIGINT AS seq_documento, key, n_hits, n_patterns, patterns, negated_all, n_excluded FROM ({_SUMMARY}) WHERE is_candidate",
    "lexicon_wide": f"""SELECT doc_id AS seq_documento, ({_of(None)})::BIGINT AS n_hits, ({' + '.join(f'({i} > 0)::INT' for i in _W)})::BIGINT AS n_patterns, array_to_string(list_filter([{', '.join(f"CASE WHEN {i} > 0 THEN '{i}' END" for i in _W)}], lambda x: x IS NOT NULL), ';') AS patterns,
        {_of(('strict',))} > 0 AS strict_hit, {_of(('conduct',))} > 0 AS conduct_hit FROM {_WIDE_SUM} WHERE {_of(WIDE.candidate_tiers)} > 0""",
    "figure_tiers": f"SELECT (2019 + doc_id % 6)::VARCHAR AS year, {', '.join(f'count(*) FILTER ({_FLAG[t]}) AS {t}' for t in ('strict', 'conduct', 'sanction'))} FROM documents GROUP BY 1",
    "figure_patterns": "SELECT * FROM (" + " UNION ALL ".join(f"SELECT '{p.id}' AS pattern_id, '{p.tier}' AS tier, count(*) AS documents FROM documents WHERE {_N[p.id]} > 0" for p in PLAIN.patterns) + ") WHERE documents >= 5 ORDER BY documents DESC, pattern_id LIMIT 4",
    "lexicon_prefilter": f"SELECT doc_id AS seq_documento, source AS key FROM documents WHERE {_MAYBE}",
    "lexicon_candidates": f"""SELECT doc_id AS seq_documento, source AS key, ({_sum(_IDS)})::BIGINT AS n_hits, ({' + '.join(f'({_N[i]} > 0)::INT' for i in _IDS)})::BIGINT AS n_patterns,
        {_LIST([(i, i) for i in _IDS])} AS patterns, {_LIST([(p.id, p.tier) for p in PLAIN.patterns])} AS tiers, {_ANNEX} AS annex_a_items,
        {', '.join(f'{c} AS {t}_hit' for t, c in _FLAG.items())}, false AS negated_all, 0::BIGINT AS n_excluded, true AS is_candidate FROM documents WHERE {_CANDIDATE}""",
    "lexicon_pattern_counts": " UNION ALL ".join(
        f"SELECT '{p.id}' AS pattern_id, '{p.tier}' AS tier, count(*) AS documents, sum(n)::BIGINT AS hits, 0.0::DOUBLE AS pct_negated, 0::BIGINT AS dropped FROM (SELECT {_N[p.id]} AS n FROM documents) WHERE n > 0 HAVING count(*) > 0" for p in PLAIN.patterns
    ),
    "lexicon_by_source": f"""SELECT source, count(*) AS documents, count(*) FILTER ({_CANDIDATE}) AS candidates, round(100 * count(*) FILTER ({_CANDIDATE}) / count(*), 2)::DOUBLE AS pct,
        count(*) FILTER ({_FLAG['strict']}) AS strict, count(*) FILTER ({_FLAG['strict']} AND {_FLAG['conduct']}) AS strict_and_conduct, count(*) FILTER ({_FLAG['strict']} AND NOT {_FLAG['conduct']}) AS strict_only FROM documents GROUP BY source""",
    "lexicon_first_places": """SELECT page_id, m AS match, (strpos(html, m) - 1)::BIGINT AS start FROM (SELECT page_id, html, regexp_extract(html, '(?is)href="/[a-z]+') AS m FROM pages) WHERE m <> ''""",
    "lexicon_conversations": f"SELECT role, count(*) AS turns, count(*) FILTER (n > 0) AS with_hits, sum(n)::BIGINT AS hits FROM (SELECT role, {_sum(_IDS)} AS n FROM conversations) GROUP BY role",
    "lexicon_marked": r"SELECT doc_id AS seq_documento, regexp_replace(text, '(?is)\b(idiot|moron)\b', '[[\1]]', 'g') AS marked FROM documents WHERE regexp_matches(text, '(?is)\b(idiot|moron)\b')",
    "lexicon_inspect": f"SELECT lang, count(*) FILTER (n > 0) AS documents, sum(n)::BIGINT AS hits FROM (SELECT lang, {_N['scorn']} AS n FROM documents) GROUP BY lang HAVING count(*) FILTER (n > 0) >= 5",
}

"""Linkage, coverage, integrity and reports over the order tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import corpus, linkage, quality, sampling, sketches, validation
from ..session import stored
from .tables import table


def _orders_by_year(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").withColumn("year", F.year("o_orderdate").cast("string"))


def _coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders of each year that have a returned line."""
    lines = table(spark, sf_dir, "lineitem").where("l_returnflag = 'R'").select(F.col("l_orderkey").alias("o_orderkey"))
    return linkage.coverage(_orders_by_year(spark, sf_dir), lines, ["o_orderkey"], ["year"])


def _linked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders with each of their urgent lines' suppliers: the fan-out is meant."""
    o = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("numero_registro"), F.col("o_orderkey").alias("seq_documento"), F.col("o_orderpriority").alias("key"))
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("numero_registro"), "c_nationkey")
    l = table(spark, sf_dir, "lineitem").where("l_quantity > 49").select(F.col("l_orderkey").alias("seq_documento"), F.lit("1-URGENT").alias("key"), "l_suppkey", "l_linenumber")
    return linkage.linked(o, c, l)


def _overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    known = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k"))
    return linkage.overlap(known, table(spark, sf_dir, "orders").where("o_totalprice > 400000").select(F.col("o_custkey").alias("k")), "k")


def _agreement(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts and suppliers' lines: whether a part was returned, in early and in late lines."""
    l = table(spark, sf_dir, "lineitem").withColumn("returned", F.col("l_returnflag") == "R")
    return linkage.agreement(l.where("l_linenumber <= 2"), l.where("l_linenumber > 2"), "l_partkey", "returned")


def _integrity(spark: SparkSession, sf_dir: str) -> DataFrame:
    o, l, c, e = (table(spark, sf_dir, t) for t in ("orders", "lineitem", "customer", "events"))
    return quality.named_counts({
        "lines without an order": linkage.orphans(l.withColumnRenamed("l_orderkey", "o_orderkey"), o, ["o_orderkey"]),
        "orders without a customer": linkage.orphans(o.withColumnRenamed("o_custkey", "c_custkey"), c, ["c_custkey"]),
        "customers without an order": linkage.orphans(c.withColumnRenamed("c_custkey", "o_custkey"), o, ["o_custkey"]),
        "duplicate line numbers": quality.duplicates(l, ["l_orderkey", "l_linenumber"]),
        "events out of order": quality.backward_steps(e, ["user_id"], ["event_id"], "ts"),
        "events without a user": e.where("user_id IS NULL"),
    })


def _duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts are counted by digest: they never leave the task that reads them."""
    return quality.duplicates(table(spark, sf_dir, "documents").select(F.sha2("text", 256).alias("digest")), ["digest"])


def _suppressed(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    return quality.suppressed(o, ["o_orderstatus", "o_orderpriority"], 1020, total=F.round(F.sum("o_totalprice"), 0), mean=F.round(F.avg("o_totalprice"), 1), middle=F.median("o_totalprice"))


def _top(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.top_groups(table(spark, sf_dir, "lineitem"), "l_suppkey", 15)


def _text_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("seq_documento"), F.col("source").alias("key"))
    return quality.text_coverage(d, table(spark, sf_dir, "labels").select(F.col("doc_id").alias("seq_documento")))


def _low_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.low_coverage(_text_coverage(spark, sf_dir))


def _latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.latest(table(spark, sf_dir, "events").select("user_id", "event_type", "ts", "event_id"), ["user_id", "event_type"], "event_id")


def _undone(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source")
    return quality.undone(docs, table(spark, sf_dir, "labels"), ["doc_id"])


def _quota(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders of low priority matched to urgent ones by status and year."""
    o = _orders_by_year(spark, sf_dir)
    pool, wanted = o.where("o_orderpriority = '5-LOW'"), o.where("o_orderpriority = '1-URGENT' AND o_totalprice > 300000")
    return sampling.quota_matched(pool, wanted, ["o_orderstatus", "year"], 0.5, 7, ["o_orderkey"]).select("o_orderkey", "o_orderstatus", "year", "quota", "place")


def _sums(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conditional sums, boolean maximum and joined distinct values in one pass; distinct lines from pairs of their own."""
    l = table(spark, sf_dir, "lineitem")
    lines = l.select("l_suppkey", "l_orderkey", "l_linenumber").distinct().groupBy("l_suppkey").agg(F.count("*").alias("lines"))
    sums = l.groupBy("l_suppkey").agg(
        F.count("*").alias("n"), F.count_if(F.col("l_returnflag") == "R").alias("returned"), F.max(F.col("l_quantity") > 49).alias("any_large"),
        F.array_join(F.array_sort(F.collect_set("l_linestatus")), ";").alias("statuses"), F.min("l_shipdate").alias("first_ship"), F.round(100.0 * F.count_if(F.col("l_returnflag") == "R") / F.nullif(F.count("*"), F.lit(0)), 1).alias("pct"),
    )
    return sums.join(lines, "l_suppkey")


def _terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The commonest values of some fields, and the rows without one."""
    o = table(spark, sf_dir, "orders").select("o_orderstatus", F.when(F.col("o_orderkey") % 7 > 0, F.col("o_orderpriority")).alias("o_orderpriority"), "o_custkey")
    return quality.terms(o, ["o_orderstatus", "o_orderpriority", "o_custkey"], 4)


def _decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as decisions: a year that some lack, a theme and citations that some have."""
    o, i = table(spark, sf_dir, "orders"), F.col("o_orderkey")
    return o.select(
        F.concat(F.lit("d"), i.cast("string")).alias("espelho_id"), F.lower("o_orderstatus").alias("orgao_slug"), F.when(i % 9 > 0, F.col("o_custkey").cast("string")).alias("numero_registro"),
        F.when(i % 11 > 0, F.col("o_orderdate").cast("date")).alias("data_publicacao"), F.when(i % 3 == 0, F.col("o_orderpriority")).alias("tema"), (i % 4).cast("int").alias("n_citations"),
    )


def _decision_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus.decision_stats(_decisions(spark, sf_dir))


def _sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers with orders in both years, only the first, only the second."""
    o = _orders_by_year(spark, sf_dir)
    a, b = (o.where(F.col("year") == y).select("o_custkey").distinct() for y in ("1996", "1997"))
    named = lambda df, n: df.withColumn("part", F.lit(n))
    return named(a.intersect(b), "both").unionByName(named(a.subtract(b), "first")).unionByName(named(b.subtract(a), "second"))


def _filtered(spark: SparkSession, sf_dir: str, priority: str | None = None, year: tuple[str, str] = ("1995", "1996")) -> DataFrame:
    """Orders by optional conditions; years compare as texts."""
    o = _orders_by_year(spark, sf_dir).where(F.substring("year", 1, 4).between(*year))
    o = o if priority is None else o.where(F.col("o_orderpriority") == priority)
    return o.groupBy("year", "o_orderpriority").agg(F.count("*").alias("n"))


def _lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").where("l_orderkey = 7124 AND l_linenumber = 7").select("l_orderkey", "l_linenumber", "l_partkey", "l_quantity").orderBy("l_partkey").limit(1)


def _ranked(spark: SparkSession, sf_dir: str) -> DataFrame:
    l = table(spark, sf_dir, "lineitem")
    return sampling.top_per_key(l, ["l_suppkey"], [F.col("l_extendedprice").desc(), F.col("l_orderkey"), F.col("l_linenumber"), F.col("l_partkey")], 3, ["l_orderkey", "l_extendedprice"])


def _props(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A field of the events' JSON, extracted in code generation."""
    k = F.get_json_object("props", "$.k").try_cast("int")
    return table(spark, sf_dir, "events").groupBy((F.floor(k / 10) * 10).cast("bigint").alias("k_from")).agg(F.count("*").alias("n"), F.round(F.avg("value"), 4).alias("mean_value"))


def _profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.field_profile(table(spark, sf_dir, "orders"), ["o_custkey", "o_orderstatus", "o_orderpriority"])


def _target_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers of each segment that have an event."""
    found = table(spark, sf_dir, "events").select(F.col("user_id").alias("c_custkey"))
    return linkage.coverage(table(spark, sf_dir, "customer"), found, ["c_custkey"], ["c_mktsegment"])


def _case_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events a user, by the segment of the customer of that number alone."""
    e = table(spark, sf_dir, "events").groupBy("user_id").agg(F.count("*").alias("events"), F.max("ts").alias("last"))
    j = e.join(table(spark, sf_dir, "customer").withColumnRenamed("c_custkey", "user_id"), "user_id")
    return j.groupBy("c_mktsegment").agg(F.count("*").alias("users"), F.round(F.avg("events"), 2).alias("mean_events"), F.median("events").alias("median_events"), F.max("last").alias("last"))


def _linkage_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxic documents (confirmed), those with a link (a customer of their number), those with a case (an event of it)."""
    gold = table(spark, sf_dir, "labels").where("toxic = 1").select(F.col("doc_id").cast("string").alias("doc_id"), F.lit("S3").alias("status"))
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("doc_id"), (F.col("doc_id") % 600).alias("numero_registro"))
    links = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("numero_registro"), F.col("c_custkey").alias("cnj_digits"), (F.col("c_nationkey") < 20).alias("cnj_valid"))
    cases = table(spark, sf_dir, "events").select(F.col("user_id").alias("numero_processo"))
    return validation.linkage_rates(gold, docs, links, cases)


def _sketched(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers of each year and of the next, exactly, and whether sketches by year and status agree within their error."""
    o, lg_k = table(spark, sf_dir, "orders").select(F.year("o_orderdate").alias("year"), "o_orderstatus", "o_custkey"), 8
    fine = stored(sketches.key_sketches(o, "o_custkey", ["year", "o_orderstatus"], lg_k), "sketches")
    years = sketches.merged(fine, ["year"], lg_k)
    after = years.select((F.col("year") - 1).alias("year"), F.col("sketch").alias("next"))
    told = years.join(after, "year").select("year", *sketches.estimates(F.col("sketch"), F.col("next"), lg_k))
    each = o.select("year", "o_custkey", F.lit(1).alias("own"), F.lit(0).alias("next")).union(o.select(F.col("year") - 1, "o_custkey", F.lit(0), F.lit(1)))
    keys = each.groupBy("year", "o_custkey").agg(F.max("own").alias("a"), F.max("next").alias("b"))
    exact = keys.groupBy("year").agg(F.sum(F.col("a") * F.col("b")).alias("n_both"), F.sum(F.col("a") * (1 - F.col("b"))).alias("n_known"), F.sum((1 - F.col("a")) * F.col("b")).alias("n_new"))
    near = lambda c, n: F.abs(F.col(c) - F.col(n)) <= F.col("error")
    return exact.join(told, "year").select("year", "n_both", "n_known", "n_new", (near("both", "n_both") & near("only_known", "n_known") & near("only_new", "n_new")).alias("within"))


QUERIES = {
    "field_terms": _terms, "decision_stats": _decision_stats, "field_profile": _profile, "target_coverage": _target_coverage, "case_stats": _case_stats, "linkage_rates": _linkage_rates,
    "link_coverage": _coverage, "linked_documents": _linked, "key_overlap": _overlap, "source_agreement": _agreement, "integrity_checks": _integrity,
    "duplicate_texts": _duplicates, "suppressed_report": _suppressed, "top_groups": _top, "text_coverage": _text_coverage, "low_coverage": _low_coverage,
    "latest_run": _latest, "undone_work": _undone, "quota_matched_draw": _quota, "conditional_sums": _sums, "set_operations": _sets, "parameter_filter": _filtered,
    "sketch_overlap": _sketched, "point_lookup": _lookup, "top_per_key": _ranked, "event_properties": _props,
}
_TC = "SELECT source AS key, count(*) AS meta_rows, count(l.doc_id) AS text_rows, round(100.0 * count(l.doc_id) / count(*), 1)::DOUBLE AS pct FROM documents d LEFT JOIN (SELECT DISTINCT doc_id FROM labels) l ON d.doc_id = l.doc_id GROUP BY source"
_VALUES = {"o_orderstatus": "o_orderstatus", "o_orderpriority": "CASE WHEN o_orderkey % 7 > 0 THEN o_orderpriority END", "o_custkey": "o_custkey::VARCHAR"}
_D = """WITH d AS (SELECT lower(o_orderstatus) AS body, CASE WHEN o_orderkey % 9 > 0 THEN o_custkey END AS reg, CASE WHEN o_orderkey % 11 > 0 THEN year(o_orderdate)::VARCHAR END AS y, o_orderkey % 3 = 0 AS themed, o_orderkey % 4 > 0 AS citing FROM orders)"""
_DS = "count(*) AS decisions, count(*) FILTER (themed) AS with_theme, count(*) FILTER (citing) AS with_citations, count(DISTINCT reg) AS registrations"
ORACLE_SQL = {
    "sketch_overlap": """WITH k AS (SELECT DISTINCT year(o_orderdate)::INT AS year, o_custkey AS c FROM orders), y AS (SELECT DISTINCT year FROM k)
        SELECT year, (count(*) FILTER (a AND b))::BIGINT AS n_both, (count(*) FILTER (a AND NOT b))::BIGINT AS n_known, (count(*) FILTER (b AND NOT a))::BIGINT AS n_new, true AS within
        FROM (SELECT year, c, bool_or(a) AS a, bool_or(NOT a) AS b FROM (SELECT year, c, true AS a FROM k UNION ALL SELECT year - 1, c, false FROM k) GROUP BY year, c)
        WHERE year IN (SELECT year FROM y) AND year + 1 IN (SELECT year FROM y) GROUP BY year""",
    "field_terms": " UNION ALL ".join(f"SELECT * FROM (SELECT '{c}' AS field, {v} AS value, count(*) AS n FROM orders WHERE {v} IS NOT NULL GROUP BY 2 ORDER BY n DESC, value LIMIT 4) UNION ALL SELECT '{c}', NULL, count(*) FROM orders WHERE {v} IS NULL HAVING count(*) > 0" for c, v in _VALUES.items()),
    "decision_stats": f"{_D} SELECT 'all' AS part, NULL::VARCHAR AS name, {_DS} FROM d UNION ALL SELECT 'year', y, {_DS} FROM d WHERE y IS NOT NULL GROUP BY y UNION ALL SELECT 'body', body, {_DS} FROM d GROUP BY body",
    "field_profile": " UNION ALL ".join(f"SELECT '{c}' AS field, count(*) AS rows, count({c}) AS filled, count(*) - count({c}) AS missing, count(DISTINCT {c}) AS distinct_values FROM orders" for c in ("o_custkey", "o_orderstatus", "o_orderpriority")),
    "target_coverage": "SELECT c_mktsegment, count(*) AS n, count(u) AS matched, round(100.0 * count(u) / count(*), 1)::DOUBLE AS pct FROM customer LEFT JOIN (SELECT DISTINCT user_id AS u FROM events) ON u = c_custkey GROUP BY 1",
    "case_stats": "SELECT c_mktsegment, count(*) AS users, round(avg(n), 2) AS mean_events, median(n)::DOUBLE AS median_events, max(last) AS last FROM (SELECT user_id, count(*) AS n, max(ts) AS last FROM events GROUP BY 1) JOIN customer ON c_custkey = user_id GROUP BY 1",
    "linkage_rates": """SELECT count(*) AS confirmed, count(k) AS bridged, count(u) AS found, round(count(k) / count(*), 4)::DOUBLE AS bridge_rate, round(count(u) / nullif(count(k), 0), 4)::DOUBLE AS trajectory_rate
        FROM labels LEFT JOIN (SELECT c_custkey AS k FROM customer WHERE c_nationkey < 20) ON k = doc_id % 600 LEFT JOIN (SELECT DISTINCT user_id AS u FROM events) ON u = k WHERE toxic = 1""",
    "link_coverage": """SELECT year(o_orderdate)::VARCHAR AS year, count(*) AS n, count(k) AS matched, round(100.0 * count(k) / count(*), 1)::DOUBLE AS pct
        FROM orders LEFT JOIN (SELECT DISTINCT l_orderkey AS k FROM lineitem WHERE l_returnflag = 'R') ON k = o_orderkey GROUP BY 1""",
    "linked_documents": """SELECT o_custkey AS numero_registro, o_orderkey AS seq_documento, o_orderpriority AS key, c_nationkey, l_suppkey, l_linenumber
        FROM orders JOIN customer ON c_custkey = o_custkey LEFT JOIN lineitem ON l_orderkey = o_orderkey AND l_quantity > 49 AND o_orderpriority = '1-URGENT'""",
    "key_overlap": """SELECT count(*) FILTER (a IS NOT NULL AND b IS NOT NULL) AS both, count(*) FILTER (b IS NULL) AS only_known, count(*) FILTER (a IS NULL) AS only_new
        FROM (SELECT DISTINCT c_custkey AS a FROM customer) FULL JOIN (SELECT DISTINCT o_custkey AS b FROM orders WHERE o_totalprice > 400000) ON a = b""",
    "source_agreement": """WITH a AS (SELECT l_partkey, max(l_returnflag = 'R') AS l FROM lineitem WHERE l_linenumber <= 2 GROUP BY 1), b AS (SELECT l_partkey, max(l_returnflag = 'R') AS r FROM lineitem WHERE l_linenumber > 2 GROUP BY 1)
        SELECT count(*) AS shared, count(*) FILTER (l AND r) AS both_flagged, count(*) FILTER (l AND NOT r) AS left_only, count(*) FILTER (NOT l AND r) AS right_only, count(*) FILTER (NOT l AND NOT r) AS neither,
        round(100.0 * count(*) FILTER (l = r) / count(*), 1)::DOUBLE AS pct_agree FROM a JOIN b USING (l_partkey)""",
    "integrity_checks": """SELECT 'lines without an order' AS "check", count(*) AS violations FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders)
        UNION ALL SELECT 'orders without a customer', count(*) FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer)
        UNION ALL SELECT 'customers without an order', count(*) FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)
        UNION ALL SELECT 'duplicate line numbers', count(*) FROM (SELECT 1 FROM lineitem GROUP BY l_orderkey, l_linenumber HAVING count(*) > 1)
        UNION ALL SELECT 'events out of order', count(*) FROM (SELECT ts, lag(ts) OVER (PARTITION BY user_id ORDER BY event_id) AS b FROM events) WHERE ts < b
        UNION ALL SELECT 'events without a user', count(*) FROM events WHERE user_id IS NULL""",
    "duplicate_texts": "SELECT sha256(text) AS digest, count(*) AS n FROM documents GROUP BY text HAVING count(*) > 1",
    "suppressed_report": "SELECT o_orderstatus, o_orderpriority, count(*) AS n, round(sum(o_totalprice), 0) AS total, round(avg(o_totalprice), 1) AS mean, median(o_totalprice) AS middle FROM orders GROUP BY ALL HAVING count(*) >= 1020",
    "top_groups": "SELECT l_suppkey, count(*) AS n FROM lineitem GROUP BY 1 ORDER BY n DESC, l_suppkey LIMIT 15",
    "text_coverage": _TC,
    "low_coverage": f"SELECT * FROM ({_TC}) WHERE meta_rows > 0 AND text_rows < 0.5 * meta_rows",
    "latest_run": "SELECT user_id, event_type, arg_max(ts, event_id) AS ts, max(event_id) AS event_id FROM events GROUP BY 1, 2",
    "undone_work": "SELECT doc_id, source FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)",
    "quota_matched_draw": """WITH q AS (SELECT o_orderstatus, year(o_orderdate)::VARCHAR AS year, ceil(count(*) * 0.5)::BIGINT AS quota FROM orders WHERE o_orderpriority = '1-URGENT' AND o_totalprice > 300000 GROUP BY ALL)
        SELECT o_orderkey, o_orderstatus, year, quota, place FROM (SELECT o.o_orderkey, o.o_orderstatus, q.year, quota,
          (row_number() OVER (PARTITION BY o.o_orderstatus, q.year ORDER BY md5(o_orderkey::VARCHAR || '-7'), o_orderkey))::INT AS place
          FROM orders o JOIN q ON o.o_orderstatus = q.o_orderstatus AND year(o_orderdate)::VARCHAR = q.year WHERE o_orderpriority = '5-LOW') WHERE place <= quota""",
    "conditional_sums": """SELECT l_suppkey, count(*) AS n, count(*) FILTER (l_returnflag = 'R') AS returned, max(l_quantity > 49) AS any_large, count(DISTINCT l_orderkey || '-' || l_linenumber) AS lines,
        string_agg(DISTINCT l_linestatus, ';' ORDER BY l_linestatus) AS statuses, min(l_shipdate) AS first_ship, round(100.0 * count(*) FILTER (l_returnflag = 'R') / nullif(count(*), 0), 1)::DOUBLE AS pct FROM lineitem GROUP BY 1""",
    "set_operations": """WITH a AS (SELECT DISTINCT o_custkey FROM orders WHERE year(o_orderdate) = 1996), b AS (SELECT DISTINCT o_custkey FROM orders WHERE year(o_orderdate) = 1997)
        SELECT o_custkey, 'both' AS part FROM (SELECT * FROM a INTERSECT SELECT * FROM b) UNION ALL SELECT o_custkey, 'first' FROM (SELECT * FROM a EXCEPT SELECT * FROM b) UNION ALL SELECT o_custkey, 'second' FROM (SELECT * FROM b EXCEPT SELECT * FROM a)""",
    "parameter_filter": "SELECT year(o_orderdate)::VARCHAR AS year, o_orderpriority, count(*) AS n FROM orders WHERE year(o_orderdate) BETWEEN 1995 AND 1996 GROUP BY ALL",
    "point_lookup": "SELECT l_orderkey, l_linenumber, l_partkey, l_quantity FROM lineitem WHERE l_orderkey = 7124 AND l_linenumber = 7 ORDER BY l_partkey LIMIT 1",
    "top_per_key": """SELECT l_suppkey, """ + ", ".join(f"max(l_orderkey) FILTER (k = {i}) AS l_orderkey_{i}, max(l_extendedprice) FILTER (k = {i}) AS l_extendedprice_{i}" for i in (1, 2, 3)) + """
        FROM (SELECT *, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber, l_partkey) AS k FROM lineitem) WHERE k <= 3 GROUP BY 1""",
    "event_properties": "SELECT (floor((props ->> '$.k')::INT / 10) * 10)::BIGINT AS k_from, count(*) AS n, round(avg(value), 4) AS mean_value FROM events GROUP BY 1",
}

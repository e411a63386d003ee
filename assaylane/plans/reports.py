"""Reports by group: spreads of values, tiers, coverage of a lookup, and whether a reference lies within its group's range."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import dedup, quality, summaries
from ..operators.quantiles import exact_quantiles
from .curation import content_verdict
from .registry import CENSORED_SQL, QUERIES, SQL, query, rounded, table
from .statistics import censored

_SPREAD = "round(quantile_cont({x}, 0.5), 4) AS median, round(quantile_cont({x}, 0.25), 4) AS q1, round(quantile_cont({x}, 0.75), 4) AS q3"


def _spread(rows, value, by):
    q = exact_quantiles(rows, value, [0.5, 0.25, 0.75], by)
    return rounded(q.select(*by, "n", *[F.col("q")[i].alias(c) for i, c in enumerate(("median", "q1", "q3"))]), "median", "q1", "q3", places=4)


@query("uncensored_spread", f"""
SELECT l_returnflag, count(*) AS n, {_SPREAD.format(x="l_extendedprice")}, (SELECT count(*) FROM lineitem x WHERE x.l_returnflag = l.l_returnflag) AS n_all
FROM lineitem l WHERE NOT {CENSORED_SQL} GROUP BY l_returnflag""")
def uncensored_spread(spark, d):
    """Median and quartiles of the measured values of each label, and how many rows of it there are with the censored ones."""
    rows = censored(table(spark, d, "lineitem"))
    sizes = rows.groupBy("l_returnflag").agg(F.count(F.lit(1)).alias("n_all"))
    return _spread(rows.where("not censored"), "l_extendedprice", ["l_returnflag"]).join(sizes, "l_returnflag")


_TIER = "CASE WHEN l_extendedprice < 20000 THEN 'strong' WHEN l_extendedprice < 60000 THEN 'middle' ELSE 'weak' END"


@query("tier_spread", f"SELECT {_TIER} AS tier, l_linenumber, count(*) AS n, {_SPREAD.format(x='l_quantity')} FROM lineitem GROUP BY ALL")
def tier_spread(spark, d):
    """Median and quartiles of a score by the tier of the value and by length."""
    price = F.col("l_extendedprice")
    tier = F.when(price < 20000, "strong").when(price < 60000, "middle").otherwise("weak")
    return _spread(table(spark, d, "lineitem").withColumn("tier", tier), "l_quantity", ["tier", "l_linenumber"])


@query("coverage_report", """
WITH s AS (SELECT p_brand, p_type, l_partkey, p_size FROM lineitem JOIN part ON l_partkey = p_partkey)
SELECT p_brand, count(*) AS n, count(*) FILTER (p_size > 10) AS n_covered, round(count(*) FILTER (p_size > 10) / count(*), 6) AS share,
  count(DISTINCT p_type) AS n_items, count(DISTINCT CASE WHEN p_size <= 10 THEN p_type END) AS n_items_missing FROM s GROUP BY p_brand""")
def coverage_report(spark, d):
    """How many rows and items of each group a lookup covers; here the sizes over 10 are those it knows."""
    parts = table(spark, d, "part").select(F.col("p_partkey").alias("l_partkey"), "p_brand", "p_type", (F.col("p_size") > 10).alias("known"))
    rows = table(spark, d, "lineitem").select("l_partkey").join(parts, "l_partkey")
    # counts by item first: the items of a group are then few, however many its rows
    items = rows.groupBy("p_brand", "p_type").agg(F.count(F.lit(1)).alias("n"), F.count_if("known").alias("n_covered"))
    found = items.groupBy("p_brand").agg(F.sum("n").alias("n"), F.sum("n_covered").alias("n_covered"), F.count(F.lit(1)).alias("n_items"), F.count_if(F.col("n_covered") < F.col("n")).alias("n_items_missing"))
    return rounded(found.withColumn("share", F.col("n_covered") / F.col("n")), "share")


@query("reference_in_range", """
WITH ref AS (SELECT l_orderkey, arg_min(l_extendedprice, (l_linenumber, l_partkey, l_suppkey, l_extendedprice)) AS ref, min((l_linenumber, l_partkey, l_suppkey, l_extendedprice)) AS k FROM lineitem GROUP BY 1),
o AS (SELECT r.l_orderkey, ref, min(l_extendedprice) AS low, max(l_extendedprice) AS high FROM ref r LEFT JOIN lineitem l ON l.l_orderkey = r.l_orderkey AND (l_linenumber, l_partkey, l_suppkey, l_extendedprice) <> k GROUP BY ALL)
SELECT l_orderkey, ref, low, high, coalesce(ref BETWEEN low AND high, false) AS within FROM o""")
def reference_in_range(spark, d):
    """Whether the first member of each ensemble lies within the range of the others."""
    key = F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")
    rows = table(spark, d, "lineitem").select("l_orderkey", "l_extendedprice", key.alias("k"))
    ref = rows.groupBy(F.col("l_orderkey").alias("o")).agg(F.min("k").alias("first"))
    others = rows.join(ref, F.col("l_orderkey") == F.col("o"))
    price = F.when(F.col("k") != F.col("first"), F.col("l_extendedprice"))
    found = others.groupBy("l_orderkey").agg(F.max(F.col("first.l_extendedprice")).alias("ref"), F.min(price).alias("low"), F.max(price).alias("high"))
    return found.withColumn("within", F.coalesce(F.col("ref").between(F.col("low"), F.col("high")), F.lit(False)))


@query("verdict_shares", "WITH v AS (" + SQL["content_verdict"] + ") SELECT verdict, count(*) AS n, round(count(*) / sum(count(*)) OVER (), 6) AS share FROM v GROUP BY verdict")
def verdict_shares(spark, d):
    """Content verdicts of all models, counted."""
    from pyspark.sql import Window

    counts = content_verdict(spark, d).groupBy("verdict").agg(F.count(F.lit(1)).alias("n"))
    return rounded(counts.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy())), "share")  # a row for each verdict


@query("duplicate_members", "SELECT l_partkey, l_suppkey, l_orderkey, l_linenumber, n_rows FROM (SELECT *, count(*) OVER (PARTITION BY l_partkey, l_suppkey) AS n_rows FROM lineitem) WHERE n_rows > 1")
def duplicate_members(spark, d):
    return dedup.duplicate_members(table(spark, d, "lineitem"), ["l_partkey", "l_suppkey"]).select("l_partkey", "l_suppkey", "l_orderkey", "l_linenumber", "n_rows")


_NAMES = "SELECT p_partkey, 'A*' || lpad(CAST(p_size AS VARCHAR), 2, '0') || ':' || lpad(CAST(p_partkey % 7 AS VARCHAR), 2, '0') || ':01' || CASE WHEN p_partkey % 11 = 0 THEN 'N' WHEN p_partkey % 13 = 0 THEN 'Q' ELSE '' END AS allele, repeat('G', 150 + CAST(p_partkey % 60 AS INTEGER)) AS sequence FROM part"


@query("suffixed_names", f"""
WITH a AS ({_NAMES}), k AS (SELECT *, split_part(allele, ':', 1) || ':' || split_part(allele, ':', 2) AS allele_name, abs(length(sequence) - 181) AS away FROM a WHERE NOT regexp_matches(split_part(allele, '*', 2), '[NSCAQ]'))
SELECT p_partkey, allele_name FROM (SELECT *, min(away) OVER (PARTITION BY allele_name) AS least FROM k) WHERE away = least""")
def suffixed_names(spark, d):
    """Names without expression suffixes, cut to two fields; of equal ones the sequences nearest in length to 181."""
    key = F.col("p_partkey")
    suffix = F.when(key % 11 == 0, "N").when(key % 13 == 0, "Q").otherwise("")
    name = F.concat(F.lit("A*"), F.lpad(F.col("p_size").cast("string"), 2, "0"), F.lit(":"), F.lpad((key % 7).cast("string"), 2, "0"), F.lit(":01"), suffix)
    rows = table(spark, d, "part").select("p_partkey", name.alias("allele"), F.repeat(F.lit("G"), 150 + (key % 60).cast("int")).alias("sequence"))
    return dedup.drop_suffixed(rows, "allele", "sequence").select("p_partkey", "allele_name")


@query("totals_tie", """
SELECT 'lines tie to orders' AS expectation, CAST(count(*) FILTER (a <> b) AS BIGINT) AS violations, count(*) FILTER (a <> b) = 0 AS holds
FROM (SELECT (SELECT count(DISTINCT l_orderkey) FROM lineitem) AS a, (SELECT count(*) FROM orders) AS b)""")
def totals_tie(spark, d):
    return quality.expect_total(table(spark, d, "lineitem"), "lines tie to orders", F.count_distinct("l_orderkey"), table(spark, d, "orders"), F.count(F.lit(1)))


@query("ordered_columns", "SELECT c_name, c_custkey, c_nationkey FROM customer")
def ordered_columns(spark, d):
    return summaries.ordered_columns(table(spark, d, "customer").select("c_custkey", "c_name", "c_nationkey"), ["c_name", "absent", "c_custkey"])


__all__ = ["QUERIES"]

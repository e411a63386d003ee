"""Queries for joins, set operations, sorting, top-k, composition and scalar functions."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import predicates, scalars
from ..operators import joins, summaries
from .registry import query, rounded, table


@query("inner_match", """
SELECT o_orderkey, c_name, o_totalprice FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_orderpriority = '1-URGENT'""")
def inner_match(spark, d):
    orders = table(spark, d, "orders").where("o_orderpriority = '1-URGENT'")
    return joins.attach(orders, table(spark, d, "customer"), {"o_custkey": "c_custkey"}, how="inner").select("o_orderkey", "c_name", "o_totalprice")


@query("left_attach", """
SELECT o_orderkey, n, total FROM orders LEFT JOIN (SELECT l_orderkey, count(*) AS n, round(sum(l_extendedprice), 2) AS total FROM lineitem GROUP BY 1) ON o_orderkey = l_orderkey""")
def left_attach(spark, d):
    sums = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("l_extendedprice"), 2).alias("total"))
    return joins.attach(table(spark, d, "orders"), sums, {"o_orderkey": "l_orderkey"}).select("o_orderkey", "n", "total")


@query("multi_key_float_join", """
WITH f AS (SELECT DISTINCT l_partkey, l_suppkey, l_returnflag, l_extendedprice FROM lineitem WHERE l_discount >= 0.09)
SELECT l.l_returnflag, count(*) AS n, count(f.l_partkey) AS n_flagged FROM lineitem l LEFT JOIN f USING (l_partkey, l_suppkey, l_returnflag, l_extendedprice) GROUP BY 1""")
def multi_key_float_join(spark, d):
    keys = ["l_partkey", "l_suppkey", "l_returnflag", "l_extendedprice"]
    rows = table(spark, d, "lineitem")
    flags = rows.where("l_discount >= 0.09").select(*keys).distinct().withColumn("flagged", F.lit(True))
    found = joins.attach(rows, flags, keys)
    return found.groupBy("l_returnflag").agg(F.count(F.lit(1)).alias("n"), F.count_if(~predicates.not_flagged(F.col("flagged"))).alias("n_flagged"))


@query("lookup_fallback", """
WITH s AS (SELECT n_nationkey, nullif(n_name, 'NATION_3') AS n_name FROM nation WHERE n_regionkey <> 4)
SELECT CASE WHEN n_nationkey IS NULL THEN 'not in table' ELSE coalesce(n_name, 'unclassified') END AS label, count(*) AS n FROM customer LEFT JOIN s ON c_nationkey = n_nationkey GROUP BY 1""")
def lookup_fallback(spark, d):
    nations = table(spark, d, "nation").where("n_regionkey <> 4").withColumn("n_name", F.nullif("n_name", F.lit("NATION_3")))
    found = joins.lookup(table(spark, d, "customer"), "c_nationkey", nations, "n_nationkey", "n_name", missing="not in table", empty="unclassified", out="label")
    return found.groupBy("label").agg(F.count(F.lit(1)).alias("n"))


@query("semi_known", "SELECT o_orderkey, o_totalprice FROM orders WHERE EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_quantity >= 49)")
def semi_known(spark, d):
    big = table(spark, d, "lineitem").where("l_quantity >= 49").select(F.col("l_orderkey").alias("o_orderkey"))
    return joins.known(table(spark, d, "orders"), big, ["o_orderkey"]).select("o_orderkey", "o_totalprice")


@query("anti_orphans", "SELECT o_orderkey, o_orderstatus FROM orders WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey)")
def anti_orphans(spark, d):
    lines = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"))
    return joins.orphans(table(spark, d, "orders"), lines, ["o_orderkey"]).select("o_orderkey", "o_orderstatus")


@query("anti_stray", "SELECT l_orderkey FROM lineitem WHERE NOT EXISTS (SELECT 1 FROM orders WHERE l_orderkey = o_orderkey)")
def anti_stray(spark, d):
    orders = table(spark, d, "orders").select(F.col("o_orderkey").alias("l_orderkey"))
    return joins.orphans(table(spark, d, "lineitem"), orders, ["l_orderkey"]).select("l_orderkey")


@query("fanout_guard", "SELECT l_partkey, l_suppkey, count(DISTINCT l_returnflag) AS n_values FROM lineitem GROUP BY 1, 2 HAVING count(DISTINCT l_returnflag) > 1")
def fanout_guard(spark, d):
    return joins.ambiguous_keys(table(spark, d, "lineitem"), ["l_partkey", "l_suppkey"], "l_returnflag")


@query("self_comparison", """
WITH a AS (SELECT l_suppkey, avg(l_extendedprice) AS x FROM lineitem WHERE l_linestatus = 'O' GROUP BY 1), b AS (SELECT l_suppkey, avg(l_extendedprice) AS x FROM lineitem WHERE l_linestatus = 'F' GROUP BY 1)
SELECT a.l_suppkey, round(a.x, 4) AS first, round(b.x, 4) AS second, round(abs(a.x - b.x), 4) AS difference, b.x < a.x AS better FROM a JOIN b USING (l_suppkey)""")
def self_comparison(spark, d):
    side = lambda s, n: table(spark, d, "lineitem").where(F.col("l_linestatus") == s).groupBy("l_suppkey").agg(F.avg("l_extendedprice").alias(n))
    both = side("O", "first").join(side("F", "second"), "l_suppkey")
    return rounded(both.withColumns({"difference": F.abs(F.col("first") - F.col("second")), "better": F.col("second") < F.col("first")}), "first", "second", "difference", places=4)


@query("listed_membership", """
WITH lists AS (SELECT n_regionkey, string_agg(n_name, ' ' ORDER BY n_nationkey) AS names FROM nation GROUP BY 1)
SELECT n_name, l.n_regionkey AS found_in FROM nation JOIN lists l ON list_contains(string_split(names, ' '), n_name)""")
def listed_membership(spark, d):
    nations = table(spark, d, "nation")
    gathered = F.transform(F.sort_array(F.collect_list(F.struct("n_nationkey", "n_name"))), lambda x: x["n_name"])
    lists = nations.groupBy(F.col("n_regionkey").alias("found_in")).agg(F.array_join(gathered, " ").alias("names"))
    return joins.in_listed(nations.select("n_name"), "n_name", lists, "names", "all_names").select("n_name", "found_in")


@query("union_all_sources", """
SELECT 'customer' AS source, c_name AS name, c_acctbal AS balance, c_mktsegment AS segment FROM customer UNION ALL SELECT 'supplier', s_name, s_acctbal, NULL FROM supplier""")
def union_all_sources(spark, d):
    a = table(spark, d, "customer").select(F.lit("customer").alias("source"), F.col("c_name").alias("name"), F.col("c_acctbal").alias("balance"), F.col("c_mktsegment").alias("segment"))
    b = table(spark, d, "supplier").select(F.lit("supplier").alias("source"), F.col("s_name").alias("name"), F.col("s_acctbal").alias("balance"))
    return a.unionByName(b, allowMissingColumns=True)


@query("except_both_ways", """
WITH c AS (SELECT DISTINCT c_nationkey AS k FROM customer WHERE c_acctbal > 9000), s AS (SELECT DISTINCT s_nationkey AS k FROM supplier WHERE s_acctbal > 5000)
SELECT 'first only' AS side, k FROM (SELECT k FROM c EXCEPT SELECT k FROM s) UNION ALL SELECT 'second only', k FROM (SELECT k FROM s EXCEPT SELECT k FROM c) UNION ALL SELECT 'both', k FROM (SELECT k FROM c INTERSECT SELECT k FROM s)""")
def except_both_ways(spark, d):
    c = table(spark, d, "customer").where("c_acctbal > 9000").select(F.col("c_nationkey").alias("k")).distinct()
    s = table(spark, d, "supplier").where("s_acctbal > 5000").select(F.col("s_nationkey").alias("k")).distinct()
    tag = lambda df, n: df.select(F.lit(n).alias("side"), "k")
    return tag(c.subtract(s), "first only").unionByName(tag(s.subtract(c), "second only")).unionByName(tag(c.intersect(s), "both"))


@query("sort_nulls_last", """
SELECT p_partkey, x, CAST(row_number() OVER (ORDER BY x DESC NULLS LAST, p_partkey) AS INTEGER) AS place FROM (SELECT p_partkey, CASE WHEN p_size > 10 THEN p_retailprice END AS x FROM part) ORDER BY x DESC NULLS LAST, p_partkey LIMIT 50""")
def sort_nulls_last(spark, d):
    rows = table(spark, d, "part").select("p_partkey", F.when(F.col("p_size") > 10, F.col("p_retailprice")).alias("x"))
    top = rows.orderBy(F.col("x").desc_nulls_last(), "p_partkey").limit(50)
    return top.withColumn("place", F.row_number().over(Window.orderBy(F.col("x").desc_nulls_last(), "p_partkey")))


@query("offset_limit", "SELECT s_suppkey, s_acctbal FROM supplier ORDER BY s_acctbal DESC, s_suppkey LIMIT 3 OFFSET 1")
def offset_limit(spark, d):
    return table(spark, d, "supplier").orderBy(F.desc("s_acctbal"), "s_suppkey").offset(1).limit(3).select("s_suppkey", "s_acctbal")


@query("top3_bottom1", """
WITH b AS (SELECT p_brand, count(*) AS n, avg(p_retailprice) AS m FROM part GROUP BY 1 HAVING count(*) >= 50)
SELECT p_brand, n, round(m, 4) AS m FROM (SELECT * FROM b ORDER BY m DESC, p_brand LIMIT 3) UNION SELECT p_brand, n, round(m, 4) FROM (SELECT * FROM b ORDER BY m, p_brand LIMIT 1)""")
def top3_bottom1(spark, d):
    b = table(spark, d, "part").groupBy("p_brand").agg(F.count(F.lit(1)).alias("n"), F.avg("p_retailprice").alias("m")).where("n >= 50")
    return rounded(b.orderBy(F.desc("m"), "p_brand").limit(3).unionByName(b.orderBy("m", "p_brand").limit(1)).distinct(), "m", places=4)


@query("top_k_per_group", """
SELECT p_brand, p_partkey, p_retailprice, CAST(rank AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY p_retailprice DESC, p_partkey) AS rank FROM part) WHERE rank <= 3""")
def top_k_per_group(spark, d):
    return joins.top_k_per(table(spark, d, "part"), ["p_brand"], [F.desc("p_retailprice"), F.asc("p_partkey")], 3).select("p_brand", "p_partkey", "p_retailprice", "rank")


@query("top_n_other", """
WITH c AS (SELECT p_type, count(*) AS n FROM part GROUP BY 1), r AS (SELECT *, row_number() OVER (ORDER BY n DESC, p_type) AS rn FROM c)
SELECT CASE WHEN rn <= 5 THEN p_type ELSE 'Other' END AS p_type, CAST(sum(n) AS BIGINT) AS n FROM r GROUP BY 1""")
def top_n_other(spark, d):
    return summaries.top_and_other(table(spark, d, "part").groupBy("p_type").agg(F.count(F.lit(1)).alias("n")), "p_type", "n", 5)


@query("counts_sorted", "SELECT o_orderpriority, count(*) AS n FROM orders GROUP BY 1 ORDER BY n DESC, 1")
def counts_sorted(spark, d):
    return table(spark, d, "orders").groupBy("o_orderpriority").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "o_orderpriority")


@query("composition_table", """
SELECT c_mktsegment, count(*) AS n, count(DISTINCT o_custkey) AS n_items, count(*) FILTER (o_orderstatus = 'O') AS n_o, count(*) FILTER (o_orderstatus = 'F') AS n_f, count(*) FILTER (o_orderstatus = 'P') AS n_p,
  min(o_totalprice) AS low, max(o_totalprice) AS high, round(count(*) / sum(count(*)) OVER (), 6) AS share FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1""")
def composition_table(spark, d):
    rows = table(spark, d, "orders").join(table(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    return rounded(summaries.composition(rows, "c_mktsegment", "o_custkey", "o_orderstatus", ["O", "F", "P"], "o_totalprice"), "share")


@query("pivot_counts", """
SELECT o_orderpriority, count(*) FILTER (o_orderstatus = 'F') AS f, count(*) FILTER (o_orderstatus = 'O') AS o, count(*) FILTER (o_orderstatus = 'P') AS p, count(*) FILTER (o_orderstatus = 'X') AS x FROM orders GROUP BY 1""")
def pivot_counts(spark, d):
    wide = table(spark, d, "orders").groupBy("o_orderpriority").pivot("o_orderstatus", ["F", "O", "P", "X"]).count().na.fill(0)
    return wide.toDF("o_orderpriority", "f", "o", "p", "x")


@query("share_of_total", "SELECT c_nationkey, count(*) AS n, round(count(*) / sum(count(*)) OVER (), 6) AS share FROM customer GROUP BY 1")
def share_of_total(spark, d):
    n = table(spark, d, "customer").groupBy("c_nationkey").agg(F.count(F.lit(1)).alias("n"))
    return rounded(n.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy())), "share")


@query("grouped_counts", """
SELECT l_returnflag, l_linestatus, count(*) AS n, CAST(grouping(l_linestatus) AS TINYINT) AS pooled FROM lineitem GROUP BY GROUPING SETS ((l_returnflag), (l_returnflag, l_linestatus))""")
def grouped_counts(spark, d):
    rows = table(spark, d, "lineitem")
    return rows.groupingSets([["l_returnflag"], ["l_returnflag", "l_linestatus"]], "l_returnflag", "l_linestatus").agg(F.count(F.lit(1)).alias("n"), F.grouping("l_linestatus").alias("pooled"))


@query("range_labels", """
SELECT p_brand, CAST(min(p_size) AS VARCHAR) || '-' || CAST(max(p_size) AS VARCHAR) AS sizes, count(DISTINCT p_type) AS n_types, arg_min(p_name, p_partkey) AS first_name FROM part GROUP BY 1""")
def range_labels(spark, d):
    sizes = F.concat(F.min("p_size").cast("string"), F.lit("-"), F.max("p_size").cast("string"))
    return table(spark, d, "part").groupBy("p_brand").agg(sizes.alias("sizes"), F.count_distinct("p_type").alias("n_types"), F.min_by("p_name", "p_partkey").alias("first_name"))


@query("tier_case", """
WITH x AS (SELECT CASE WHEN l_linenumber = 7 THEN NULL ELSE l_quantity * 2 END AS identity, l_discount * 25 AS rmsd FROM lineitem)
SELECT CASE WHEN identity IS NULL THEN 'no_template' WHEN rmsd > 2 THEN 'outlier' WHEN identity >= 80 THEN 'high' WHEN identity <= 35 THEN 'low' ELSE 'moderate' END AS tier, count(*) AS n FROM x GROUP BY 1""")
def tier_case(spark, d):
    rows = table(spark, d, "lineitem").select(F.when(F.col("l_linenumber") != 7, F.col("l_quantity") * 2).alias("i"), (F.col("l_discount") * 25).alias("r"))
    return rows.groupBy(predicates.confidence_tier(F.col("i"), F.col("r")).alias("tier")).agg(F.count(F.lit(1)).alias("n"))


@query("interval_bins", """
SELECT CAST(CASE WHEN l_quantity BETWEEN 1 AND 10 THEN 0 WHEN l_quantity > 10 AND l_quantity <= 25 THEN 1 WHEN l_quantity > 25 AND l_quantity <= 49 THEN 2 END AS INTEGER) AS bin, count(*) AS n FROM lineitem GROUP BY 1""")
def interval_bins(spark, d):
    return table(spark, d, "lineitem").groupBy(predicates.right_closed_bin(F.col("l_quantity"), [1, 10, 25, 49]).alias("bin")).agg(F.count(F.lit(1)).alias("n"))


@query("label_canonicalise", """
SELECT CASE o_orderstatus WHEN 'O' THEN 'open' WHEN 'F' THEN 'final' ELSE o_orderstatus END AS label, count(*) AS n FROM orders GROUP BY 1""")
def label_canonicalise(spark, d):
    return table(spark, d, "orders").groupBy(predicates.canonical_label(F.col("o_orderstatus"), {"O": "open", "F": "final"}).alias("label")).agg(F.count(F.lit(1)).alias("n"))


@query("regex_filters", """
SELECT count(*) FILTER (o_orderpriority LIKE '1-%' OR o_orderpriority LIKE '2-%') AS n_prefix, count(*) FILTER (contains(o_orderpriority, 'LOW')) AS n_contains,
  count(*) FILTER (regexp_full_match(o_orderpriority, '[0-9]-[A-Z]+')) AS n_full, count(*) FILTER (regexp_matches(o_orderpriority, '\\bSPECIFIED\\b')) AS n_word FROM orders""")
def regex_filters(spark, d):
    p = F.col("o_orderpriority")
    found = [predicates.any_prefix(p, ["1-", "2-"]), p.contains("LOW"), predicates.full_match(p, "[0-9]-[A-Z]+"), p.rlike(r"\bSPECIFIED\b")]
    return table(spark, d, "orders").agg(*[F.count_if(c).alias(n) for c, n in zip(found, ["n_prefix", "n_contains", "n_full", "n_word"], strict=True)])


@query("try_cast_numeric", r"""
WITH x AS (SELECT event_type, regexp_extract(props, '[0-9]+(\.[0-9]+)?', 0) AS a, props AS b FROM events)
SELECT event_type, count(TRY_CAST(a AS DOUBLE)) AS n_numbers, count(TRY_CAST(b AS DOUBLE)) AS n_whole, count(*) AS n FROM x GROUP BY 1""")
def try_cast_numeric(spark, d):
    rows = table(spark, d, "events").select("event_type", F.regexp_extract("props", r"[0-9]+(\.[0-9]+)?", 0).alias("a"), F.col("props").alias("b"))
    return rows.groupBy("event_type").agg(F.count(scalars.to_number(F.col("a"))).alias("n_numbers"), F.count_if(scalars.is_number(F.col("b"))).alias("n_whole"), F.count(F.lit(1)).alias("n"))


@query("code_normalise", """
WITH x AS (SELECT p_partkey, 'HLA-A*' || lpad(CAST(p_size AS VARCHAR), 2, '0') || ':' || lpad(CAST(p_partkey % 100 AS VARCHAR), 2, '0') AS a FROM part)
SELECT p_partkey, replace(replace(regexp_replace(a, '^HLA-', ''), '*', ''), ':', '') AS compact, replace(regexp_replace(a, '^HLA-', ''), ':', '') AS four_digit, replace(replace(a, ':', '_'), '*', '_') AS file_safe,
  substr(regexp_replace(a, '^HLA-', ''), 1, 1) AS locus, array_to_string(list_slice(string_split(a || ':01', ':'), 1, 2), ':') AS two_field FROM x""")
def code_normalise(spark, d):
    pad = lambda c: F.lpad(c.cast("string"), 2, "0")
    a = F.concat(F.lit("HLA-A*"), pad(F.col("p_size")), F.lit(":"), pad(F.col("p_partkey") % 100))
    rows = table(spark, d, "part").select("p_partkey", a.alias("a"))
    x = F.col("a")
    return rows.select("p_partkey", scalars.compact_allele(x).alias("compact"), scalars.four_digit_allele(x).alias("four_digit"), scalars.file_safe_allele(x).alias("file_safe"), scalars.locus(F.regexp_replace(x, "^HLA-", "")).alias("locus"), scalars.two_field_allele(F.concat(x, F.lit(":01"))).alias("two_field"))


@query("last_token", r"""
SELECT page_id, CASE WHEN contains(url, '/') THEN list_last(string_split(url, '/')) END AS last, regexp_extract(url, '^[a-z]+', 0) AS scheme,
  sha256(url) AS digest, regexp_replace(url, '\?.*$', '') AS bare FROM pages""")
def last_token(spark, d):
    u = F.col("url")
    return table(spark, d, "pages").select("page_id", scalars.last_token(u).alias("last"), F.regexp_extract(u, "^[a-z]+", 0).alias("scheme"), F.sha2(u, 256).alias("digest"), F.regexp_replace(u, r"\?.*$", "").alias("bare"))


@query("redact_text", """
SELECT page_id, replace(replace(replace(url, 'https://', '<tls>'), 'http://', '<web>'), '/en', '<en>') AS text FROM pages""")
def redact_text(spark, d):
    return table(spark, d, "pages").select("page_id", scalars.redact(F.col("url"), [("/en", "<en>"), ("http://", "<web>"), ("https://", "<tls>")]).alias("text"))


@query("batch_ids", "SELECT p_partkey, CAST(floor((row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) - 1) / 25) + 1 AS INTEGER) AS batch FROM part")
def batch_ids(spark, d):
    place = F.row_number().over(Window.partitionBy("p_brand").orderBy("p_partkey")) - 1
    return table(spark, d, "part").select("p_partkey", (F.floor(place / 25) + 1).cast("int").alias("batch"))


@query("category_codes", "SELECT p_partkey, CAST(dense_rank() OVER (ORDER BY p_brand) - 1 AS INTEGER) AS code FROM part")
def category_codes(spark, d):
    """Codes come from the table of brands, so that no window runs over all parts."""
    parts = table(spark, d, "part")
    codes = parts.select("p_brand").distinct().withColumn("code", F.row_number().over(Window.orderBy("p_brand")) - 1)
    return parts.join(codes, "p_brand").select("p_partkey", "code")


@query("stable_seeds", "SELECT n_name, upper(n_name) AS upper_name, length(n_name) AS n_chars, md5(n_name) AS digest FROM nation")
def stable_seeds(spark, d):
    n = F.col("n_name")
    return table(spark, d, "nation").select(n, F.upper(n).alias("upper_name"), F.length(n).cast("bigint").alias("n_chars"), F.md5(n).alias("digest"))


@query("json_round_trip", """SELECT event_id, event_type, round(value, 6) AS value FROM events""")
def json_round_trip(spark, d):
    packed = table(spark, d, "events").select("event_id", F.to_json(F.struct("event_type", "value")).alias("j"))
    return rounded(packed.select("event_id", F.from_json("j", "event_type string, value double").alias("x")).select("event_id", "x.event_type", "x.value"), "value")

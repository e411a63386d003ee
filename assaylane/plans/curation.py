"""Queries for deduplication, duplicate resolution, funnels, ensembles, text sources and quality reports."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import scalars
from ..functions.predicates import is_censored
from ..operators import dedup, quality, structure, summaries
from ..operators.pairs import pair_distances
from ..sources.text import parse_scores
from .registry import CEILINGS, CENSORED_SQL, FLOOR, LINE_ORDER, LINE_ORDER_SQL, query, rounded, table


def line_order():
    return [F.col(c).asc() for c in LINE_ORDER]


@query("best_row_per_key", f"""
SELECT l_partkey, l_extendedprice, l_orderkey FROM (SELECT *, row_number() OVER (PARTITION BY l_partkey ORDER BY l_extendedprice, {LINE_ORDER_SQL}) AS rn FROM lineitem) WHERE rn = 1""")
def best_row_per_key(spark, d):
    return dedup.keep_first(table(spark, d, "lineitem"), ["l_partkey"], [F.asc("l_extendedprice"), *line_order()]).select("l_partkey", "l_extendedprice", "l_orderkey")


@query("keep_first", f"""
SELECT l_partkey, l_suppkey, l_extendedprice FROM (SELECT *, row_number() OVER (PARTITION BY l_partkey, l_suppkey ORDER BY {LINE_ORDER_SQL}) AS rn FROM lineitem) WHERE rn = 1""")
def keep_first(spark, d):
    return dedup.keep_first(table(spark, d, "lineitem"), ["l_partkey", "l_suppkey"], line_order()).select("l_partkey", "l_suppkey", "l_extendedprice")


@query("keep_last_override", """
WITH a AS (SELECT c_nationkey AS k, c_name AS name, c_acctbal AS x, 1 AS src FROM customer UNION ALL SELECT s_nationkey, s_name, s_acctbal, 2 FROM supplier)
SELECT k, name, x FROM (SELECT *, row_number() OVER (PARTITION BY k ORDER BY src DESC, name DESC) AS rn FROM a) WHERE rn = 1""")
def keep_last_override(spark, d):
    a = table(spark, d, "customer").select(F.col("c_nationkey").alias("k"), F.col("c_name").alias("name"), F.col("c_acctbal").alias("x"))
    b = table(spark, d, "supplier").select(F.col("s_nationkey").alias("k"), F.col("s_name").alias("name"), F.col("s_acctbal").alias("x"))
    return dedup.union_override(a, b, ["k"], [F.desc("name")])


@query("keep_min_ties", """
WITH x AS (SELECT l_suppkey, l_orderkey, l_linenumber, CASE WHEN l_tax > 0.07 THEN NULL ELSE l_quantity END AS q FROM lineitem)
SELECT l_suppkey, l_orderkey, l_linenumber, q FROM (SELECT *, min(q) OVER (PARTITION BY l_suppkey) AS least FROM x) WHERE q IS NULL OR q = least""")
def keep_min_ties(spark, d):
    rows = table(spark, d, "lineitem").select("l_suppkey", "l_orderkey", "l_linenumber", F.when(~(F.col("l_tax") > 0.07), F.col("l_quantity")).alias("q"))
    return dedup.keep_least(rows, ["l_suppkey"], "q")


@query("duplicate_census", "SELECT l_partkey, l_suppkey, count(*) AS n_rows FROM lineitem GROUP BY 1, 2 HAVING count(*) > 1")
def duplicate_census(spark, d):
    return dedup.duplicate_census(table(spark, d, "lineitem"), ["l_partkey", "l_suppkey"])


_RESOLVE = f"""
WITH b AS (SELECT *, l_linestatus = 'O' AS src FROM lineitem),
c AS (SELECT *, count(*) OVER w AS n, count(*) FILTER (src) OVER w AS k, max(l_extendedprice) OVER w - min(l_extendedprice) OVER w AS gap,
    row_number() OVER (PARTITION BY l_partkey, l_suppkey ORDER BY {LINE_ORDER_SQL}) AS rn, median(CASE WHEN src THEN l_extendedprice END) OVER w AS med
  FROM b WINDOW w AS (PARTITION BY l_partkey, l_suppkey)),
e AS (SELECT *, row_number() OVER (PARTITION BY l_partkey, l_suppkey, src ORDER BY abs(l_extendedprice - med) NULLS LAST, {LINE_ORDER_SQL}) AS near FROM c),
v AS (SELECT *, CASE WHEN n = 1 THEN 'keep' WHEN n = 2 AND k = 1 THEN CASE WHEN src THEN 'keep' ELSE 'drop' END
    WHEN n = 2 AND k = 0 THEN CASE WHEN gap <= 10000 AND rn = 1 THEN 'keep' ELSE 'drop' END
    WHEN n = 2 THEN CASE WHEN gap >= 10000 THEN 'flag' WHEN rn = 2 THEN 'keep' ELSE 'drop' END
    WHEN NOT src THEN 'drop' WHEN k <= 2 OR near = 1 THEN 'keep' ELSE 'drop' END AS verdict FROM e)"""


def resolved(spark, d):
    rows = table(spark, d, "lineitem").withColumn("src", F.col("l_linestatus") == "O")
    return dedup.resolve_duplicates(rows, ["l_partkey", "l_suppkey"], "l_extendedprice", "src", line_order(), tolerance=10_000.0)


@query("resolve_duplicates", _RESOLVE + " SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice, verdict FROM v")
def resolve_duplicates(spark, d):
    return resolved(spark, d).select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "verdict")


@query("resolve_flagged", _RESOLVE + " SELECT verdict, count(*) AS n, count(DISTINCT (l_partkey, l_suppkey)) AS n_keys FROM v GROUP BY 1")
def resolve_flagged(spark, d):
    return resolved(spark, d).groupBy("verdict").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("l_partkey", "l_suppkey").alias("n_keys"))


_STEPS_SQL = [("locus", "l_returnflag IN ('A', 'N')"), ("value", "l_extendedprice > 5000"), ("response", "l_discount <= 0.08"), ("uncensored", f"NOT {CENSORED_SQL}")]


def steps():
    return [("locus", F.col("l_returnflag").isin("A", "N")), ("value", F.col("l_extendedprice") > 5000), ("response", F.col("l_discount") <= 0.08), ("uncensored", ~is_censored(F.col("l_quantity"), CEILINGS, FLOOR))]


@query("attrition_funnel", "WITH f AS (SELECT 0 AS step, 'all' AS name, count(*) AS remaining FROM lineitem" + "".join(
    f" UNION ALL SELECT {i + 1}, '{n}', count(*) FROM lineitem WHERE {' AND '.join(c for _, c in _STEPS_SQL[: i + 1])}" for i, (n, _) in enumerate(_STEPS_SQL))
    + ") SELECT step, name, remaining, coalesce(lag(remaining) OVER (ORDER BY step) - remaining, 0) AS removed FROM f")
def attrition_funnel(spark, d):
    return summaries.funnel(table(spark, d, "lineitem"), steps())


@query("best_and_mean", """
WITH r AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_extendedprice) AS rn FROM lineitem)
SELECT l_orderkey, count(*) AS n, min(l_extendedprice) AS best, round(avg(l_extendedprice), 6) AS mean, round(avg(l_extendedprice) FILTER (rn <= 5), 6) AS top_mean, count(*) = 4 AS complete FROM r GROUP BY 1""")
def best_and_mean(spark, d):
    return rounded(summaries.best_and_mean(table(spark, d, "lineitem"), ["l_orderkey"], "l_extendedprice", top=5, expected=4), "mean", "top_mean")


@query("best_by_several_scores", """
SELECT l_orderkey, arg_min(l_linenumber, (l_extendedprice, l_linenumber, l_partkey)) AS by_price, arg_min(l_linenumber, (l_discount, l_linenumber, l_partkey)) AS by_discount, max(l_extendedprice) - min(l_extendedprice) > 20000 AS wide FROM lineitem GROUP BY 1""")
def best_by_several_scores(spark, d):
    best = lambda c: F.min_by("l_linenumber", F.struct(c, "l_linenumber", "l_partkey"))
    return table(spark, d, "lineitem").groupBy("l_orderkey").agg(best("l_extendedprice").alias("by_price"), best("l_discount").alias("by_discount"), (F.max("l_extendedprice") - F.min("l_extendedprice") > 20000).alias("wide"))


def _distance(a, b):
    return F.sqrt(F.aggregate(F.zip_with(a, b, lambda x, y: F.pow(x.cast("double") - y.cast("double"), F.lit(2.0))), F.lit(0.0), lambda s, x: s + x) / F.size(a))


@query("pair_rmsd_within_group", """
WITH p AS (SELECT a.label, list_distance(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])) / sqrt(len(a.embedding)) AS r FROM embeddings a JOIN embeddings b ON a.label = b.label AND a.vec_id < b.vec_id)
SELECT label, count(*) AS n_pairs, round(median(r), 4) AS median_r, round(avg(r), 4) AS mean_r, round(min(r), 4) AS least, round(max(r), 4) AS most FROM p GROUP BY 1""")
def pair_rmsd_within_group(spark, d):
    rows = pair_distances(table(spark, d, "embeddings"), "label", "vec_id", "embedding")
    return rounded(rows, "median_r", "mean_r", "least", "most", places=4)


@query("ref_rmsd_ratio", """
WITH ref AS (SELECT label, arg_min(embedding, vec_id) AS e, min(vec_id) AS id FROM embeddings GROUP BY 1),
r AS (SELECT v.label, list_distance(CAST(v.embedding AS DOUBLE[]), CAST(ref.e AS DOUBLE[])) / sqrt(len(e)) AS r FROM embeddings v JOIN ref USING (label) WHERE v.vec_id <> ref.id),
p AS (SELECT a.label, median(list_distance(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])) / sqrt(len(a.embedding))) AS m FROM embeddings a JOIN embeddings b ON a.label = b.label AND a.vec_id < b.vec_id GROUP BY 1)
SELECT label, count(*) AS n, round(median(r), 4) AS median_ref, round(median(r) / max(m), 4) AS ratio FROM r JOIN p USING (label) GROUP BY 1""")
def ref_rmsd_ratio(spark, d):
    rows = table(spark, d, "embeddings")
    ref = rows.groupBy(F.col("label").alias("l")).agg(F.min_by("embedding", "vec_id").alias("e"), F.min("vec_id").alias("id"))
    to_ref = rows.join(ref, F.col("label") == F.col("l")).where("vec_id <> id").select("label", _distance(F.col("embedding"), F.col("e")).alias("r"))
    pairs = pair_distances(rows, "label", "vec_id", "embedding").select("label", F.col("median_r").alias("m"))
    g = to_ref.groupBy("label").agg(F.count(F.lit(1)).alias("n"), F.median("r").alias("median_ref")).join(pairs, "label")
    return rounded(g.select("label", "n", "median_ref", (F.col("median_ref") / F.col("m")).alias("ratio")), "median_ref", "ratio", places=4)


def score_lines(spark, d):
    """Lines of score files, one file for each order: a header, a line for each item, and one of the wrong width."""
    rows = table(spark, d, "lineitem")
    body = rows.select(F.col("l_orderkey").alias("file"), (F.row_number().over(_file()) + 1).alias("line_no"), F.concat_ws(" ", F.lit("SCORE:"), F.col("l_extendedprice").cast("int").cast("string"), F.when(F.col("l_tax") > 0.05, "nan?").otherwise(F.col("l_quantity").cast("int").cast("string")), F.concat(F.lit("tag"), F.col("l_linenumber").cast("string"))).alias("line"))
    head = rows.select(F.col("l_orderkey").alias("file")).distinct().select("file", F.lit(1).alias("line_no"), F.lit("SCORE: total I_sc description").alias("line"))
    bad = head.select("file", F.lit(1000).alias("line_no"), F.lit("SCORE: 1 2").alias("line"))
    return head.unionByName(body).unionByName(bad)


def _file():
    from pyspark.sql import Window

    return Window.partitionBy("l_orderkey").orderBy(*line_order())


@query("scorelines_parse", f"""
WITH r AS (SELECT l_orderkey AS file, row_number() OVER (PARTITION BY l_orderkey ORDER BY {LINE_ORDER_SQL}) AS no, l_extendedprice, l_tax, l_quantity, 'tag' || l_linenumber AS tag FROM lineitem),
k AS (SELECT *, row_number() OVER (PARTITION BY file, tag ORDER BY no DESC) AS rn FROM r)
SELECT file, tag, CAST(trunc(l_extendedprice) AS DOUBLE) AS total, CASE WHEN l_tax > 0.05 THEN NULL ELSE CAST(trunc(l_quantity) AS DOUBLE) END AS i_sc FROM k WHERE rn = 1""")
def scorelines_parse(spark, d):
    """Score lines parsed strictly: of lines with one tag the last stays, a line of another width goes."""
    parsed = parse_scores(score_lines(spark, d), ["file"])
    return parsed.select("file", "tag", F.try_element_at("scores", F.lit("total")).alias("total"), F.try_element_at("scores", F.lit("I_sc")).alias("i_sc"))


@query("keep_last_tag", """
SELECT conv_id, role, text FROM (SELECT *, row_number() OVER (PARTITION BY conv_id, role ORDER BY turn DESC, text) AS rn FROM conversations) WHERE rn = 1""")
def keep_last_tag(spark, d):
    return dedup.keep_first(table(spark, d, "conversations"), ["conv_id", "role"], [F.desc("turn"), F.asc("text")]).select("conv_id", "role", "text")


@query("content_verdict", """
WITH x AS (SELECT p_partkey, CASE WHEN p_size % 10 = 0 THEN 3 WHEN p_size % 10 = 1 THEN 0 ELSE 2 END AS n, CASE WHEN p_size % 10 = 2 THEN 'C' ELSE 'B' END AS lig, CASE WHEN p_size % 10 = 3 THEN 150 ELSE 180 END AS heavy,
  CASE p_size % 10 WHEN 4 THEN 'SIINFE' WHEN 5 THEN 'SIINFEKLAA' WHEN 6 THEN 'AIINFEKL' ELSE 'SIINFEKL' END AS pep FROM part)
SELECT p_partkey, CASE WHEN n = 0 THEN 'unreadable' WHEN n > 2 THEN 'extra_chain' WHEN lig <> 'B' THEN 'wrong_chain_ids' WHEN heavy NOT BETWEEN 170 AND 200 THEN 'receptor_size' WHEN pep = 'SIINFEKL' THEN 'ok'
  WHEN starts_with('SIINFEKL', pep) THEN 'truncated_peptide' WHEN length(pep) <> 8 THEN 'peptide_length' ELSE 'peptide_mismatch' END AS verdict FROM x""")
def content_verdict(spark, d):
    m = F.col("p_size") % 10
    pep = F.when(m == 4, "SIINFE").when(m == 5, "SIINFEKLAA").when(m == 6, "AIINFEKL").otherwise("SIINFEKL")
    heavy = F.repeat(F.lit("A"), F.when(m == 3, 150).otherwise(180))
    two = F.map_from_arrays(F.array(F.lit("A"), F.when(m == 2, "C").otherwise("B")), F.array(heavy, pep))
    three = F.map_from_arrays(F.array(F.lit("A"), F.lit("B"), F.lit("C")), F.array(heavy, pep, pep))
    chains = F.when(m == 1, F.lit(None)).when(m == 0, three).otherwise(two)
    return table(spark, d, "part").select("p_partkey", structure.content_verdict(chains, F.lit("SIINFEKL")).alias("verdict"))


@query("verdict_counts")
def verdict_counts(spark, d):
    return content_verdict(spark, d).groupBy("verdict").agg(F.count(F.lit(1)).alias("n"))


@query("kabsch_rmsd")
def kabsch_rmsd(spark, d):
    """Every vector as 21 points, superposed on the first of its label."""
    rows = table(spark, d, "embeddings").withColumn("points", F.slice("embedding", 1, 63))
    ref = rows.groupBy(F.col("label").alias("l")).agg(F.min_by("points", "vec_id").alias("fixed"))
    return rounded(rows.join(ref, F.col("label") == F.col("l")).select("vec_id", "label", structure.superposed_rmsd("fixed", "points").alias("rmsd")), "rmsd")


@query("peptide_rmsd")
def peptide_rmsd(spark, d):
    """Every vector as a receptor of 15 points and a peptide of six, against the first of its label: the receptor is superposed."""
    rows = table(spark, d, "embeddings").select("vec_id", "label", F.slice("embedding", 1, 45).alias("receptor"), F.slice("embedding", 46, 18).alias("peptide"))
    ref = rows.groupBy(F.col("label").alias("l")).agg(F.min_by("receptor", "vec_id").alias("r"), F.min_by("peptide", "vec_id").alias("p"))
    found = rows.join(ref, F.col("label") == F.col("l"))
    return rounded(found.select("vec_id", "label", structure.peptide_rmsd("r", "receptor", "p", "peptide").alias("rmsd")), "rmsd")


@query("unit_fix", """
SELECT l_suppkey, round(avg(l_discount) * 100, 6) AS mean_discount, round(avg(l_quantity), 6) AS mean_quantity FROM lineitem GROUP BY 1""")
def unit_fix(spark, d):
    means = table(spark, d, "lineitem").groupBy("l_suppkey").agg(F.avg("l_discount").alias("mean_discount"), F.avg("l_quantity").alias("mean_quantity"))
    return rounded(summaries.fractions_to_percent(summaries.fractions_to_percent(means, "mean_discount"), "mean_quantity"), "mean_discount", "mean_quantity")


@query("marked_residues", """
SELECT p_partkey, substr(p_name, 1, 3) || '[NCAA]' || substr(p_name, 4) AS marked, replace(upper(p_name), 'X', 'X[NCAA]') AS unknown FROM part""")
def marked_residues(spark, d):
    n = F.col("p_name")
    return table(spark, d, "part").select("p_partkey", scalars.mark_residue(n, F.lit(3), "NCAA").alias("marked"), scalars.mark_unknown(F.upper(n)).alias("unknown"))


@query("quality_report", """
SELECT 'orders have lines' AS expectation, count(*) AS violations, count(*) = 0 AS holds FROM orders WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey)
UNION ALL SELECT 'lines have orders', count(*), count(*) = 0 FROM lineitem WHERE NOT EXISTS (SELECT 1 FROM orders WHERE l_orderkey = o_orderkey)
UNION ALL SELECT 'unique orders', count(*), count(*) = 0 FROM (SELECT 1 FROM orders GROUP BY o_orderkey HAVING count(*) > 1)
UNION ALL SELECT 'unique lines', count(*), count(*) = 0 FROM (SELECT 1 FROM lineitem GROUP BY l_orderkey, l_linenumber HAVING count(*) > 1)
UNION ALL SELECT 'four lines', count(*), count(*) = 0 FROM (SELECT 1 FROM lineitem GROUP BY l_orderkey HAVING count(*) <> 4)
UNION ALL SELECT 'positive prices', count(*), count(*) = 0 FROM lineitem WHERE NOT l_extendedprice > 0
UNION ALL SELECT 'stored length', count(*), count(*) = 0 FROM documents WHERE n_chars <> length(text)
UNION ALL SELECT 'funnel falls', 0, true""")
def quality_report(spark, d):
    orders, lines, docs = (table(spark, d, n) for n in ("orders", "lineitem", "documents"))
    keyed = lines.select(F.col("l_orderkey").alias("o_orderkey"))
    return quality.report(
        quality.expect_no_strays(orders, "orders have lines", keyed, ["o_orderkey"]),
        quality.expect_no_strays(keyed, "lines have orders", orders, ["o_orderkey"]),
        quality.expect_unique(orders, "unique orders", ["o_orderkey"]),
        quality.expect_unique(lines, "unique lines", ["l_orderkey", "l_linenumber"]),
        quality.expect_members(lines, "four lines", ["l_orderkey"], 4),
        quality.expect(lines, "positive prices", F.col("l_extendedprice") > 0),
        quality.expect_equal(docs.withColumn("found", F.length("text")), "stored length", "n_chars", "found"),
        quality.expect_monotone(summaries.funnel(lines, steps()), "funnel falls"),
    )

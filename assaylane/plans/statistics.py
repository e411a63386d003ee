"""Queries for censoring, rank statistics, tests, sweeps and histograms."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.predicates import in_open_interval, is_censored
from ..operators import stats, summaries
from ..operators.ordered import average_rank
from ..operators.quantiles import exact_quantiles
from .registry import CEILINGS, CENSORED_SQL, FLOOR, query, rounded, table

RANK = "rank() OVER (PARTITION BY {g} ORDER BY {x}) + (count(*) OVER (PARTITION BY {g}, {x}) - 1) / 2.0"
POOLED_RANK = "rank() OVER (ORDER BY {x}) + (count(*) OVER (PARTITION BY {x}) - 1) / 2.0"


def censored(df):
    return df.withColumn("censored", is_censored(F.col("l_quantity"), CEILINGS, FLOOR))


@query("censored_split", f"""
SELECT l_returnflag, count(*) AS n, count(*) FILTER ({CENSORED_SQL}) AS n_censored, round(avg(CASE WHEN {CENSORED_SQL} THEN 1.0 ELSE 0.0 END), 6) AS share
FROM lineitem GROUP BY l_returnflag""")
def censored_split(spark, d):
    rows = censored(table(spark, d, "lineitem"))
    return rounded(rows.groupBy("l_returnflag").agg(F.count(F.lit(1)).alias("n"), F.count_if("censored").alias("n_censored"), F.avg(F.col("censored").cast("double")).alias("share")), "share")


@query("censor_policy_sensitivity", f"""
WITH p AS (
  SELECT 'all' AS policy, l_discount AS x, l_extendedprice AS y FROM lineitem
  UNION ALL SELECT 'ceilings', l_discount, l_extendedprice FROM lineitem WHERE NOT l_quantity IN (10, 20, 50)
  UNION ALL SELECT 'floor', l_discount, l_extendedprice FROM lineitem WHERE l_quantity < 50
  UNION ALL SELECT 'both', l_discount, l_extendedprice FROM lineitem WHERE NOT {CENSORED_SQL}),
r AS (SELECT policy, {RANK.format(g="policy", x="x")} AS rx, {RANK.format(g="policy", x="y")} AS ry FROM p)
SELECT policy, count(*) AS n, round(corr(rx, ry), 6) AS rho FROM r GROUP BY policy""")
def censor_policy_sensitivity(spark, d):
    q = F.col("l_quantity")
    named = {"all": F.lit(True), "ceilings": ~is_censored(q, CEILINGS), "floor": ~(q >= FLOOR), "both": ~is_censored(q, CEILINGS, FLOOR)}
    return rounded(stats.spearman(summaries.policies(table(spark, d, "lineitem"), named), "l_discount", "l_extendedprice", ["policy"]), "rho")


@query("value_spikes", """
WITH c AS (SELECT l_quantity, count(*) AS n, round(count(*) / (SELECT count(*) FROM lineitem), 6) AS share FROM lineitem GROUP BY l_quantity)
SELECT *, share > 0.0205 AS is_spike FROM c ORDER BY n DESC, l_quantity LIMIT 20""")
def value_spikes(spark, d):
    found = summaries.spikes(table(spark, d, "lineitem"), "l_quantity", 20, 0.0205)
    return rounded(found, "share").withColumn("is_spike", F.col("share") > 0.0205)


@query("upper_tail_span", """
SELECT l_returnflag, round(quantile_cont(l_extendedprice, 0.98), 6) AS p98, round(max(l_extendedprice), 6) AS most,
  round(log10(max(l_extendedprice)) - log10(quantile_cont(l_extendedprice, 0.98)), 6) AS span
FROM lineitem GROUP BY l_returnflag""")
def upper_tail_span(spark, d):
    rows = exact_quantiles(table(spark, d, "lineitem"), "l_extendedprice", [0.98, 1.0], ["l_returnflag"]).select("l_returnflag", F.col("q")[0].alias("p98"), F.col("q")[1].alias("most"))
    return rounded(rows.withColumn("span", F.log10("most") - F.log10("p98")), "p98", "most", "span")


@query("spearman_pooled", f"""
WITH r AS (SELECT {POOLED_RANK.format(x="l_discount")} AS rx, {POOLED_RANK.format(x="l_extendedprice")} AS ry FROM lineitem WHERE NOT {CENSORED_SQL})
SELECT count(*) AS n, round(corr(rx, ry), 6) AS rho FROM r""")
def spearman_pooled(spark, d):
    return rounded(stats.spearman(censored(table(spark, d, "lineitem")).where("not censored"), "l_discount", "l_extendedprice"), "rho")


@query("spearman_by_group", f"""
WITH b AS (SELECT p_brand, l_discount, l_extendedprice FROM lineitem JOIN part ON l_partkey = p_partkey WHERE NOT {CENSORED_SQL} AND l_extendedprice > 0),
r AS (SELECT p_brand, {RANK.format(g="p_brand", x="l_discount")} AS rx, {RANK.format(g="p_brand", x="l_extendedprice")} AS ry FROM b)
SELECT p_brand, count(*) AS n, round(corr(rx, ry), 6) AS rho FROM r GROUP BY p_brand HAVING count(*) >= 10""")
def spearman_by_group(spark, d):
    """Per-group rank correlation of score and value, censored rows left out, groups of ten and more."""
    rows = censored(table(spark, d, "lineitem")).where("not censored and l_extendedprice > 0").join(table(spark, d, "part"), F.col("l_partkey") == F.col("p_partkey"))
    return rounded(stats.spearman(rows, "l_discount", "l_extendedprice", ["p_brand"], min_n=10), "rho")


@query("spearman_p_values")
def spearman_p_values(spark, d):
    """Correlations by group with their p-values, Holm-adjusted over the groups."""
    rows = table(spark, d, "lineitem").join(table(spark, d, "part"), F.col("l_partkey") == F.col("p_partkey"))
    found = stats.spearman(rows, "l_discount", "l_extendedprice", ["p_brand"], min_n=10).withColumn("p", stats.correlation_p("rho", F.col("n").cast("double")))
    return rounded(stats.holm(found.withColumn("family", F.lit(1)), "p", ["family"], order=["p_brand"]).drop("family"), "rho", "p", "p_holm")


_MATRIX = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


@query("spearman_matrix", "\nUNION ALL\n".join(
    f"SELECT '{a}' AS x, '{b}' AS y, count(*) AS n, round(corr(rx, ry), 6) AS rho FROM (SELECT {POOLED_RANK.format(x=a)} AS rx, {POOLED_RANK.format(x=b)} AS ry FROM lineitem)"
    for i, a in enumerate(_MATRIX) for b in _MATRIX[i + 1:]))
def spearman_matrix(spark, d):
    return rounded(stats.spearman_matrix(table(spark, d, "lineitem"), _MATRIX), "rho")


@query("pearson_regression", """
SELECT l_returnflag, count(*) AS n, round(corr(l_quantity, l_extendedprice), 6) AS r, round(regr_slope(l_extendedprice, l_quantity), 4) AS slope,
  round(regr_intercept(l_extendedprice, l_quantity), 4) AS intercept, round(regr_r2(l_extendedprice, l_quantity), 6) AS r2,
  round(sqrt(var_pop(l_extendedprice) * (1 - regr_r2(l_extendedprice, l_quantity))), 4) AS rmse
FROM lineitem GROUP BY l_returnflag""")
def pearson_regression(spark, d):
    rows = table(spark, d, "lineitem")
    line = stats.regression(rows, "l_quantity", "l_extendedprice", ["l_returnflag"])
    r = stats.pearson(rows, "l_quantity", "l_extendedprice", ["l_returnflag"]).drop("n")
    return rounded(rounded(line.join(r, "l_returnflag"), "r", "r2"), "slope", "intercept", "rmse", places=4)


@query("auroc_pooled", f"""
WITH r AS (SELECT {CENSORED_SQL} AS y, {POOLED_RANK.format(x="l_extendedprice")} AS rk FROM lineitem),
s AS (SELECT count(*) FILTER (y) AS n_pos, count(*) FILTER (NOT y) AS n_neg, sum(rk) FILTER (y) AS t FROM r)
SELECT n_pos, n_neg, round((t - n_pos * (n_pos + 1) / 2.0) / (CAST(n_pos AS DOUBLE) * n_neg), 6) AS auroc,
  round(2 * ((t - n_pos * (n_pos + 1) / 2.0) / (CAST(n_pos AS DOUBLE) * n_neg)) - 1, 6) AS effect FROM s""")
def auroc_pooled(spark, d):
    return rounded(stats.auroc(censored(table(spark, d, "lineitem")), "l_extendedprice", "censored"), "auroc", "effect")


_AUROC_BY = """
WITH r AS (SELECT {g} AS g, {y} AS y, {rank} AS rk FROM {source}),
s AS (SELECT g, count(*) FILTER (y) AS n_pos, count(*) FILTER (NOT y) AS n_neg, sum(rk) FILTER (y) AS t FROM r GROUP BY g)
SELECT g AS {g}, n_pos, n_neg, round((t - n_pos * (n_pos + 1) / 2.0) / (CAST(n_pos AS DOUBLE) * n_neg), 6) AS auroc,
  round(2 * ((t - n_pos * (n_pos + 1) / 2.0) / (CAST(n_pos AS DOUBLE) * n_neg)) - 1, 6) AS effect FROM s WHERE n_pos >= 10 AND n_neg >= 10"""


@query("auroc_by_group", _AUROC_BY.format(g="p_brand", y=CENSORED_SQL, rank=RANK.format(g="p_brand", x="l_extendedprice"), source="lineitem JOIN part ON l_partkey = p_partkey"))
def auroc_by_group(spark, d):
    rows = censored(table(spark, d, "lineitem")).join(table(spark, d, "part"), F.col("l_partkey") == F.col("p_partkey"))
    return rounded(stats.auroc(rows, "l_extendedprice", "censored", ["p_brand"], min_each=10), "auroc", "effect")


@query("auroc_strong_only", _AUROC_BY.format(g="l_returnflag", y=CENSORED_SQL, rank=RANK.format(g="l_returnflag", x="l_extendedprice"), source=f"(SELECT * FROM lineitem WHERE l_quantity < 15 OR {CENSORED_SQL})"))
def auroc_strong_only(spark, d):
    rows = censored(table(spark, d, "lineitem")).where("l_quantity < 15 or censored")
    return rounded(stats.auroc(rows, "l_extendedprice", "censored", ["l_returnflag"], min_each=10), "auroc", "effect")


@query("label_auroc", _AUROC_BY.format(g="lang", y="quality = 1", rank=RANK.format(g="lang", x="n_chars"), source="documents JOIN labels USING (doc_id)"))
def label_auroc(spark, d):
    rows = table(spark, d, "documents").join(table(spark, d, "labels"), "doc_id").withColumn("good", F.col("quality") == 1)
    return rounded(stats.auroc(rows, "n_chars", "good", ["lang"], min_each=10), "auroc", "effect")


@query("average_precision", """
WITH c AS (SELECT n_chars, count(*) FILTER (toxic = 1) AS pos, count(*) AS alls FROM documents JOIN labels USING (doc_id) GROUP BY n_chars),
r AS (SELECT pos, sum(pos) OVER w AS tp, sum(alls) OVER w AS seen FROM c WINDOW w AS (ORDER BY n_chars DESC)),
t AS (SELECT CAST(sum(pos) AS BIGINT) AS n_pos, CAST(sum(alls) AS BIGINT) AS n FROM c)
SELECT n, n_pos, round((SELECT sum(pos * tp / seen) FROM r) / n_pos, 6) AS average_precision, round(n_pos / n, 6) AS prevalence FROM t""")
def average_precision(spark, d):
    rows = table(spark, d, "documents").join(table(spark, d, "labels"), "doc_id").withColumn("bad", F.col("toxic") == 1)
    return rounded(stats.average_precision(rows, "n_chars", "bad"), "average_precision", "prevalence")


@query("holm_adjust", """
WITH s AS (SELECT l_returnflag, l_suppkey, round(avg(l_discount) / 0.2, 6) AS p FROM lineitem GROUP BY ALL),
a AS (SELECT *, least(1.0, p * (count(*) OVER (PARTITION BY l_returnflag) - row_number() OVER (PARTITION BY l_returnflag ORDER BY p, l_suppkey) + 1)) AS scaled FROM s)
SELECT l_returnflag, l_suppkey, p, round(max(scaled) OVER (PARTITION BY l_returnflag ORDER BY p, l_suppkey ROWS UNBOUNDED PRECEDING), 6) AS p_holm FROM a""")
def holm_adjust(spark, d):
    p = table(spark, d, "lineitem").groupBy("l_returnflag", "l_suppkey").agg(F.round(F.avg("l_discount") / 0.2, 6).alias("p"))
    return rounded(stats.holm(p, "p", ["l_returnflag"], order=["l_suppkey"]), "p_holm")


@query("per_group_summary", f"""
WITH b AS (SELECT l_suppkey, l_discount, l_extendedprice FROM lineitem),
r AS (SELECT l_suppkey, {RANK.format(g="l_suppkey", x="l_discount")} AS rx, {RANK.format(g="l_suppkey", x="l_extendedprice")} AS ry FROM b),
g AS (SELECT l_suppkey, corr(rx, ry) AS rho FROM r GROUP BY l_suppkey HAVING count(*) >= 10)
SELECT count(*) AS n_groups, round(median(rho), 6) AS median_rho, round(quantile_cont(rho, 0.25), 6) AS q1, round(quantile_cont(rho, 0.75), 6) AS q3,
  count(*) FILTER (rho > 0.3) AS n_above, count(*) FILTER (rho < 0) AS n_below FROM g""")
def per_group_summary(spark, d):
    g = stats.spearman(table(spark, d, "lineitem"), "l_discount", "l_extendedprice", ["l_suppkey"], min_n=10)
    rows = g.agg(F.count(F.lit(1)).alias("n_groups"), F.median("rho").alias("median_rho"), F.percentile("rho", 0.25).alias("q1"), F.percentile("rho", 0.75).alias("q3"), F.count_if(F.col("rho") > 0.3).alias("n_above"), F.count_if(F.col("rho") < 0).alias("n_below"))
    return rounded(rows, "median_rho", "q1", "q3")


@query("kruskal_h", """
WITH r AS (SELECT l_returnflag AS g, l_quantity AS v, rank() OVER (ORDER BY l_quantity) + (count(*) OVER (PARTITION BY l_quantity) - 1) / 2.0 AS rk FROM lineitem),
t AS (SELECT sum(CAST(c AS DOUBLE) * c * c - c) AS ties, CAST(sum(c) AS DOUBLE) AS n FROM (SELECT count(*) AS c FROM lineitem GROUP BY l_quantity)),
s AS (SELECT sum(r * r / c) AS s, count(*) AS k FROM (SELECT CAST(sum(rk) AS DOUBLE) AS r, count(*) AS c FROM r GROUP BY g))
SELECT k AS n_groups, CAST(n AS BIGINT) AS n, round((12.0 / (n * (n + 1)) * s - 3 * (n + 1)) / (1 - ties / (n * n * n - n)), 4) AS h, k - 1 AS df FROM s, t""")
def kruskal_h(spark, d):
    return rounded(stats.kruskal(table(spark, d, "lineitem"), "l_quantity", "l_returnflag"), "h", places=4)


@query("kruskal_p")
def kruskal_p(spark, d):
    found = stats.kruskal(table(spark, d, "lineitem"), "l_quantity", "l_returnflag")
    return rounded(found.withColumn("p", stats.chi2_p("h", F.col("df").cast("double"))), "h", "p", places=4)


@query("ks_distance", """
WITH c AS (SELECT l_quantity, count(*) FILTER (l_linestatus = 'O') AS a, count(*) FILTER (l_linestatus = 'F') AS b FROM lineitem GROUP BY l_quantity),
r AS (SELECT sum(a) OVER w AS ca, sum(b) OVER w AS cb FROM c WINDOW w AS (ORDER BY l_quantity)),
t AS (SELECT CAST(sum(a) AS BIGINT) AS n_a, CAST(sum(b) AS BIGINT) AS n_b FROM c)
SELECT n_a, n_b, round((SELECT max(abs(ca / n_a - cb / n_b)) FROM r), 6) AS d FROM t""")
def ks_distance(spark, d):
    return rounded(stats.ks_distance(table(spark, d, "lineitem"), "l_quantity", "l_linestatus", "O", "F"), "d")


@query("ks_p_value")
def ks_p_value(spark, d):
    found = stats.ks_distance(table(spark, d, "lineitem"), "l_quantity", "l_linestatus", "O", "F")
    return rounded(found.withColumn("p", stats.ks_p("d", F.col("n_a").cast("double"), F.col("n_b").cast("double"))), "d", "p")


@query("weighted_within_vs_pooled", f"""
WITH r AS (SELECT l_returnflag AS g, {RANK.format(g="l_returnflag", x="l_discount")} AS rx, {RANK.format(g="l_returnflag", x="l_extendedprice")} AS ry,
    {POOLED_RANK.format(x="l_discount")} AS px, {POOLED_RANK.format(x="l_extendedprice")} AS py FROM lineitem),
w AS (SELECT g, count(*) AS n, corr(rx, ry) AS rho FROM r GROUP BY g)
SELECT round((SELECT sum(n * rho) / sum(n) FROM w), 6) AS within, round((SELECT corr(px, py) FROM r), 6) AS pooled,
  round((SELECT corr(px, py) FROM r) - (SELECT sum(n * rho) / sum(n) FROM w), 6) AS difference""")
def weighted_within_vs_pooled(spark, d):
    rows = table(spark, d, "lineitem")
    w = stats.spearman(rows, "l_discount", "l_extendedprice", ["l_returnflag"]).agg((F.sum(F.col("n") * F.col("rho")) / F.sum("n")).alias("within"), F.lit(1).alias("j"))
    p = stats.spearman(rows, "l_discount", "l_extendedprice").select(F.col("rho").alias("pooled"), F.lit(1).alias("j"))
    return rounded(w.join(p, "j").select("within", "pooled", (F.col("pooled") - F.col("within")).alias("difference")), "within", "pooled", "difference")


@query("dominant_fraction", """
WITH c AS (SELECT l_suppkey, l_returnflag, count(*) AS n FROM lineitem GROUP BY ALL)
SELECT l_suppkey, CAST(sum(n) AS BIGINT) AS n, round(max(n) / sum(n), 6) AS dominant FROM c GROUP BY l_suppkey""")
def dominant_fraction(spark, d):
    c = table(spark, d, "lineitem").groupBy("l_suppkey", "l_returnflag").agg(F.count(F.lit(1)).alias("n"))
    return rounded(c.groupBy("l_suppkey").agg(F.sum("n").alias("n"), (F.max("n") / F.sum("n")).alias("dominant")), "dominant")


_THRESHOLDS = [1000.0 * i for i in range(1, 101)]
_SWEEP_SQL = f"""
WITH t AS (SELECT 1000.0::DOUBLE * i AS threshold FROM range(1, 101) r(i)),
c AS (SELECT threshold, count(*) FILTER (l_extendedprice <= threshold AND {CENSORED_SQL}) AS tp, count(*) FILTER (l_extendedprice <= threshold AND NOT {CENSORED_SQL}) AS fp,
  count(*) FILTER (l_extendedprice > threshold AND {CENSORED_SQL}) AS fn, count(*) FILTER (l_extendedprice > threshold AND NOT {CENSORED_SQL}) AS tn FROM lineitem, t GROUP BY threshold),
s AS (SELECT *, tp / (tp + fn) AS tpr, tn / (tn + fp) AS tnr, CASE WHEN tp + fp > 0 THEN tp / (tp + fp) END AS ppv, CASE WHEN tn + fn > 0 THEN tn / (tn + fn) END AS npv, (tp + tn) / (tp + fp + fn + tn) AS accuracy FROM c)"""


def sweep(spark, d):
    return summaries.threshold_sweep(censored(table(spark, d, "lineitem")), "l_extendedprice", "censored", _THRESHOLDS)


@query("threshold_sweep", _SWEEP_SQL + """
SELECT threshold, tp, fp, fn, tn, round(tpr, 6) AS tpr, round(tnr, 6) AS tnr, round(ppv, 6) AS ppv, round(npv, 6) AS npv, round(accuracy, 6) AS accuracy,
  round(1 - tnr, 6) AS fpr, round(1 - tpr, 6) AS fnr, round(1 - ppv, 6) AS fdr, round(CASE WHEN 1 - tnr > 0 THEN tpr / (1 - tnr) END, 4) AS lr_plus,
  round(CASE WHEN tnr > 0 THEN (1 - tpr) / tnr END, 4) AS lr_minus, round(tpr + tnr - 1, 6) AS youden FROM s""")
def threshold_sweep(spark, d):
    return rounded(rounded(sweep(spark, d), "tpr", "tnr", "ppv", "npv", "accuracy", "fpr", "fnr", "fdr", "youden"), "lr_plus", "lr_minus", places=4)


@query("trapezoid_auc", _SWEEP_SQL + """,
p AS (SELECT (1 - tnr) - lag(1 - tnr) OVER w AS dx, tpr + lag(tpr) OVER w AS ys FROM s WINDOW w AS (ORDER BY 1 - tnr, tpr))
SELECT round(sum(dx * ys / 2.0), 6) AS area FROM p""")
def trapezoid_auc(spark, d):
    return rounded(summaries.trapezoid_area(sweep(spark, d), "fpr", "tpr"), "area")


@query("best_threshold", _SWEEP_SQL + " SELECT threshold, round(accuracy, 6) AS accuracy FROM s ORDER BY s.accuracy DESC, threshold LIMIT 1")
def best_threshold(spark, d):
    return rounded(summaries.best_threshold(sweep(spark, d)).select("threshold", "accuracy"), "accuracy")


_EDGES = [-3.0 + 9.0 * i / 39 for i in range(40)]


@query("histogram_fixed", f"""
WITH e AS (SELECT i AS bin, -3.0::DOUBLE + 9.0::DOUBLE * i / 39 AS low, -3.0::DOUBLE + 9.0::DOUBLE * (i + 1) / 39 AS high FROM range(0, 39) r(i)),
v AS (SELECT log10(o_totalprice) AS x FROM orders WHERE o_totalprice > 0.001 AND o_totalprice < 1e7)
SELECT CAST(bin AS INTEGER) AS bin, round(low, 6) AS low, round(high, 6) AS high, count(x) AS n FROM e LEFT JOIN v ON x >= low AND (x < high OR (bin = 38 AND x <= high)) GROUP BY ALL""")
def histogram_fixed(spark, d):
    rows = table(spark, d, "orders").where(in_open_interval(F.col("o_totalprice"), 0.001, 1e7)).withColumn("x", F.log10("o_totalprice"))
    return rounded(summaries.histogram(rows, "x", _EDGES), "low", "high")


@query("histogram_equal_width", """
WITH b AS (SELECT min(l_extendedprice) AS lo, (max(l_extendedprice) - min(l_extendedprice)) / 20 AS w FROM lineitem)
SELECT CAST(least(floor((l_extendedprice - lo) / w) + 1, 20) AS INTEGER) AS bin, count(*) AS n FROM lineitem, b GROUP BY 1""")
def histogram_equal_width(spark, d):
    return summaries.equal_width_histogram(table(spark, d, "lineitem"), "l_extendedprice", 20)


@query("quantile_clip", """
WITH q AS (SELECT quantile_cont(l_extendedprice, 0.05) AS lo, quantile_cont(l_extendedprice, 0.95) AS hi FROM lineitem)
SELECT round(lo, 6) AS lo, round(hi, 6) AS hi, round(avg(CASE WHEN l_extendedprice BETWEEN lo AND hi THEN 1.0 ELSE 0.0 END), 6) AS inside FROM lineitem, q GROUP BY lo, hi""")
def quantile_clip(spark, d):
    rows = table(spark, d, "lineitem")
    q = exact_quantiles(rows, "l_extendedprice", [0.05, 0.95]).select(F.col("q")[0].alias("lo"), F.col("q")[1].alias("hi"), F.lit(1).alias("j"))
    inside = F.avg(F.col("l_extendedprice").between(F.col("lo"), F.col("hi")).cast("double")).alias("inside")
    return rounded(rows.withColumn("j", F.lit(1)).join(F.broadcast(q), "j").groupBy("lo", "hi").agg(inside), "lo", "hi", "inside")


@query("describe_exact", """
SELECT l_returnflag, count(*) AS n, round(avg(l_extendedprice), 4) AS mean, round(stddev_samp(l_extendedprice), 4) AS sd, min(l_extendedprice) AS low,
  round(quantile_cont(l_extendedprice, 0.25), 4) AS q1, round(median(l_extendedprice), 4) AS middle, round(quantile_cont(l_extendedprice, 0.75), 4) AS q3, max(l_extendedprice) AS high FROM lineitem GROUP BY 1""")
def describe_exact(spark, d):
    x = "l_extendedprice"
    lines = table(spark, d, "lineitem")
    moments = lines.groupBy("l_returnflag").agg(F.avg(x).alias("mean"), F.stddev(x).alias("sd"))
    quantiles = exact_quantiles(lines, x, [0.0, 0.25, 0.5, 0.75, 1.0], ["l_returnflag"])
    rows = moments.join(quantiles, "l_returnflag").select("l_returnflag", "n", "mean", "sd", *[F.col("q")[i].alias(c) for i, c in enumerate(("low", "q1", "middle", "q3", "high"))])
    return rounded(rows, "mean", "sd", "q1", "middle", "q3", places=4)


@query("average_ranks", f"""
SELECT l_returnflag, l_quantity, count(*) AS n, max(rk) AS rank FROM (SELECT *, {RANK.format(g="l_returnflag", x="l_quantity")} AS rk FROM lineitem) GROUP BY 1, 2""")
def average_ranks(spark, d):
    ranked = average_rank(table(spark, d, "lineitem"), "l_quantity", ["l_returnflag"])
    return ranked.groupBy("l_returnflag", "l_quantity").agg(F.count(F.lit(1)).alias("n"), F.max("rank").alias("rank"))

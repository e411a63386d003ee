"""Queries for folds, out-of-fold models and bootstrap intervals."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import ml, resample
from ..storage import cut
from .registry import CENSORED_SQL, LINE_ORDER, LINE_ORDER_SQL, query, rounded, table
from .statistics import censored


@query("prepared_targets", f"""
WITH r AS (SELECT *, row_number() OVER (PARTITION BY l_partkey, l_suppkey ORDER BY {LINE_ORDER_SQL}) AS rn FROM lineitem WHERE l_extendedprice > 0 AND NOT {CENSORED_SQL})
SELECT l_partkey, l_suppkey, round(log10(l_extendedprice), 6) AS target, l_extendedprice < 500 AS strong FROM r WHERE rn = 1""")
def prepared_targets(spark, d):
    rows = ml.prepare(censored(table(spark, d, "lineitem")), ["l_partkey", "l_suppkey"], "l_extendedprice", "censored", [F.col(c) for c in LINE_ORDER])
    return rounded(rows.select("l_partkey", "l_suppkey", "target", "strong"), "target")


@query("group_kfold", """
WITH s AS (SELECT l_suppkey, count(*) AS size FROM lineitem GROUP BY 1), p AS (SELECT *, row_number() OVER (ORDER BY size DESC, l_suppkey) - 1 AS place FROM s)
SELECT l_suppkey, size, CAST(CASE WHEN place // 5 % 2 = 0 THEN place % 5 ELSE 4 - place % 5 END AS INTEGER) AS fold FROM p""")
def group_kfold(spark, d):
    return ml.group_folds(table(spark, d, "lineitem"), "l_suppkey", 5)


@query("leave_one_group_out", """
WITH c AS (SELECT l_suppkey, count(*) AS n_test FROM lineitem GROUP BY 1) SELECT l_suppkey, n_test, CAST((SELECT sum(n_test) FROM c) - n_test AS BIGINT) AS n_train FROM c WHERE n_test >= 100""")
def leave_one_group_out(spark, d):
    return ml.leave_one_out(table(spark, d, "lineitem"), "l_suppkey", min_n=100)


@query("block_cv", """
WITH x AS (SELECT p_brand, l_suppkey FROM lineitem JOIN part ON l_partkey = p_partkey),
b AS (SELECT p_brand, row_number() OVER (ORDER BY count(*) DESC, p_brand) - 1 AS p FROM x GROUP BY 1), s AS (SELECT l_suppkey, row_number() OVER (ORDER BY count(*) DESC, l_suppkey) - 1 AS p FROM x GROUP BY 1),
f AS (SELECT CAST(CASE WHEN b.p // 3 % 2 = 0 THEN b.p % 3 ELSE 2 - b.p % 3 END AS INTEGER) AS row_block, CAST(CASE WHEN s.p // 3 % 2 = 0 THEN s.p % 3 ELSE 2 - s.p % 3 END AS INTEGER) AS column_block FROM x JOIN b USING (p_brand) JOIN s USING (l_suppkey))
SELECT row_block, column_block, CASE WHEN row_block = column_block THEN row_block END AS fold, count(*) AS n FROM f GROUP BY 1, 2""")
def block_cv(spark, d):
    rows = table(spark, d, "lineitem").join(table(spark, d, "part"), F.col("l_partkey") == F.col("p_partkey")).select("p_brand", "l_suppkey")
    return ml.block_folds(rows, "p_brand", "l_suppkey", 3).groupBy("row_block", "column_block", "fold").agg(F.count(F.lit(1)).alias("n"))


@query("gbt_oof_metrics")
def gbt_oof_metrics(spark, d):
    """Boosted trees against the mean, three folds of suppliers kept whole: metrics for each fold."""
    lines = table(spark, d, "lineitem")
    folds = cut(ml.group_folds(lines, "l_suppkey", 3).select("l_suppkey", "fold"))  # read by each pass over the lines, and of known size
    rows = lines.join(folds, "l_suppkey").withColumn("target", F.log10("l_extendedprice"))
    ready = ml.features(rows, None, ["l_quantity", "l_discount", "l_tax"], "l_returnflag").select("features", "target", "fold")
    predicted = ml.out_of_fold(ready, "fold", "target", range(3), rounds=5, depth=3)
    return rounded(ml.fold_metrics(predicted, "target", ["fold"]), "rmse", "rmse_baseline", "r", places=3)


def _strata_sql(policy: str) -> str:
    rank = "rank() OVER (PARTITION BY s ORDER BY {x}) + (count(*) OVER (PARTITION BY s, {x}) - 1) / 2.0"
    return f"""
WITH p AS (SELECT o_orderpriority AS s, l_extendedprice AS t, l_quantity AS p FROM lineitem LEFT JOIN orders ON l_orderkey = o_orderkey),
k AS (SELECT *, {rank.format(x="t")} AS rt, {rank.format(x="p")} AS rp FROM p WHERE s IS NOT NULL)
SELECT s AS stratum, '{policy}' AS model, count(*) AS n, round(corr(rp, rt), 6) AS rho, round(corr(p, t), 6) AS r, round(sqrt(avg((p - t) * (p - t))), 4) AS rmse,
  (SELECT count(s) FROM p) AS n_matched, (SELECT count(*) FROM p) AS n_total FROM k GROUP BY s HAVING count(*) >= 10"""


@query("label_strata", _strata_sql("B3"))
def label_strata(spark, d):
    """Quantities as predictions of prices, by the priority of the order: nothing is trained."""
    lines = table(spark, d, "lineitem").withColumn("pred_B3", F.col("l_quantity").cast("double"))
    labels = table(spark, d, "orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_orderpriority")
    return rounded(rounded(ml.label_strata(lines, labels, ["l_orderkey"], "o_orderpriority", "l_extendedprice"), "rho", "r"), "rmse", places=4)


#: The survey's sizes of the compared models.
BOOSTING = {"rounds": 300, "depth": 5, "min_rows": 50, "bins": 255}


def _compared(spark, d, classify):
    """Documents of known quality as measurements: the language is the group, the source the cluster, the first letters the sequence."""
    docs = table(spark, d, "documents").join(table(spark, d, "labels"), "doc_id").where("quality is not null")
    words = F.size(F.split(F.col("text"), " ")).cast("double")
    rows = docs.select("doc_id", "lang", "source", F.substring(F.upper(F.regexp_replace("text", "[^A-Za-z]", "")), 1, 12).alias("letters"), words.alias("words"), F.col("n_chars").cast("double").alias("chars"), (F.col("n_chars") / words).alias("score"), F.col("quality").alias("good"), F.log10("n_chars").alias("size"))
    folds = ml.group_folds(rows, "source", 5).select("source", "fold")
    blocks = ml.feature_blocks(rows.where("chars > 0").join(folds, "source"), "letters", ["words"], "lang")
    return ml.compare_out_of_fold(blocks, "fold", range(5), "good" if classify else "size", "score", classify=classify, **BOOSTING)


@query("compare_classifiers")
def compare_classifiers(spark, d):
    """Share, raw score and boosted trees as predictions of a document's quality, sources kept whole, by language."""
    found = ml.model_metrics(_compared(spark, d, True), "good", ["lang"], classify=True)
    return rounded(found, "auroc", "average_precision", places=3)


@query("compare_regressors")
def compare_regressors(spark, d):
    """Mean, raw score and boosted trees as predictions of a document's size: the spread of rank correlations over languages."""
    return rounded(ml.group_summary(ml.model_metrics(_compared(spark, d, False), "size", ["lang"])), "median", "q1", "q3", places=3)


@query("paired_auroc_delta_ci")
def paired_auroc_delta_ci(spark, d):
    """Interval of the difference of two sizes as scores of quality, sources resampled whole."""
    rows = table(spark, d, "documents").join(table(spark, d, "labels"), "doc_id").withColumn("good", F.col("quality") == 1).withColumn("lines", F.size(F.split("text", "\n")))
    return rounded(resample.paired_auroc_delta(rows, "good", "n_chars", "lines", "source", n_boot=200, seed=7), "low", "high", "mean", places=4)


@query("bootstrap_auroc_ci")
def bootstrap_auroc_ci(spark, d):
    rows = table(spark, d, "documents").join(table(spark, d, "labels"), "doc_id").withColumn("good", F.col("quality") == 1)
    return rounded(resample.bootstrap_auroc(rows, "n_chars", "good", n_boot=200, seed=7), "low", "high", "mean", places=4)


@query("cluster_bootstrap_ci")
def cluster_bootstrap_ci(spark, d):
    """Interval of the mean discount, suppliers resampled whole."""
    rows = table(spark, d, "lineitem").withColumn("one", F.lit(1.0))
    return rounded(resample.cluster_bootstrap(rows, "l_suppkey", ["l_discount", "one"], lambda t: t["l_discount"] / t["one"], n_boot=500, seed=7), "low", "high", "mean", places=4)


@query("paired_delta_ci")
def paired_delta_ci(spark, d):
    """Interval of the error difference of two constant predictions, on the same resamples."""
    rows = table(spark, d, "lineitem").select("l_suppkey", "l_discount", F.lit(0.05).alias("first"), F.lit(0.06).alias("second"))
    return rounded(resample.paired_delta(rows, "l_suppkey", "l_discount", "first", "second", n_boot=300, seed=7), "low", "high", "mean", places=6)

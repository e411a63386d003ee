"""Leakage-controlled folds, features, baselines and out-of-fold metrics."""

from __future__ import annotations

from collections.abc import Sequence
from multiprocessing.pool import ThreadPool

from pyspark import inheritable_thread_target
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import StringIndexer, VectorAssembler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import GBTRegressor
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.sequences import anchor9, one_hot
from ..storage import cut
from . import resample
from .quantiles import exact_quantiles
from .stats import auroc, average_precision, correlation, pearson, spearman


def prepare(df: DataFrame, keys: Sequence[str], value: str, censored: str, order: Sequence) -> DataFrame:
    """Uncensored positive measurements, the first of each key, with the targets log10 and strong (below 500)."""
    rows = df.where(F.col(value).isNotNull() & (F.col(value) > 0) & ~F.col(censored))
    first = rows.withColumn("_rn", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("_rn = 1").drop("_rn")
    return first.withColumns({"target": F.log10(value), "strong": F.col(value) < 500})


def group_folds(df: DataFrame, group: str, n_folds: int = 5) -> DataFrame:
    """group, size and fold: groups of falling size, dealt in a snake over the folds, so that no group is split.

    Needs the sizes' order only, not a running state, so that it is a sort of the table of groups.
    """
    from .ordered import cumulate

    sizes = df.groupBy(group).agg(F.count(F.lit(1)).alias("size"))
    by_size = sizes.groupBy("size").agg(F.count(F.lit(1)).alias("n"))
    starts = cumulate(by_size, [], "size", ["n"], descending=True).select(F.col("size").alias("_size"), "n_before")
    place = F.col("n_before") + F.row_number().over(Window.partitionBy("size").orderBy(group)) - 1
    turn, seat = F.floor(F.col("_place") / n_folds), F.col("_place") % n_folds
    dealt = sizes.join(starts, F.col("size") == F.col("_size")).withColumn("_place", place)
    return dealt.select(group, "size", F.when(turn % 2 == 0, seat).otherwise(n_folds - 1 - seat).cast("int").alias("fold"))


def leave_one_out(df: DataFrame, group: str, *, min_n: int = 100) -> DataFrame:
    """A fold for each group of at least ``min_n`` rows, with the rows left to train on."""
    counts = df.groupBy(group).agg(F.count(F.lit(1)).alias("n_test"))
    total = F.sum("n_test").over(Window.partitionBy())
    return counts.withColumn("n_train", total - F.col("n_test")).where(F.col("n_test") >= min_n)


def block_folds(df: DataFrame, row_group: str, column_group: str, n_blocks: int = 3) -> DataFrame:
    """``df`` with row_block, column_block and fold: the fold of the diagonal, NULL for rows off it, which are left out."""
    rows = group_folds(df, row_group, n_blocks).select(F.col(row_group).alias("_r"), F.col("fold").alias("row_block"))
    columns = group_folds(df, column_group, n_blocks).select(F.col(column_group).alias("_c"), F.col("fold").alias("column_block"))
    joined = df.join(rows, F.col(row_group) == F.col("_r")).join(columns, F.col(column_group) == F.col("_c")).drop("_r", "_c")
    return joined.withColumn("fold", F.when(F.col("row_block") == F.col("column_block"), F.col("row_block")))


def features(df: DataFrame, sequence: str | None, numbers: Sequence[str], category: str | None = None, *, out: str = "features") -> DataFrame:
    """A vector of the sequence's nine one-hot places, the numbers, and the category's code in alphabetical order."""
    columns = list(numbers)
    if category:
        df = StringIndexer(inputCol=category, outputCol="_code", stringOrderType="alphabetAsc", handleInvalid="keep").fit(df).transform(df)
        columns.append("_code")
    if sequence:
        df = df.withColumn("_hot", array_to_vector(one_hot(anchor9(F.col(sequence))).cast("array<double>")))
        columns.append("_hot")
    return VectorAssembler(inputCols=columns, outputCol=out, handleInvalid="skip").transform(df).drop("_hot", "_code")


def out_of_fold(df: DataFrame, fold: str, target: str, folds: Sequence[int], *, rounds: int = 20, depth: int = 5, seed: int = 0) -> DataFrame:
    """Rows with the prediction of a boosted model that was fitted without their fold, and of the mean without it.

    Rows of a fold with equal features are learned from as one, with their mean target and their number as weight: a split's gain and a leaf's mean are
    the same, and so many different vectors, not rows, are held by the fits. Spark draws the candidates of splits by a sample of what it is given, where that has more than
    10,000 rows, so a number with more than 32 values can be split elsewhere under another partitioning, or by another such grouping.
    """
    known = F.coalesce(F.col(target).cast("double"), F.lit(float("nan")))  # a missing target stays an error of the fit
    counted = cut(df.groupBy("features", fold).agg(F.avg(known).alias("_mean"), F.count(F.lit(1)).cast("double").alias("_n")))
    out = None
    for f in folds:
        train, test = counted.where(F.col(fold) != f), df.where(F.col(fold) == f)
        model = GBTRegressor(labelCol="_mean", weightCol="_n", maxIter=rounds, stepSize=0.1, maxDepth=depth, seed=seed, predictionCol="predicted").fit(train)
        mean = train.agg(F.sum(F.col("_mean") * F.col("_n")) / F.sum("_n")).first()[0]
        part = model.transform(test).withColumn("baseline", F.lit(float(mean)))
        out = part if out is None else out.unionByName(part)
    return out


def fold_metrics(predicted: DataFrame, target: str, by: Sequence[str]) -> DataFrame:
    """n, RMSE of model and baseline, and correlation of prediction and target."""
    square = lambda p: F.sqrt(F.avg(F.pow(F.col(p) - F.col(target), F.lit(2.0))))
    return predicted.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), square("predicted").alias("rmse"), square("baseline").alias("rmse_baseline"), correlation("predicted", target).alias("r"))


#: The compared models: a constant, the raw score, sequence and group, and these with the structure's numbers.
BLOCKS = ("B0", "B1", "B2", "B3")


def feature_blocks(df: DataFrame, sequence: str, structure: Sequence[str], category: str | None = None) -> DataFrame:
    """``df`` with the vectors B2 (nine one-hot places, length, the category's code) and B3 (B2 and the ``structure`` columns). B0 and B1 need none."""
    sized = df.withColumn("_length", F.length(sequence).cast("double"))
    return features(features(sized, sequence, ["_length"], category, out="B2"), sequence, ["_length", *structure], category, out="B3").drop("_length")


def compare_out_of_fold(
    df: DataFrame, fold: str, folds: Sequence[int], target: str, score: str, *, classify: bool = False, rounds: int = 300, depth: int = 5, min_rows: int = 1, bins: int = 255, seed: int = 0, parallelism: int = 10
) -> DataFrame:
    """Rows with pred_B0 to pred_B3, each from the rows of other folds.

    B0 is the mean of the target (of a class: its share), B1 the raw score, negated where ``classify`` as a stronger binder has a lower one; B2 and B3
    are boosted trees over the vectors of these names, and for a class the probability of the positive one. Where the rows to
    learn from have one class, its share stands for B2 and B3. A fold without rows on either side gives none.
    A leaf has ``min_rows`` rows at least. The rows are written once before the fits, each of which reads them several times, and with their predictions once after them.
    The fits need nothing of each other, and ``parallelism`` of them run at once: their jobs are many and short.
    """
    label = F.col(target).cast("double")
    rows = cut(df.withColumn("_y", label).where("_y is not null"))
    options = {"labelCol": "_y", "maxIter": rounds, "stepSize": 0.05, "maxDepth": depth, "minInstancesPerNode": min_rows, "maxBins": bins, "seed": seed}
    known, wanted = {}, []
    for f in folds:
        mean, classes = rows.where(F.col(fold) != f).agg(F.avg("_y"), F.count_distinct("_y")).first()
        if mean is None:
            continue
        known[f] = float(mean)
        if not classify or classes > 1:
            wanted += [(f, block) for block in BLOCKS[2:]]

    def fitted(which):
        f, block = which
        if classify:
            model = GBTClassifier(**options, featuresCol=block, predictionCol="_class").setProbabilityCol("_p").setRawPredictionCol("_raw")
        else:
            model = GBTRegressor(**options, featuresCol=block, predictionCol=f"pred_{block}")
        return model.fit(rows.where(F.col(fold) != f))

    with ThreadPool(max(1, min(parallelism, len(wanted)))) as pool:
        models = dict(zip(wanted, pool.map(inheritable_thread_target(rows.sparkSession)(fitted), wanted, chunksize=1), strict=True))
    out = None
    for f, mean in known.items():
        part = rows.where(F.col(fold) == f).withColumns({"pred_B0": F.lit(mean), "pred_B1": (-F.col(score) if classify else F.col(score)).cast("double")})
        for block in BLOCKS[2:]:
            if (f, block) not in models:
                part = part.withColumn(f"pred_{block}", F.lit(mean))
            elif classify:
                part = models[f, block].transform(part).withColumn(f"pred_{block}", vector_to_array("_p")[1]).drop("_p", "_raw", "_class")
            else:
                part = models[f, block].transform(part)
        out = part if out is None else out.unionByName(part)
    if out is None:
        return rows.where("false").withColumns({f"pred_{b}": F.lit(None).cast("double") for b in BLOCKS}).drop("_y")
    return cut(out.drop("_y"))


def model_metrics(predicted: DataFrame, target: str, by: Sequence[str] = (), *, classify: bool = False, models: Sequence[str] = BLOCKS, min_n: int = 10) -> DataFrame:
    """by, model, n and metrics of the groups with at least ``min_n`` rows: rmse, r and rho, or auroc and average precision.

    Constant predictions have no rank correlation and an AUROC of one half; B1 is a raw score, so its rmse says nothing and is NULL.
    """
    stacked = predicted.select(*by, F.col(target).alias("_t"), F.explode(F.array(*[F.struct(F.lit(m).alias("model"), F.col(f"pred_{m}").alias("_p")) for m in models])).alias("m")).select(*by, "_t", "m.*")
    keys = [*by, "model"]
    if classify:
        labelled = stacked.withColumn("_y", F.col("_t").cast("double") > 0.5)
        areas = auroc(labelled, "_p", "_y", keys).select(*keys, "auroc")
        precisions = average_precision(labelled, "_p", "_y", keys).select(*keys, "average_precision")
        sizes = labelled.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.count_if("_y").alias("n_positive"))
        return sizes.where(F.col("n") >= min_n).join(areas, keys, "left").join(precisions, keys, "left")
    counted = cut(stacked.groupBy(*keys, "_p", "_t").agg(F.count(F.lit(1)).alias("_n")))  # all three metrics are of counts of pairs
    error = counted.where("_p is not null and _t is not null").groupBy(*keys).agg(F.sqrt(F.sum(F.col("_n") * F.pow(F.col("_p") - F.col("_t"), F.lit(2.0))) / F.sum("_n")).alias("_e")).select(*keys, F.when(F.col("model") != "B1", F.col("_e")).alias("rmse"))
    ranks = spearman(counted, "_p", "_t", keys, min_n=min_n, count="_n")
    return ranks.join(pearson(counted, "_p", "_t", keys, min_n=min_n, count="_n").drop("n"), keys).join(error, keys)


def group_summary(metrics: DataFrame, metric: str = "rho") -> DataFrame:
    """model, n_groups, median, low and high quartile, groups over 0.3 and under 0 of a metric by group. Groups without the metric don't count."""
    metrics = cut(metrics)
    spread = exact_quantiles(metrics, metric, [0.5, 0.25, 0.75], ["model"]).select(F.col("model").alias("_m"), F.col("q")[0].alias("median"), F.col("q")[1].alias("q1"), F.col("q")[2].alias("q3"))
    counts = metrics.where(F.col(metric).isNotNull()).groupBy("model").agg(F.count(F.lit(1)).alias("n_groups"), F.count_if(F.col(metric) > 0.3).alias("n_over_03"), F.count_if(F.col(metric) < 0).alias("n_under_0"))
    return counts.join(spread, F.col("model") == F.col("_m")).select("model", "n_groups", "median", "q1", "q3", "n_over_03", "n_under_0")


def model_deltas(predicted: DataFrame, target: str, cluster: str, *, classify: bool = False, pairs: Sequence[tuple[str, str]] = (("B3", "B2"), ("B3", "B1")), n_boot: int = 1000, seed: int = 11) -> DataFrame:
    """first, second, n_replicates, low, high, mean: intervals of differences of two models on the same resamples of clusters.

    Of a class the AUROCs are compared, else the squared errors. A pair with B1, a raw score, is compared by AUROC only and else left out.
    """
    out = None
    for i, (a, b) in enumerate(p for p in pairs if classify or "B1" not in p):
        options = {"n_boot": n_boot, "seed": seed + i}
        found = resample.paired_auroc_delta(predicted, target, f"pred_{a}", f"pred_{b}", cluster, **options) if classify else resample.paired_delta(predicted, cluster, target, f"pred_{a}", f"pred_{b}", **options)
        found = found.select(F.lit(a).alias("first"), F.lit(b).alias("second"), "*")
        out = found if out is None else out.unionByName(found)
    return out


def label_strata(predicted: DataFrame, labels: DataFrame, keys: Sequence[str], label: str, target: str, *, models: Sequence[str] = ("B3",), min_n: int = 10) -> DataFrame:
    """Metrics of predictions that are there already, by a recovered ``label``: rows as of :func:`model_metrics`, with n_matched and n_total.

    ``labels`` has one label for each of ``keys`` at most; of several the least counts. Rows without a label are in n_total only. Nothing is trained.
    """
    one = labels.where(F.col(label).isNotNull()).groupBy(*keys).agg(F.min(label).alias("stratum"))
    joined = predicted.join(one, list(keys), "left")
    found = model_metrics(joined.where("stratum is not null"), target, ["stratum"], models=models, min_n=min_n)
    totals = joined.agg(F.count("stratum").alias("n_matched"), F.count(F.lit(1)).alias("n_total")).withColumn("_j", F.lit(1))
    return found.withColumn("_j", F.lit(1)).join(F.broadcast(totals), "_j").drop("_j")

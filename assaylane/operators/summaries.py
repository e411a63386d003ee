"""Funnels, histograms, threshold sweeps, composition and ensemble summaries."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def funnel(df: DataFrame, steps: Sequence[tuple[str, Column]]) -> DataFrame:
    """step, name, remaining and removed after each filter in turn: one scan, whatever the number of filters."""
    passed, counts = F.lit(True), []
    for i, (name, condition) in enumerate(steps):
        passed = passed & F.coalesce(condition, F.lit(False))
        counts.append(F.struct(F.lit(i + 1).alias("step"), F.lit(name).alias("name"), F.count_if(passed).alias("remaining")))
    start = F.struct(F.lit(0).alias("step"), F.lit("all").alias("name"), F.count(F.lit(1)).alias("remaining"))
    rows = df.agg(F.array(start, *counts).alias("rows")).select(F.explode("rows").alias("r")).select("r.*")
    before = F.lag("remaining").over(Window.orderBy("step"))
    return rows.withColumn("removed", F.coalesce(before - F.col("remaining"), F.lit(0)))


def histogram(df: DataFrame, value: str, edges: Sequence[float]) -> DataFrame:
    """bin (from 0), low, high and n of all bins, also empty ones; bins are closed on the left, the last on both sides."""
    last = len(edges) - 2
    bin_of = F.when(F.col(value) == edges[-1], last)
    for i in range(last + 1):
        bin_of = bin_of.when((F.col(value) >= edges[i]) & (F.col(value) < edges[i + 1]), i)
    counted = df.select(bin_of.alias("bin")).where("bin is not null").groupBy("bin").agg(F.count(F.lit(1)).alias("n"))
    spark = df.sparkSession
    bins = spark.createDataFrame([(i, float(edges[i]), float(edges[i + 1])) for i in range(last + 1)], "bin int, low double, high double")
    return bins.join(counted, "bin", "left").select("bin", "low", "high", F.coalesce("n", F.lit(0)).alias("n"))


def equal_width_histogram(df: DataFrame, value: str, n_bins: int) -> DataFrame:
    """bin (from 1) and n of the bins of equal width between least and greatest value that hold any."""
    bounds = df.agg(F.min(value).alias("_lo"), F.max(value).alias("_hi")).withColumn("_j", F.lit(1))
    placed = df.where(F.col(value).isNotNull()).withColumn("_j", F.lit(1)).join(F.broadcast(bounds), "_j")
    width = (F.col("_hi") - F.col("_lo")) / n_bins
    at = F.when(width == 0, 1).otherwise(F.least(F.floor((F.col(value) - F.col("_lo")) / width) + 1, F.lit(n_bins)))
    return placed.groupBy(at.cast("int").alias("bin")).agg(F.count(F.lit(1)).alias("n"))


def _first_at_least(value: Column, thresholds: Sequence[float], low: int = 0) -> Column:
    """The place of the first of the ascending thresholds that is at least the value, as a balanced tree of comparisons; their number if none is."""
    if not thresholds:
        return F.lit(low)
    middle = len(thresholds) // 2
    return F.when(value <= float(thresholds[middle]), _first_at_least(value, thresholds[:middle], low)).otherwise(_first_at_least(value, thresholds[middle + 1 :], low + middle + 1))


def threshold_sweep(df: DataFrame, score: str, label: str, thresholds: Sequence[float]) -> DataFrame:
    """Confusion counts and rates of "score at most the threshold is positive", for each threshold: one scan.

    Rows are counted by the first threshold that reaches them; a threshold then sums a table with a row for each threshold.
    """
    steps = sorted(float(t) for t in thresholds)
    y = F.col(label)
    counted = df.where(F.col(score).isNotNull()).groupBy(_first_at_least(F.col(score), steps).alias("_at")).agg(F.count_if(y).alias("_p"), F.count_if(~y).alias("_n"))
    places = df.sparkSession.createDataFrame(list(enumerate(steps)), "_i int, threshold double")
    met = counted.withColumn("_i", F.explode(F.sequence(F.lit(0), F.lit(len(steps) - 1))))
    hit = F.col("_at") <= F.col("_i")
    sums = met.groupBy("_i").agg(*[F.sum(F.when(c, n).otherwise(0)).alias(a) for a, c, n in (("tp", hit, F.col("_p")), ("fp", hit, F.col("_n")), ("fn", ~hit, F.col("_p")), ("tn", ~hit, F.col("_n")))])
    rows = places.join(sums, "_i").drop("_i")
    tp, fp, fn, tn = (F.col(c).cast("double") for c in ("tp", "fp", "fn", "tn"))
    rows = rows.withColumns({"tpr": F.try_divide(tp, tp + fn), "tnr": F.try_divide(tn, tn + fp), "ppv": F.try_divide(tp, tp + fp), "npv": F.try_divide(tn, tn + fn), "accuracy": F.try_divide(tp + tn, tp + fp + fn + tn)})
    return rows.withColumns({"fpr": 1 - F.col("tnr"), "fnr": 1 - F.col("tpr"), "fdr": 1 - F.col("ppv"), "lr_plus": F.try_divide("tpr", 1 - F.col("tnr")), "lr_minus": F.try_divide(1 - F.col("tpr"), "tnr"), "youden": F.col("tpr") + F.col("tnr") - 1})


def trapezoid_area(points: DataFrame, x: str, y: str) -> DataFrame:
    """Area under the points in order of x and then y: a curve has a row for each threshold."""
    w = Window.orderBy(x, y)
    steps = points.where(F.col(x).isNotNull() & F.col(y).isNotNull()).select(((F.col(x) - F.lag(x).over(w)) * (F.col(y) + F.lag(y).over(w)) / 2.0).alias("part"))
    return steps.agg(F.coalesce(F.sum("part"), F.lit(0.0)).alias("area"))


def best_threshold(sweep: DataFrame, by: str = "accuracy") -> DataFrame:
    """The row of the largest ``by``, the lowest threshold of equals."""
    return sweep.orderBy(F.col(by).desc_nulls_last(), F.col("threshold").asc()).limit(1)


def composition(df: DataFrame, group: str, item: str, kind: str, kinds: Sequence[str], value: str) -> DataFrame:
    """For each group: rows, different items, rows of each kind, range of values, and share of all rows."""
    counts = [F.count_if(F.col(kind) == k).alias(f"n_{k.lower()}") for k in kinds]
    rows = df.groupBy(group).agg(F.count(F.lit(1)).alias("n"), F.count_distinct(item).alias("n_items"), *counts, F.min(value).alias("low"), F.max(value).alias("high"))
    return rows.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy()))


def top_and_other(counts: DataFrame, name: str, n: str, k: int, *, other: str = "Other") -> DataFrame:
    """The k largest rows of a table of counts, a row for each name, and the rest as one, if there is a rest."""
    top = counts.orderBy(F.col(n).desc(), F.col(name).asc()).limit(k).select(name, n)
    rest = counts.join(top.select(F.col(name).alias("_top")), F.col(name).eqNullSafe(F.col("_top")), "left_anti")
    return top.unionByName(rest.agg(F.sum(n).alias(n)).where(F.col(n).isNotNull()).select(F.lit(other).alias(name), n)).groupBy(name).agg(F.sum(n).alias(n))


def ordered_columns(df: DataFrame, order: Sequence[str]) -> DataFrame:
    """The columns of ``order`` that are there, in that order, and all others after them as they stood."""
    first = [c for c in order if c in df.columns]
    return df.select(*[F.col(f"`{c}`") for c in [*first, *(c for c in df.columns if c not in first)]])


def spikes(df: DataFrame, value: str, k: int, share: float) -> DataFrame:
    """The k most frequent values, their share of all rows, and whether it is over ``share``."""
    rows = df.where(F.col(value).isNotNull())
    total = rows.agg(F.count(F.lit(1)).alias("_total")).withColumn("_j", F.lit(1))
    top = rows.groupBy(value).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), F.asc(value)).limit(k)
    found = top.withColumn("_j", F.lit(1)).join(F.broadcast(total), "_j").select(value, "n", (F.col("n") / F.col("_total")).alias("share"))
    return found.withColumn("is_spike", F.col("share") > share)


def policies(df: DataFrame, named: Mapping[str, Column]) -> DataFrame:
    """A row for each policy and row of ``df`` that the policy keeps: one scan for all policies."""
    tags = F.filter(F.array(*[F.when(F.coalesce(c, F.lit(False)), F.lit(n)) for n, c in named.items()]), lambda x: x.isNotNull())
    return df.withColumn("policy", F.explode(tags))


def best_and_mean(df: DataFrame, keys: Sequence[str], score: str, *, top: int = 5, expected: int | None = None) -> DataFrame:
    """Members, least, mean, and mean of the ``top`` least scores of each ensemble; ``complete`` if it has ``expected`` members."""
    rn = F.row_number().over(Window.partitionBy(*keys).orderBy(F.col(score).asc_nulls_last()))
    rows = df.withColumn("_rn", rn).groupBy(*keys).agg(F.count(score).alias("n"), F.min(score).alias("best"), F.avg(score).alias("mean"), F.avg(F.when(F.col("_rn") <= top, F.col(score))).alias("top_mean"))
    return rows if expected is None else rows.withColumn("complete", F.col("n") == expected)


def fractions_to_percent(df: DataFrame, column: str, *, most: float = 1.5) -> DataFrame:
    """A column that holds fractions (no value over ``most``) in per cent; one that holds per cent already, unchanged."""
    top = df.agg(F.max(column).alias("_top")).withColumn("_j", F.lit(1))
    scaled = F.when(F.col("_top") <= most, F.col(column) * 100).otherwise(F.col(column))
    return df.withColumn("_j", F.lit(1)).join(F.broadcast(top), "_j").withColumn(column, scaled).drop("_j", "_top")

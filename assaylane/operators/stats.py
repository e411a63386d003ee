"""Rank statistics, correlations, tests and their corrections.

All work on counts of distinct values, so that a group is never gathered in one task.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .ordered import average_rank, cumulate


def spearman(df: DataFrame, x: str, y: str, by: Sequence[str] = (), *, min_n: int = 3, count: str | None = None) -> DataFrame:
    """rho and n of each group with at least ``min_n`` complete pairs; rho is NULL where one side is constant. ``count`` names a column of how often a row counts."""
    pairs = df.where(F.col(x).isNotNull() & F.col(y).isNotNull())
    if count is None:
        pairs = pairs.select(*by, F.col(x).alias("_x"), F.col(y).alias("_y"))
        ranked = average_rank(average_rank(pairs, "_x", by, out="_rx"), "_y", by, out="_ry")
        return _correlated(ranked, "_rx", "_ry", by, "rho", min_n)
    pairs = pairs.select(*by, F.col(x).alias("_x"), F.col(y).alias("_y"), F.col(count).alias("_n"))
    ranked = average_rank(average_rank(pairs, "_x", by, out="_rx", count="_n"), "_y", by, out="_ry", count="_n")
    return _correlated_counts(ranked, "_rx", "_ry", by, "rho", min_n, "_n")


def pearson(df: DataFrame, x: str, y: str, by: Sequence[str] = (), *, min_n: int = 3, count: str | None = None) -> DataFrame:
    """r and n of each group; NULL where one side is constant."""
    pairs = df.where(F.col(x).isNotNull() & F.col(y).isNotNull())
    return _correlated(pairs, x, y, by, "r", min_n) if count is None else _correlated_counts(pairs, x, y, by, "r", min_n, count)


def _correlated_counts(df: DataFrame, x: str, y: str, by: Sequence[str], name: str, min_n: int, count: str) -> DataFrame:
    """Correlation of rows that count ``count`` times: moments about the middle of each group's range, which keeps them small."""
    ends = df.groupBy(*by).agg(*[f(c).cast("double").alias(f"_{k}{a}") for k, c in (("x", x), ("y", y)) for f, a in ((F.min, "0"), (F.max, "1"))]).select(*[F.col(b).alias(f"_b_{b}") for b in by], "_x0", "_x1", "_y0", "_y1")
    same = F.lit(True)
    for b in by:
        same = same & F.col(b).eqNullSafe(F.col(f"_b_{b}"))
    n, u, v = F.col(count), F.col(x) - (F.col("_x0") + F.col("_x1")) / 2, F.col(y) - (F.col("_y0") + F.col("_y1")) / 2
    sums = {"n": n, "_u": n * u, "_v": n * v, "_uu": n * u * u, "_vv": n * v * v, "_uv": n * u * v}
    found = df.join(ends, same).groupBy(*by).agg(*[F.sum(c).alias(k) for k, c in sums.items()], F.max((F.col("_x0") < F.col("_x1")) & (F.col("_y0") < F.col("_y1"))).alias("_varied"))
    about = lambda a, b, both: F.col(both) - F.col(a) * F.col(b) / F.col("n")
    r = F.try_divide(about("_u", "_v", "_uv"), F.sqrt(about("_u", "_u", "_uu")) * F.sqrt(about("_v", "_v", "_vv")))
    return found.where(F.col("n") >= min_n).select(*by, "n", F.when(F.col("_varied"), r).alias(name))


def correlation(x: str, y: str) -> Column:
    """The correlation of two columns as an aggregate; NULL where one is constant, for which ``corr`` raises an error."""
    return F.try_divide(F.covar_pop(x, y), F.stddev_pop(x) * F.stddev_pop(y))


def _correlated(df: DataFrame, x: str, y: str, by: Sequence[str], name: str, min_n: int) -> DataFrame:
    found = df.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), correlation(x, y).alias(name))
    return found.where(F.col("n") >= min_n).select(*by, "n", name)


def spearman_matrix(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """rho of every pair of columns, over the rows in which both have a value."""
    parts = [spearman(df, a, b, min_n=2).select(F.lit(a).alias("x"), F.lit(b).alias("y"), "n", "rho") for i, a in enumerate(columns) for b in columns[i + 1 :]]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def regression(df: DataFrame, x: str, y: str, by: Sequence[str] = ()) -> DataFrame:
    """slope, intercept, r2 and rmse of the least-squares line."""
    fit = df.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.regr_slope(y, x).alias("slope"), F.regr_intercept(y, x).alias("intercept"), F.regr_r2(y, x).alias("r2"), F.var_pop(y).alias("_v"))
    return fit.withColumn("rmse", F.sqrt(F.greatest(F.col("_v") * (1 - F.col("r2")), F.lit(0.0)))).drop("_v")


def auroc(df: DataFrame, score: str, label: str, by: Sequence[str] = (), *, min_each: int = 1) -> DataFrame:
    """auroc, effect size (2 auroc - 1) and class sizes of each group that has ``min_each`` rows of both classes.

    A boolean ``label`` marks the positive class; a larger score should mean positive. By the rank sum: for each
    distinct score the positives that beat the negatives below it, ties counting half.
    """
    rows = df.where(F.col(score).isNotNull() & F.col(label).isNotNull())
    counted = rows.groupBy(*by, score).agg(F.count_if(F.col(label)).alias("pos"), F.count_if(~F.col(label)).alias("neg"))
    run = cumulate(counted, by, score, ["neg"])
    sums = run.groupBy(*by).agg(F.sum("pos").alias("n_pos"), F.sum("neg").alias("n_neg"), F.sum(F.col("pos") * (F.col("neg_before") + F.col("neg") / F.lit(2.0))).cast("double").alias("_u"))
    fit = sums.where((F.col("n_pos") >= min_each) & (F.col("n_neg") >= min_each)).withColumn("auroc", F.col("_u") / (F.col("n_pos").cast("double") * F.col("n_neg")))
    return fit.withColumn("effect", 2 * F.col("auroc") - 1).select(*by, "n_pos", "n_neg", "auroc", "effect")


def average_precision(df: DataFrame, score: str, label: str, by: Sequence[str] = ()) -> DataFrame:
    """Area under precision against recall, rows of one score entering together, and the prevalence."""
    rows = df.where(F.col(score).isNotNull() & F.col(label).isNotNull())
    counted = rows.groupBy(*by, score).agg(F.count_if(F.col(label)).alias("pos"), F.count(F.lit(1)).alias("all"))
    run = cumulate(counted, by, score, ["pos", "all"], descending=True)
    precision = (F.col("pos_before") + F.col("pos")).cast("double") / (F.col("all_before") + F.col("all"))
    sums = run.groupBy(*by).agg(F.sum("pos").alias("n_pos"), F.sum("all").alias("n"), F.sum(F.col("pos") * precision).alias("_s"))
    return sums.where("n_pos > 0").select(*by, "n", "n_pos", (F.col("_s") / F.col("n_pos")).alias("average_precision"), (F.col("n_pos").cast("double") / F.col("n")).alias("prevalence"))


def kruskal(df: DataFrame, value: str, group: str, *, min_each: int = 2) -> DataFrame:
    """Tie-corrected H of the groups with at least ``min_each`` values, and its degrees of freedom: one row."""
    sizes = df.where(F.col(value).isNotNull()).groupBy(group).agg(F.count(F.lit(1)).alias("_size")).where(F.col("_size") >= min_each)
    rows = df.where(F.col(value).isNotNull()).join(F.broadcast(sizes) if sizes.count() <= 100_000 else sizes, group)
    counted = rows.groupBy(value).agg(F.count(F.lit(1)).alias("n"))
    ranks = cumulate(counted, [], value, ["n"]).select(F.col(value).alias("_v"), "n", (F.col("n_before") + (F.col("n") + 1) / F.lit(2.0)).cast("double").alias("rank"))
    ties = ranks.agg(F.sum(F.col("n").cast("double") * F.col("n") * F.col("n") - F.col("n")).alias("ties"), F.sum("n").cast("double").alias("total"))
    sums = rows.join(ranks.select("_v", "rank"), F.col(value) == F.col("_v")).groupBy(group).agg(F.sum("rank").alias("r"), F.count(F.lit(1)).alias("n"))
    total = sums.agg(F.sum(F.col("r") * F.col("r") / F.col("n")).alias("s"), F.count(F.lit(1)).alias("k"))
    h = (12.0 / (F.col("total") * (F.col("total") + 1)) * F.col("s") - 3 * (F.col("total") + 1)) / (1 - F.col("ties") / (F.pow("total", F.lit(3.0)) - F.col("total")))
    one = total.withColumn("_j", F.lit(1)).join(ties.withColumn("_j", F.lit(1)), "_j")
    return one.select(F.col("k").alias("n_groups"), F.col("total").cast("bigint").alias("n"), h.alias("h"), (F.col("k") - 1).alias("df"))


def ks_distance(df: DataFrame, value: str, group: str, a, b) -> DataFrame:
    """Largest distance between the distribution functions of two groups, taken after each distinct value: one row."""
    rows = df.where(F.col(value).isNotNull() & F.col(group).isin(a, b))
    counted = rows.groupBy(value).agg(F.count_if(F.col(group) == a).alias("in_a"), F.count_if(F.col(group) == b).alias("in_b"))
    run = cumulate(counted, [], value, ["in_a", "in_b"])
    totals = counted.agg(F.sum("in_a").alias("n_a"), F.sum("in_b").alias("n_b"))
    gap = F.abs((F.col("in_a_before") + F.col("in_a")).cast("double") / F.col("n_a") - (F.col("in_b_before") + F.col("in_b")).cast("double") / F.col("n_b"))
    return run.withColumn("_j", F.lit(1)).join(F.broadcast(totals.withColumn("_j", F.lit(1))), "_j").agg(F.max("n_a").alias("n_a"), F.max("n_b").alias("n_b"), F.max(gap).alias("d"))


def holm(df: DataFrame, p: str, family: Sequence[str], *, order: Sequence[str], out: str = "p_holm") -> DataFrame:
    """Step-down adjusted p-values within a family of tests; ``order`` breaks ties.

    A family is a set of tests, one for each group of some earlier result: its rows are few.
    """
    w = Window.partitionBy(*family)
    ranked = w.orderBy(F.col(p).asc(), *[F.col(o).asc() for o in order])
    scaled = F.least(F.lit(1.0), F.col(p) * (F.count(p).over(w) - F.row_number().over(ranked) + 1))
    return df.withColumn("_scaled", scaled).withColumn(out, F.max("_scaled").over(ranked.rowsBetween(Window.unboundedPreceding, 0))).drop("_scaled")



def incomplete_beta(a: float, b: float, x: float) -> float:
    """The regularised incomplete beta function, by its continued fraction (modified Lentz)."""
    if x <= 0 or x >= 1:
        return float(x >= 1)
    if x > (a + 1) / (a + b + 2):
        return 1 - incomplete_beta(b, a, 1 - x)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)) / a
    tiny, c, d = 1e-300, 1.0, 1 - (a + b) * x / (a + 1)
    d = 1 / (d if abs(d) > tiny else tiny)
    total = d
    for m in range(1, 500):
        for step in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 + step * d
            c = 1 + step / c
            d, c = 1 / (d if abs(d) > tiny else tiny), c if abs(c) > tiny else tiny
            total *= c * d
        if abs(c * d - 1) < 1e-14:
            break
    return front * total


def upper_gamma(a: float, x: float) -> float:
    """The regularised upper incomplete gamma function: a series below a + 1, a continued fraction above."""
    if x <= 0:
        return 1.0
    front = math.exp(a * math.log(x) - x - math.lgamma(a))
    if x < a + 1:
        term = total = 1 / a
        for n in range(1, 1000):
            term *= x / (a + n)
            total += term
            if term < total * 1e-15:
                break
        return 1 - front * total
    b, tiny = x + 1 - a, 1e-300
    c, d = 1 / tiny, 1 / b
    total = d
    for n in range(1, 1000):
        step = -n * (n - a)
        b += 2
        d = 1 / ((step * d + b) or tiny)
        c = (b + step / c) or tiny
        total *= c * d
        if abs(c * d - 1) < 1e-15:
            break
    return front * total


@F.pandas_udf(T.DoubleType())
def correlation_p(r: pd.Series, n: pd.Series) -> pd.Series:
    """Two-sided p of a correlation by Student's t with n - 2 degrees of freedom; missing under three pairs."""

    def one(r: float, n: float) -> float | None:
        if r is None or r != r or n < 3:
            return None
        return 0.0 if abs(r) >= 1 else incomplete_beta((n - 2) / 2, 0.5, 1 - r * r)

    return pd.Series([one(a, b) for a, b in zip(r, n, strict=True)], dtype=float)


@F.pandas_udf(T.DoubleType())
def chi2_p(h: pd.Series, df: pd.Series) -> pd.Series:
    """Upper tail of chi squared."""
    return pd.Series([upper_gamma(b / 2, a / 2) if a == a else None for a, b in zip(h, df, strict=True)], dtype=float)


@F.pandas_udf(T.DoubleType())
def ks_p(d: pd.Series, n_a: pd.Series, n_b: pd.Series) -> pd.Series:
    """Asymptotic two-sided p of the two-sample Kolmogorov-Smirnov distance."""

    def one(d: float, a: float, b: float) -> float:
        z = d * math.sqrt(a * b / (a + b))
        return 1.0 if z < 0.2 else min(1.0, max(0.0, 2 * sum((-1) ** (k - 1) * math.exp(-2 * k * k * z * z) for k in range(1, 101))))

    return pd.Series([one(*x) for x in zip(d, n_a, n_b, strict=True)], dtype=float)


def rmse(a: Column, b: Column) -> Column:
    return F.sqrt(F.avg((a - b) * (a - b)))

from __future__ import annotations

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from assaylane.functions.predicates import confidence_tier, is_censored, right_closed_bin
from assaylane.operators import quality, resample, stats, summaries
from assaylane.operators.ordered import average_rank, cumulate


def test_average_rank_shares_ties(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", 2.0), ("a", 2.0), ("a", 5.0), ("b", 7.0), (None, 3.0), (None, 3.0)], "g string, x double")
    found = sorted((r.g or "", r.x, r["rank"]) for r in average_rank(df, "x", ["g"]).collect())
    assert found == [("", 3.0, 1.5), ("", 3.0, 1.5), ("a", 1.0, 1.0), ("a", 2.0, 2.5), ("a", 2.0, 2.5), ("a", 5.0, 4.0), ("b", 7.0, 1.0)]


def test_cumulate_matches_numpy(spark):
    rng = np.random.default_rng(1)
    rows = [(int(g), int(v), int(n)) for g, v, n in zip(rng.integers(0, 3, 200), rng.permutation(200), rng.integers(1, 9, 200), strict=True)]
    df = spark.createDataFrame(rows, "g int, v int, n long")
    found = {(r.g, r.v): r.n_before for r in cumulate(df, ["g"], "v", ["n"]).collect()}
    for g, v, _ in rows:
        assert found[g, v] == sum(n for h, w, n in rows if h == g and w < v)


def test_auroc_matches_normal_shift(spark):
    rng = np.random.default_rng(0)
    rows = [(float(x), True) for x in rng.normal(1, 1, 4000)] + [(float(x), False) for x in rng.normal(0, 1, 4000)]
    found = stats.auroc(spark.createDataFrame(rows, "s double, y boolean"), "s", "y").first()
    assert found.auroc == pytest.approx(0.5 * (1 + math.erf(0.5)), abs=0.02)
    assert found.effect == pytest.approx(2 * found.auroc - 1)


def test_auroc_needs_both_classes(spark):
    assert stats.auroc(spark.createDataFrame([(1.0, True)], "s double, y boolean"), "s", "y").count() == 0


def test_spearman_monotone_and_constant(spark):
    df = spark.createDataFrame([("m", float(i), float(-(i**3))) for i in range(20)] + [("c", float(i), 1.0) for i in range(20)], "g string, x double, y double")
    found = {r.g: r.rho for r in stats.spearman(df, "x", "y", ["g"]).collect()}
    assert found["m"] == pytest.approx(-1) and found["c"] is None


def test_p_values(spark):
    df = spark.createDataFrame([(-0.504, 16.0)], "r double, n double")
    assert df.select(stats.correlation_p("r", "n")).first()[0] == pytest.approx(0.0465, abs=2e-4)
    assert stats.upper_gamma(0.5, 3.841458820694124 / 2) == pytest.approx(0.05, abs=1e-9)
    assert stats.upper_gamma(5.0, 18.307038053275146 / 2) == pytest.approx(0.05, abs=1e-9)


def test_holm(spark):
    df = spark.createDataFrame([("f", "a", 0.01), ("f", "b", 0.04), ("f", "c", 0.03)], "f string, k string, p double")
    assert {r.k: round(r.p_holm, 6) for r in stats.holm(df, "p", ["f"], order=["k"]).collect()} == {"a": 0.03, "c": 0.06, "b": 0.06}


def test_kruskal_and_ks_see_a_shift(spark):
    rng = np.random.default_rng(2)
    df = spark.createDataFrame([("a", float(x)) for x in rng.normal(0, 1, 300)] + [("b", float(x)) for x in rng.normal(2, 1, 300)], "g string, v double")
    assert stats.kruskal(df, "v", "g").first().h > 200
    assert stats.ks_distance(df, "v", "g", "a", "b").first().d > 0.6


def test_censoring_ignores_missing(spark):
    df = spark.createDataFrame([(None,), (float("nan"),), (20.0,), (70.0,), (3.0,)], "v double")
    assert [r[0] for r in df.select(is_censored(F.col("v"), [20.0], 50.0)).collect()] == [False, False, True, True, False]


def test_tiers_and_bins(spark):
    df = spark.createDataFrame([(None, 9.0), (90.0, 3.0), (90.0, 1.0), (10.0, 1.0), (50.0, 1.0)], "i double, r double")
    assert [r[0] for r in df.select(confidence_tier(F.col("i"), F.col("r"))).collect()] == ["no_template", "outlier", "high", "low", "moderate"]
    bins = spark.createDataFrame([(0.0,), (1.0,), (1.5,), (2.0,), (3.0,)], "v double")
    assert [r[0] for r in bins.select(right_closed_bin(F.col("v"), [0, 1, 2])).collect()] == [0, 0, 1, 1, None]


def test_histogram_closes_the_last_bin(spark):
    df = spark.createDataFrame([(0.0,), (1.0,), (2.0,), (None,)], "v double")
    assert [r.n for r in summaries.histogram(df, "v", [0, 1, 2]).orderBy("bin").collect()] == [1, 2]


def test_funnel_counts_missing_as_removed(spark):
    df = spark.createDataFrame([(1, None), (1, 5), (None, 5)], "a int, b int")
    found = summaries.funnel(df, [("a", F.col("a") == 1), ("b", F.col("b") == 5)])
    assert [(r.name, r.remaining, r.removed) for r in found.orderBy("step").collect()] == [("all", 3, 0), ("a", 2, 1), ("b", 1, 1)]


def test_bootstrap_interval_holds_the_estimate(spark):
    rng = np.random.default_rng(3)
    rows = [(float(x), True) for x in rng.normal(1, 1, 300)] + [(float(x), False) for x in rng.normal(0, 1, 300)]
    df = spark.createDataFrame(rows, "s double, y boolean")
    found = resample.bootstrap_auroc(df, "s", "y", n_boot=100).first()
    point = stats.auroc(df, "s", "y").first().auroc
    assert found.low < point < found.high and found.n_replicates == 100


def test_bootstrap_without_both_classes_is_missing(spark):
    df = spark.createDataFrame([(1.0, True), (2.0, True)], "s double, y boolean")
    assert resample.bootstrap_auroc(df, "s", "y", n_boot=20).first().low is None


def test_expectations(spark):
    df = spark.createDataFrame([(1, 1.0), (1, None)], "k int, v double")
    found = {r.expectation: (r.violations, r.holds) for r in quality.report(quality.expect(df, "v", F.col("v") > 0), quality.expect_unique(df, "k", ["k"]), quality.expect_equal(df, "same", "v", "v")).collect()}
    assert found == {"v": (1, False), "k": (1, False), "same": (0, True)}
    with pytest.raises(ValueError):
        quality.refuse_overwrite("/a/", "/a")

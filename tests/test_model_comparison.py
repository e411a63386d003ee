"""Models compared out of fold, metrics by group and label, and resampled differences."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from assaylane.operators import ml, resample


@pytest.fixture(scope="module")
def rows(spark):
    draw = np.random.default_rng(6)
    out = []
    for i in range(360):
        sequence = "".join(draw.choice(list("ACDE"), 9))
        score = float(draw.normal())
        y = 2.0 * (sequence[0] == "A") + score + 0.1 * float(draw.normal())
        out.append((sequence, "g%d" % (i % 3), "c%d" % (i % 24), score, -score, y, int(y > 1), i % 3))
    return spark.createDataFrame(out, "sequence string, grp string, cluster string, structure double, score double, y double, strong int, fold int")


def test_models_out_of_fold(rows):
    blocks = ml.feature_blocks(rows, "sequence", ["structure"], "grp").cache()
    assert blocks.first().B2.size == 9 * 20 + 2 and blocks.first().B3.size == 9 * 20 + 3
    found = ml.compare_out_of_fold(blocks, "fold", range(3), "y", "score", rounds=30, depth=3).cache()
    assert found.count() == 360 and found.where("fold = 0").agg(F.min("pred_B0")).first()[0] == pytest.approx(rows.where("fold <> 0").agg(F.avg("y")).first()[0])
    m = {r.model: r for r in ml.model_metrics(found, "y").collect()}
    assert m["B0"].rho is None or abs(m["B0"].rho) < 0.3
    assert m["B1"].rho < -0.5 and m["B1"].rmse is None and m["B3"].rho > m["B2"].rho > 0.3 and m["B3"].rmse < m["B2"].rmse < m["B0"].rmse
    by_group = ml.model_metrics(found, "y", ["grp"])
    assert {(r.grp, r.model): r.n for r in by_group.collect()}["g1", "B3"] == 120
    spread = {r.model: r for r in ml.group_summary(by_group).collect()}
    assert spread["B3"].n_groups == 3 and spread["B3"].n_over_03 == 3 and spread["B1"].n_under_0 == 3 and spread["B3"].q1 <= spread["B3"].median <= spread["B3"].q3
    deltas = ml.model_deltas(found, "y", "cluster", n_boot=100).collect()
    assert [(r["first"], r["second"]) for r in deltas] == [("B3", "B2")] and deltas[0].high < 0


def test_classifiers_out_of_fold(rows):
    blocks = ml.feature_blocks(rows, "sequence", ["structure"]).cache()
    found = ml.compare_out_of_fold(blocks, "fold", range(3), "strong", "score", classify=True, rounds=15, depth=3).cache()
    m = {r.model: r for r in ml.model_metrics(found, "strong", classify=True).collect()}
    assert m["B1"].auroc > 0.6 and m["B3"].auroc > m["B2"].auroc > 0.6 and m["B3"].average_precision > 0.6
    deltas = {(r["first"], r["second"]): r for r in ml.model_deltas(found, "strong", "cluster", classify=True, n_boot=100).collect()}
    assert set(deltas) == {("B3", "B2"), ("B3", "B1")} and deltas["B3", "B2"].low > 0
    one = blocks.withColumn("strong", F.when(F.col("fold") == 0, F.col("strong")).otherwise(1))
    part = ml.compare_out_of_fold(one, "fold", [0], "strong", "score", classify=True, rounds=2, depth=2)
    assert part.agg(F.min("pred_B3"), F.max("pred_B2")).first() == (1.0, 1.0)
    assert ml.compare_out_of_fold(one.where("false"), "fold", [0], "strong", "score").count() == 0


def test_label_strata(spark, rows):
    predicted = rows.withColumn("pred_B3", F.col("structure"))
    labels = spark.createDataFrame([(f"c{i}", "kd" if i < 12 else "kd2") for i in range(20)] + [("c0", "later"), ("c1", None)], "cluster string, label string")
    found = {r.stratum: r for r in ml.label_strata(predicted, labels, ["cluster"], "label", "y").collect()}
    assert set(found) == {"kd", "kd2"} and found["kd"].n == 180 and found["kd2"].n == 120 and found["kd"].n_matched == 300 and found["kd"].n_total == 360
    assert found["kd"].rho > 0.3


def test_clustered_replicates(spark, monkeypatch):
    monkeypatch.setattr(resample, "HELD", 60)  # pieces of two rows, so equal scores are cut apart
    draw = np.random.default_rng(1)
    data = [(float(draw.integers(0, 4)), int(draw.integers(0, 2)), f"c{draw.integers(0, 5)}") for _ in range(60)]
    df = spark.createDataFrame(data, "s double, y int, c string").repartition(3)
    found = {r.replicate: r.value for r in resample.auroc_replicates(df, "s", "y", n_boot=30, seed=3, cluster="c").collect()}
    keys = {r.c: r.k for r in df.select("c", F.xxhash64(F.lit(3), "c").alias("k")).distinct().collect()}
    weights = {c: resample.poisson_weights(np.array([k]), np.ones(1), 30)[0] for c, k in keys.items()}
    for r in range(30):
        pos = [(s, weights[c][r]) for s, y, c in data if y]
        neg = [(s, weights[c][r]) for s, y, c in data if not y]
        total = sum(w for _, w in pos) * sum(w for _, w in neg)
        wins = sum(a * b * (1.0 if s > t else 0.5 if s == t else 0.0) for s, a in pos for t, b in neg)
        assert found[r] == (pytest.approx(wins / total) if total else None)

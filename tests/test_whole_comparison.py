"""The compared models have the survey's sizes, and each fold's predictions come from its own fit."""

from __future__ import annotations

import random

import pytest
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.regression import GBTRegressor
from pyspark.sql import functions as F

from assaylane.operators import ml
from assaylane.plans import models


def asked(monkeypatch, kind):
    """Sizes of the fits, which are then made with one round."""
    sizes, fit = [], kind.fit

    def small(self, df):
        sizes.append((self.getMaxIter(), self.getMaxDepth(), self.getMinInstancesPerNode(), self.getMaxBins(), self.getFeaturesCol(), tuple(sorted(r.fold for r in df.select("fold").distinct().collect()))))
        return fit(self.copy({self.maxIter: 1}), df)

    monkeypatch.setattr(kind, "fit", small)
    return sizes


WHOLE = sorted((300, 5, 50, 255, b, tuple(g for g in range(5) if g != f)) for b in ("B2", "B3") for f in range(5))


def test_classifiers_are_whole(spark, sf_dir, monkeypatch):
    sizes = asked(monkeypatch, GBTClassifier)
    assert models.compare_classifiers(spark, sf_dir).count() > 0
    assert sorted(sizes) == WHOLE


def test_regressors_are_whole(spark, sf_dir, monkeypatch):
    sizes = asked(monkeypatch, GBTRegressor)
    assert models.compare_regressors(spark, sf_dir).count() > 0
    assert sorted(sizes) == WHOLE


@pytest.mark.parametrize("classify", [False, True])
def test_fits_at_once_equal_fits_in_turn(spark, classify):
    rng = random.Random(8)
    rows = [(i, rng.choice("ACDE") * 9, rng.random(), rng.random(), rng.randrange(2), i % 3) for i in range(120)]
    blocks = ml.feature_blocks(spark.createDataFrame(rows, "id long, sequence string, score double, y double, strong int, fold int"), "sequence", ["score"]).cache()
    target = "strong" if classify else "y"
    found = {r.id: r for r in ml.compare_out_of_fold(blocks, "fold", range(3), target, "score", classify=classify, rounds=3, depth=2, min_rows=5).collect()}
    assert len(found) == 120
    kind = GBTClassifier if classify else GBTRegressor
    for f in range(3):
        for b in ("B2", "B3"):
            model = kind(labelCol="_y", featuresCol=b, maxIter=3, stepSize=0.05, maxDepth=2, minInstancesPerNode=5, maxBins=255, seed=0).fit(blocks.where(F.col("fold") != f).withColumn("_y", F.col(target).cast("double")))
            for r in model.transform(blocks.where(F.col("fold") == f)).collect():
                assert found[r.id][f"pred_{b}"] == pytest.approx(r.probability[1] if classify else r.prediction, abs=1e-9)

"""Models out of fold: what their fits hold and how often their rows are made."""

from __future__ import annotations

import random

import pytest
from pyspark.ml.regression import GBTRegressor
from pyspark.sql import functions as F

from assaylane.operators import ml


def test_equal_vectors_are_learned_as_one_row(spark, monkeypatch):
    rng = random.Random(4)
    rows = [(float(a), float(b), a * b + rng.random(), rng.randrange(2)) for a in range(8) for b in range(5) for _ in range(30)]
    ready = ml.features(spark.createDataFrame(rows, "a double, b double, y double, fold int"), None, ["a", "b"])
    plain = {f: GBTRegressor(labelCol="y", maxIter=4, stepSize=0.1, maxDepth=3, seed=0, predictionCol="predicted").fit(ready.where(f"fold <> {f}")).transform(ready.where(f"fold = {f}")).collect() for f in (0, 1)}
    held, fit = [], GBTRegressor.fit
    monkeypatch.setattr(GBTRegressor, "fit", lambda self, df: held.append(df.count()) or fit(self, df))
    found = ml.out_of_fold(ready, "fold", "y", range(2), rounds=4, depth=3).collect()
    assert held == [40, 40] and len(found) == len(rows)
    wanted = {(r.a, r.b, r.fold): r.predicted for f in plain for r in plain[f]}
    assert all(r.predicted == pytest.approx(wanted[r.a, r.b, r.fold], abs=1e-9) for r in found)
    means = {f: [y for *_, y, g in rows if g != f] for f in (0, 1)}
    assert all(r.baseline == pytest.approx(sum(means[r.fold]) / len(means[r.fold])) for r in found)


@pytest.mark.parametrize("classify", [False, True])
def test_rows_are_made_once_for_all_fits(spark, classify):
    """A counter in the rows' plan: the fits and the metrics read what was written."""
    rng = random.Random(5)
    rows = [(rng.choice("ACDE") * 9, rng.random(), rng.random(), i % 2, i % 3) for i in range(90)]
    made = spark.sparkContext.accumulator(0)

    @F.udf("double")
    def counted(x):
        made.add(1)
        return x

    df = spark.createDataFrame(rows, "sequence string, score double, y double, strong int, fold int")
    blocks = ml.feature_blocks(df.withColumn("structure", counted("score")), "sequence", ["structure"])
    found = ml.compare_out_of_fold(blocks, "fold", range(3), "strong" if classify else "y", "score", classify=classify, rounds=2, depth=2)
    ml.model_metrics(found, "strong" if classify else "y", classify=classify).collect()
    assert found.count() == 90 and 90 <= made.value <= 180  # the filter and the column may each make it

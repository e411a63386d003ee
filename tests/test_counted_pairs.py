"""Correlations of counted pairs against those of the rows, and how often rows are read."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from assaylane.operators import ml, stats


def test_counts_stand_for_rows(spark):
    drawn = [("a", i % 7, i * i % 11, 1 + i % 4) for i in range(40)] + [("b", 3, i, 2) for i in range(9)] + [("a", None, 1, 5), (None, 1, 2, 1), (None, 2, 1, 3)]
    drawn = [(g, None if x is None else float(x), float(y), n) for g, x, y, n in drawn]
    counted = spark.createDataFrame(drawn, "g string, x double, y double, n long")
    rows = counted.withColumn("_", F.explode(F.sequence(F.lit(1), F.col("n").cast("int")))).drop("_")
    for of, name in ((stats.spearman, "rho"), (stats.pearson, "r")):
        one = {r.g: (r.n, r[name]) for r in of(counted, "x", "y", ["g"], count="n").collect()}
        all_rows = {r.g: (r.n, r[name]) for r in of(rows, "x", "y", ["g"]).collect()}
        assert set(one) == set(all_rows) == {"a", "b", None} and one["b"][1] is None
        for g in one:
            assert one[g][0] == all_rows[g][0] and one[g][1] == pytest.approx(all_rows[g][1], abs=1e-12)


def test_metrics_read_rows_once(spark):
    rows = spark.createDataFrame([("a", float(i % 5), float(i)) for i in range(30)], "g string, pred_B3 double, t double")
    plan = ml.model_metrics(rows, "t", ["g"], models=("B3",))._jdf.queryExecution().optimizedPlan().toString()
    assert "LogicalRDD" not in plan

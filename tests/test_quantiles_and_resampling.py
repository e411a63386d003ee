"""Exact quantiles, bootstraps that don't depend on partitions, and results that were wrong before."""

from __future__ import annotations

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from assaylane.operators import dedup, quality, quantiles, resample, summaries
from assaylane.sources import text


@pytest.mark.parametrize("accuracy", [1000, 10, 3])
def test_quantiles_equal_numpy(spark, accuracy):
    draw = np.random.default_rng(accuracy)
    groups = {"a": draw.normal(size=3000).round(1), "b": draw.exponential(size=500), None: np.array([4.0]), "c": np.array([1.0, 1.0, 7.0]), "d": np.full(200, 2.5)}
    rows = [(g, float(v)) for g, values in groups.items() for v in values] + [("a", None), ("empty", None)]
    random.Random(1).shuffle(rows)
    df = spark.createDataFrame(rows, "g string, v double").repartition(5)
    asked = [0.0, 0.02, 0.25, 0.5, 0.77, 0.98, 1.0]
    found = {r.g: r for r in quantiles.exact_quantiles(df, "v", asked, ["g"], accuracy=accuracy).collect()}
    assert set(found) == set(groups)
    for g, values in groups.items():
        assert found[g].n == len(values) and found[g].q == pytest.approx(np.quantile(values, asked).tolist())
    pooled = quantiles.exact_quantiles(df, "v", asked).first()
    assert pooled.q == pytest.approx(np.quantile(np.concatenate(list(groups.values())), asked).tolist())
    assert quantiles.exact_quantiles(df.where("false"), "v", [0.5], ["g"]).collect() == []


def test_quantiles_when_the_sketch_misses(spark, monkeypatch):
    monkeypatch.setattr(quantiles, "BROADCAST_GROUPS", 0)
    df = spark.createDataFrame([("g", float(v)) for v in range(1001)], "g string, v double")
    wrong = F.percentile_approx  # a sketch whose brackets hold nothing that is wanted
    monkeypatch.setattr(quantiles.F, "percentile_approx", lambda v, ps, a: F.transform(wrong(v, ps, a), lambda x: F.lit(-5.0)))
    assert quantiles.exact_quantiles(df, "v", [0.1, 0.5], ["g"]).first().q == [100.0, 500.0]


def test_bootstrap_does_not_depend_on_partitions(spark):
    draw = np.random.default_rng(2)
    rows = [(float(x), True) for x in draw.normal(1, 1, 200).round(1)] + [(float(x), False) for x in draw.normal(0, 1, 250).round(1)]
    df = spark.createDataFrame(rows, "s double, y boolean")
    found = []
    for n in ("2", "8"):
        spark.conf.set("spark.sql.shuffle.partitions", n)
        found.append(resample.bootstrap_auroc(df.repartition(int(n)), "s", "y", n_boot=200, seed=5).first())
        found.append(resample.cluster_bootstrap(df.repartition(int(n)).withColumn("one", F.lit(1.0)), "s", ["one"], lambda t: t["one"], n_boot=50, seed=5).first())
    spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert found[0] == found[2] and found[1] == found[3]
    assert resample.bootstrap_auroc(df, "s", "y", n_boot=200, seed=6).first() != found[0]


def test_bootstrap_replicates_are_the_weighted_auroc(spark):
    rows = [(1.0, 1), (2.0, 0), (2.0, 1), (3.0, 1), (0.5, 0), (0.5, 0)]
    df = spark.createDataFrame(rows, "s double, y int")
    counts = df.groupBy("s").agg(F.sum("y").alias("p"), F.sum(1 - F.col("y")).alias("n")).select("s", "p", "n", *[F.xxhash64(F.lit(9), "s", F.lit(k)).alias(f"k{k}") for k in (1, 0)]).orderBy("s").toPandas()
    p, n = (resample.poisson_weights(counts[f"k{k}"].to_numpy(), counts[c].to_numpy(), 40) for k, c in ((1, "p"), (0, "n")))
    values = [sum(p[i, r] * n[j, r] * (1.0 if i > j else 0.5 if i == j else 0.0) for i in range(len(counts)) for j in range(len(counts))) / max(p[:, r].sum() * n[:, r].sum(), 1e-300) for r in range(40)]
    both = [v for r, v in enumerate(values) if p[:, r].sum() and n[:, r].sum()]
    found = resample.bootstrap_auroc(df, "s", "y", n_boot=40, seed=9).first()
    assert found.n_replicates == len(both) and found.mean == pytest.approx(np.mean(both)) and found.low == pytest.approx(np.quantile(both, 0.025))


def test_bootstrap_of_two_normals(spark):
    """N(5, 3) against N(-2, 3) has an AUROC of Phi(7 / (3 sqrt 2))."""
    draw = np.random.default_rng(0)
    rows = [(float(x), True) for x in draw.normal(5, 3, 2000)] + [(float(x), False) for x in draw.normal(-2, 3, 2000)]
    found = resample.bootstrap_auroc(spark.createDataFrame(rows, "s double, y boolean"), "s", "y", n_boot=1000).first()
    truth = 0.5 * (1 + math.erf(7 / 6))
    assert found.n_replicates == 1000 and found.mean == pytest.approx(truth, abs=0.02) and found.low < truth < found.high


def test_cluster_bootstrap_and_paired_difference(spark):
    draw = np.random.default_rng(4)
    rows = [(f"c{i % 40}", float(v), float(v) + 0.1, float(v) + 0.3) for i, v in enumerate(draw.normal(size=800))]
    df = spark.createDataFrame(rows, "c string, truth double, near double, far double")
    found = resample.paired_delta(df, "c", "truth", "near", "far", n_boot=300, seed=1).first()
    assert found.low == pytest.approx(-0.08) and found.high == pytest.approx(-0.08)
    mean = resample.cluster_bootstrap(df.withColumn("one", F.lit(1.0)), "c", ["truth", "one"], lambda t: t["truth"] / t["one"], n_boot=500).first()
    assert mean.low < float(df.agg(F.avg("truth")).first()[0]) < mean.high


def test_null_keys_stay(spark):
    df = spark.createDataFrame([(None, 2.0), (None, 1.0), ("a", 3.0), ("a", 3.0), ("a", 4.0), (None, None)], "k string, v double")
    assert sorted(dedup.keep_least(df, ["k"], "v").collect(), key=str) == sorted([("a", 3.0), ("a", 3.0), (None, 1.0), (None, None)], key=str)
    assert len(dedup.duplicate_members(df, ["k"]).collect()) == 6


def test_missing_sources_are_violations(spark):
    df = spark.createDataFrame([("a", 1.0), ("b", 2.0), (None, 3.0), ("c", None)], "k string, v double")
    right = spark.createDataFrame([("a", 1.0), (None, 3.0), ("c", 1.0)], "k string, v double")
    found = quality.expect_close(df, "close", right, ["k"], "v").first()
    assert (found.violations, found.holds) == (2, False)


def test_totals_columns_and_gate(spark, tmp_path):
    df = spark.createDataFrame([("a", 1), ("b", 2)], "k string, v int")
    good = quality.expect_total(df, "tie", F.sum("v"), df, F.sum("v"))
    bad = quality.expect_total(df, "loose", F.sum("v"), df.where("v = 1"), F.count("v"))
    assert good.first().holds and not bad.first().holds and not quality.expect_total(df, "none", F.sum("v"), df.where("false"), F.sum("v")).first().holds
    twice = df.select("k", F.col("v").alias("K"), "v")
    assert quality.expect_columns_once(twice, "once").first().violations == 1 and quality.expect_columns_once(df, "once").first().holds
    quality.write_if(good, df, str(tmp_path / "good"))
    with pytest.raises(ValueError):
        quality.write_if(quality.report(good, bad), df, str(tmp_path / "bad"))
    assert spark.read.parquet(str(tmp_path / "good")).count() == 2 and not (tmp_path / "bad").exists()


def test_csv_headers_go_by_place(spark, tmp_path):
    for name in ("1.csv", "2.csv"):
        (tmp_path / name).write_text("Group,,Other\na,b,c\nx,1,2\na,b,c\nGroup,,Other\n,,\n")
    df = text.read_csv(spark, str(tmp_path), header_rows=(0, 1), types={"Group | b": "int"})
    assert df.columns == ["Group | a", "Group | b", "Other | c"] and dict(df.dtypes)["Group | b"] == "int"
    assert sorted(map(tuple, df.collect()), key=str) == sorted([("x", 1, "2"), ("a", None, "c"), ("Group", None, "Other")] * 2 + ([] if df.count() == 6 else [(None, None, None)] * 2), key=str)
    (tmp_path / "one").mkdir()
    (tmp_path / "one/a.csv").write_text("a,b\na,b\n1,2\n")
    assert sorted(map(tuple, text.read_csv(spark, str(tmp_path / "one")).collect())) == [("1", "2"), ("a", "b")]
    (tmp_path / "low").mkdir()
    for name in ("a.csv", "b.csv"):
        (tmp_path / f"low/{name}").write_text("note,\n# remark\na,b\n" + "".join(f"{i},a\n" for i in range(3)) + "a,b\n")
    low = text.read_csv(spark, str(tmp_path / "low"), header_rows=(1,), comment="#")
    assert low.columns == ["a", "b"] and sorted(r.a for r in low.collect()) == sorted(["0", "1", "2", "a"] * 2)


def test_csv_of_many_blocks(spark, tmp_path):
    (tmp_path / "big.csv").write_text("top,\na,b\n" + "".join(f"{i},v\n" for i in range(20_000)))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "16384")
    found = text.read_csv(spark, str(tmp_path / "big.csv"), header_rows=(1,))
    assert found.rdd.getNumPartitions() >= 1 and found.agg(F.count("a"), F.sum(F.col("a").cast("long"))).first() == (20_000, 199_990_000)
    spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_top_and_other(spark):
    df = spark.createDataFrame([("a", 5), ("b", 9), ("c", 5), (None, 1), ("d", 2)], "k string, n long")
    assert {tuple(r) for r in summaries.top_and_other(df, "k", "n", 2).collect()} == {("b", 9), ("a", 5), ("Other", 8)}
    assert {tuple(r) for r in summaries.top_and_other(df, "k", "n", 9).collect()} == {("a", 5), ("b", 9), ("c", 5), (None, 1), ("d", 2)}


def test_suffixed_names_and_column_order(spark):
    rows = [("A*02:01:01", "G" * 181), ("A*02:01:02", "G" * 180), ("A*02:01:03N", "G" * 181), ("A*02:05", "G" * 99), ("A*02:05:07", "G" * 263), ("B*07", "G"), ("nostar", "G"), (None, "G")]
    found = dedup.drop_suffixed(spark.createDataFrame(rows, "allele string, sequence string"), "allele", "sequence")
    assert sorted((r.allele, r.allele_name) for r in found.collect()) == [("A*02:01:01", "A*02:01"), ("A*02:05", "A*02:05"), ("A*02:05:07", "A*02:05"), ("B*07", "B*07")]
    df = spark.createDataFrame([(1, 2, 3)], "x int, y int, z int")
    assert summaries.ordered_columns(df, ["z", "none", "x"]).columns == ["z", "x", "y"]

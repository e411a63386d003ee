"""Kept stages, keep-last tables of streams, density on a grid."""

from __future__ import annotations

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from assaylane import staging
from assaylane.operators import density
from assaylane.streaming.merge import KeepLastTable

SCHEMA = "tag string, no long, v string"


def test_density_equals_the_direct_sum(spark):
    draw = np.random.default_rng(1)
    points = draw.multivariate_normal([1, -2], [[2.0, 1.1], [1.1, 1.5]], 400)
    df = spark.createDataFrame([*map(tuple, points.tolist()), (None, 1.0), (1.0, None)], "a double, b double").repartition(3)
    found = density.gaussian_density(df, "a", "b", (-2.0, 4.0), (-5.0, 1.0), points=25).toPandas()
    cov = np.cov(points.T) * len(points) ** (-1 / 3)
    inverse = np.linalg.inv(cov)
    for r in found.sample(80, random_state=1).itertuples():
        d = points - np.array([r.x, r.y])
        direct = np.exp(-0.5 * np.einsum("ni,ij,nj->n", d, inverse, d)).sum() / (2 * np.pi * np.sqrt(np.linalg.det(cov)) * len(points))
        assert r.density == pytest.approx(direct, abs=1e-3 * found["density"].max())
    assert len(found) == 625 and found["x"].min() == pytest.approx(-2) and found["y"].max() == pytest.approx(1)


def test_density_of_too_little(spark):
    df = spark.createDataFrame([(1.0, 1.0)], "a double, b double")
    assert density.gaussian_density(df, "a", "b", (0, 1), (0, 1)).collect() == []
    line = spark.createDataFrame([(float(i), 2.0 * i) for i in range(9)], "a double, b double")
    assert density.gaussian_density(line, "a", "b", (0, 1), (0, 1)).collect() == []


def test_stage_is_read_again_until_its_input_changes(spark, tmp_path):
    source, stage = str(tmp_path / "in"), str(tmp_path / "stage")
    spark.range(10).write.parquet(source)
    build = lambda k=2: spark.read.parquet(source).select((F.col("id") * k).alias("x"))
    run = lambda df: sorted(r.x for r in staging.staged(df, stage, [source]).collect())
    assert run(build()) == [2 * i for i in range(10)] and run(build()) == run(build())
    assert staging.manifests(spark, stage).count() == 1 and staging.manifests(spark, stage).first().n_rows == 10
    assert run(build(3)) == [3 * i for i in range(10)] and staging.manifests(spark, stage).count() == 2
    spark.range(10, 12).write.mode("append").parquet(source)
    assert run(build()) == [2 * i for i in range(12)] and staging.manifests(spark, stage).count() == 3


def test_half_written_stage_is_ignored(spark, tmp_path):
    source, stage = str(tmp_path / "in"), str(tmp_path / "stage")
    spark.range(3).write.parquet(source)
    broken = spark.read.parquet(source).select(F.when(F.col("id") == 2, F.raise_error(F.lit("stop")).cast("long")).otherwise(F.col("id")).alias("x"))
    with pytest.raises(Exception, match="stop"):
        staging.staged(broken, stage, [source])
    assert staging.manifests(spark, stage).count() == 0
    assert staging.staged(spark.read.parquet(source), stage, [source]).count() == 3


def last_of(rows):
    best = {}
    for tag, no, v in rows:
        if tag not in best or (no is not None, no or 0, v) > best[tag]:
            best[tag] = (no is not None, no or 0, v)
    return sorted(((k, no if there else None, v) for k, (there, no, v) in best.items()), key=str)


def table_of(spark, tmp_path):
    return KeepLastTable(spark, str(tmp_path / "kept"), spark.createDataFrame([], SCHEMA).schema, ["tag"], "no", buckets=4)


def test_batches_merge_once(spark, tmp_path):
    draw, table, seen = random.Random(3), table_of(spark, tmp_path), []
    assert table.read().collect() == []
    for batch in range(4):
        rows = [(draw.choice(["a", "b", "c", None, "e"]), draw.randint(0, 30), str(draw.random())) for _ in range(7)]
        seen += rows
        for _ in range(1 + batch % 2):  # some batches come twice
            table.merge(spark.createDataFrame(rows, SCHEMA), batch)
        assert sorted(map(tuple, table.read().collect()), key=str) == last_of(seen)
    table.merge(spark.createDataFrame([], SCHEMA), 9)
    assert sorted(map(tuple, table.read().collect()), key=str) == last_of(seen)


def test_uncommitted_data_are_not_read(spark, tmp_path, monkeypatch):
    table = table_of(spark, tmp_path)
    table.merge(spark.createDataFrame([("a", 1, "x")], SCHEMA), 0)
    before = table.read().collect()
    make = spark.createDataFrame
    monkeypatch.setattr(spark, "createDataFrame", lambda data, schema=None: (_ for _ in ()).throw(RuntimeError("lost")) if schema == table._commit else make(data, schema))
    with pytest.raises(RuntimeError):
        table.merge(make([("a", 5, "y"), ("b", 1, "z")], SCHEMA), 1)
    monkeypatch.undo()
    assert table.read().collect() == before
    table.merge(make([("a", 5, "y"), ("b", 1, "z")], SCHEMA), 1)
    assert sorted(map(tuple, table.read().collect())) == [("a", 5, "y"), ("b", 1, "z")]


def test_stream_restarts(spark, tmp_path):
    table, source = table_of(spark, tmp_path), str(tmp_path / "in")
    rows = [("a", 1, "x"), ("b", 2, "y"), ("a", 3, "z")]
    for i, part in enumerate((rows[:2], rows[2:])):
        spark.createDataFrame(part, SCHEMA).coalesce(1).write.mode("append").json(source)
        table.start(spark.readStream.schema(SCHEMA).json(source), str(tmp_path / "ck"))
        assert sorted(map(tuple, table.read().collect())) == last_of(rows[: 2 + i])

"""Distances of all pairs in tiles against plain pairs."""

from __future__ import annotations

import numpy as np
import pytest

from assaylane.operators import pairs


@pytest.mark.parametrize("tile", [2048, 3])
def test_pair_distances(spark, monkeypatch, tile):
    monkeypatch.setattr(pairs, "TILE", tile)
    draw = np.random.default_rng(1)
    vectors = [[float(x) for x in draw.normal(1000, 1, 6)] for _ in range(22)]
    rows = [(i, v, "a" if i < 13 else "b") for i, v in enumerate(vectors)]
    rows += [(30, vectors[0], "a"), (31, vectors[0], "a"), (32, None, "a"), (40, vectors[1], "alone"), (41, vectors[1], None), (42, vectors[2], "none"), (43, None, "none")]
    df = spark.createDataFrame(rows, "id long, v array<double>, g string").repartition(3)
    found = {r.g: r for r in pairs.pair_distances(df, "g", "id", "v").collect()}
    assert set(found) == {"a", "b", "none"} and found["none"].n_pairs == 1 and found["none"].median_r is None
    for g in "ab":
        mine = [np.array(v) for _, v, h in rows if h == g and v]
        r = [np.sqrt(((x - y) ** 2).mean()) for k, x in enumerate(mine) for y in mine[k + 1 :]]
        assert found[g].n_pairs == len(r) + (15 if g == "a" else 0)
        assert np.allclose([found[g].median_r, found[g].mean_r, found[g].least, found[g].most], [np.median(r), np.mean(r), min(r), max(r)], atol=1e-12)


def test_pairs_are_not_rows(spark, sf_dir):
    """Pairs of members never stand as rows of a join on the group alone."""
    from assaylane.plans import catalogue

    for name in ("pair_rmsd_within_group", "ref_rmsd_ratio"):
        plan = catalogue.QUERIES[name](spark, sf_dir)._jdf.queryExecution().optimizedPlan().toString()
        assert "embedding_i" not in plan and "vec_id_i" not in plan

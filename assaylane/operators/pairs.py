"""Distances of all pairs of a group's members, in bounded memory.

The work is quadratic in a group by nature. Members are dealt into tiles, and a pair of tiles is one product of matrices.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..storage import cut
from .ordered import cumulate

#: Members of a tile, and pairs that are computed anew at once.
TILE, ANEW = 2048, 1 << 16
#: Bits of a distance that a step of the counts leaves out: 4,096 steps between a number and its double.
STEP_BITS = 40


def unit_distances(unit: pd.DataFrame) -> tuple[int, np.ndarray]:
    """The pairs i < j between two tiles (or within one), and the distances of those with both vectors."""
    unit = unit.sort_values("i", kind="stable")
    within = unit["a"].iloc[0] == unit["b"].iloc[0]
    p, q = (unit, unit) if within else (unit[unit["first"]], unit[~unit["first"]])
    smaller = np.searchsorted(p["i"].to_numpy(), q["i"].to_numpy())
    pairs = int(smaller.sum()) if within else len(p) * len(q)
    p, q = p[p["v"].notna()], q[q["v"].notna()]
    if not len(p) or not len(q):
        return pairs, np.zeros(0)
    x, y = np.stack(p["v"].to_numpy()), np.stack(q["v"].to_numpy())
    sizes = (x * x).sum(axis=1)[:, None] + (y * y).sum(axis=1)
    square = sizes - 2 * (x @ y.T)
    i, j = np.nonzero(~(square >= 1e-4 * sizes))  # a small difference of large numbers says little
    for at in range(0, len(i), ANEW):
        r, c = i[at : at + ANEW], j[at : at + ANEW]
        square[r, c] = ((x[r] - y[c]) ** 2).sum(axis=1)
    if within:
        square = square[p["i"].to_numpy()[:, None] < q["i"].to_numpy()]
    return pairs, np.sqrt(square.ravel() / x.shape[1])


def steps(distances: np.ndarray) -> np.ndarray:
    """Numbers of the steps in which distances lie: the first bits of a double, which rise with it."""
    return distances.view(np.int64) >> STEP_BITS


def pair_distances(df: DataFrame, group: str, index: str, vector: str) -> DataFrame:
    """group, n_pairs, median_r, mean_r, least and most of the root mean square differences of all pairs of members with index i < j.

    Exact. One pass counts distances by steps, another hands on only those in the steps where a group's middle ranks lie. A group's vectors have one
    length; pairs with a missing vector or element count in n_pairs alone. Rows without a group or index have no pairs.
    """
    whole = F.when(~F.exists(vector, lambda x: x.isNull()), F.col(vector).cast("array<double>"))
    rows = df.where(F.col(group).isNotNull() & F.col(index).isNotNull()).select(F.col(group).alias("g"), F.col(index).alias("i"), whole.alias("v"))
    tiles = cut(rows.groupBy("g").agg(F.ceil(F.count(F.lit(1)) / TILE).cast("int").alias("tiles")))
    dealt = cut(rows.join(tiles, "g").withColumn("tile", F.pmod(F.xxhash64("i"), F.col("tiles")).cast("int")))
    met = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1))).select("g", F.least("tile", "other").alias("a"), F.greatest("tile", "other").alias("b"), (F.col("tile") <= F.col("other")).alias("first"), "i", "v")
    units = min(int(tiles.agg(F.sum(F.expr("tiles * (tiles + 1L) div 2"))).first()[0] or 1), 4096)
    kind = df.schema[group].dataType.simpleString()

    def count(unit: pd.DataFrame) -> pd.DataFrame:
        pairs, r = unit_distances(unit)
        found, n = np.unique(steps(r), return_counts=True)
        out = pd.DataFrame({"step": [-1, *found], "n": [pairs, *n]}, dtype="int64")
        whole = (r.sum(), r.min(), r.max()) if len(r) else (None, None, None)
        return out.assign(g=unit["g"].iloc[0], total=[whole[0], *[None] * len(found)], least=[whole[1], *[None] * len(found)], most=[whole[2], *[None] * len(found)])[["g", "step", "n", "total", "least", "most"]]

    counted = cut(met.repartition(units, "g", "a", "b").groupBy("g", "a", "b").applyInPandas(count, f"g {kind}, step long, n long, total double, least double, most double"))
    summed = counted.where("step = -1").groupBy("g").agg(F.sum("n").alias("n_pairs"), F.sum("total").alias("total"), F.min("least").alias("least"), F.max("most").alias("most")).where("n_pairs > 0")
    by_step = cut(counted.where("step >= 0").groupBy("g", "step").agg(F.sum("n").alias("n")))
    sizes = by_step.groupBy("g").agg(F.sum("n").alias("known"))
    middle = F.expr("(known - 1) div 2"), F.expr("known div 2")
    run = cumulate(by_step, ["g"], "step", ["n"]).join(sizes, "g")
    at = lambda k: (F.col("n_before") <= k) & (k < F.col("n_before") + F.col("n"))
    wanted = cut(run.where(at(middle[0]) | at(middle[1])).groupBy("g", "known").agg(F.min("step").alias("low"), F.max("step").alias("high"), F.min("n_before").alias("below")))

    def middle_ones(unit: pd.DataFrame) -> pd.DataFrame:
        _, r = unit_distances(unit)
        r = r[(steps(r) >= unit["low"].iloc[0]) & (steps(r) <= unit["high"].iloc[0])]
        values, n = np.unique(r, return_counts=True)
        return pd.DataFrame({"g": unit["g"].iloc[0], "r": values, "n": n})

    inside = met.join(wanted.select("g", "low", "high"), "g").repartition(units, "g", "a", "b").groupBy("g", "a", "b").applyInPandas(middle_ones, f"g {kind}, r double, n long")
    run = cumulate(inside.groupBy("g", "r").agg(F.sum("n").alias("n")), ["g"], "r", ["n"]).join(wanted, "g")
    hit = lambda k: F.max(F.when(at(k - F.col("below")), F.col("r")))
    medians = run.groupBy("g", "known").agg(((hit(middle[0]) + hit(middle[1])) / 2).alias("median_r"))
    return summed.join(medians, "g", "left").select(F.col("g").alias(group), "n_pairs", "median_r", (F.col("total") / F.col("known")).alias("mean_r"), "least", "most")

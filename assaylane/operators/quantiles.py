"""Exact quantiles of many groups by selection: only the values near the wanted ranks are ever sorted."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..storage import cut
from .ordered import cumulate

#: Groups up to this number are broadcast with their brackets.
BROADCAST_GROUPS = 10_000


def _same(by: Sequence[str], left: str = "", right: str = "_b_"):
    out = F.lit(True)
    for b in by:
        out = out & F.col(f"{left}{b}").eqNullSafe(F.col(f"{right}{b}"))
    return out


def _near(rows: DataFrame, brackets: DataFrame, by: Sequence[str], wanted: int) -> DataFrame:
    """Values at the wanted ranks (i, lower, upper) of each group, NULL where they lie outside the bracket.

    One scan counts what lies below each bracket, another counts the different values inside; these are summed in ranges.
    """
    n_groups = brackets.count()
    side = brackets.withColumnsRenamed({b: f"_b_{b}" for b in by})
    met = rows.join(F.broadcast(side) if n_groups <= BROADCAST_GROUPS else side, _same(by))
    v = F.col("_v")
    below = met.groupBy(*by).agg(F.array(*[F.count_if(v < F.get("_low", F.lit(i))) for i in range(wanted)]).alias("_below"))
    inside = F.filter(F.sequence(F.lit(0), F.lit(wanted - 1)), lambda i: v.between(F.get("_low", i), F.get("_high", i)))
    counted = met.select(*by, "_v", F.explode(inside).alias("_i")).groupBy(*by, "_i", "_v").agg(F.count(F.lit(1)).alias("_c"))
    run = cumulate(counted, [*by, "_i"], "_v", ["_c"]).select(*[F.col(b).alias(f"_r_{b}") for b in by], F.col("_i").alias("_ri"), "_v", "_c", "_c_before")
    placed = brackets.join(below.withColumnsRenamed({b: f"_b_{b}" for b in by}), _same(by), "left").drop(*[f"_b_{b}" for b in by])
    asked = placed.select(*by, F.posexplode(F.arrays_zip(F.col("_rank").alias("rank"), F.col("_below").alias("below"))).alias("_i", "_w")).select(*by, "_i", (F.floor("_w.rank") - F.col("_w.below")).alias("_k"), (F.col("_w.rank") - F.floor("_w.rank")).alias("_part"))
    hit = lambda k: F.max(F.when((F.col("_c_before") <= k) & (k < F.col("_c_before") + F.col("_c")), F.col("_v")))
    found = asked.join(run, _same(by, "", "_r_") & (F.col("_i") == F.col("_ri")), "left")
    return found.groupBy(*by, "_i").agg(hit(F.col("_k")).alias("lower"), hit(F.col("_k") + 1).alias("upper"), F.first("_part").alias("part"))


def exact_quantiles(df: DataFrame, value: str, quantiles: Sequence[float], by: Sequence[str] = (), *, accuracy: int = 1000) -> DataFrame:
    """by, n and q (an array, in the order of ``quantiles``) for each group, interpolated between neighbouring ranks.

    A sketch brackets each wanted rank within some n / ``accuracy`` rows; values inside the bracket are counted exactly and summed in
    ranges of values, so a group with all rows stays split. Should a bracket miss, its group is counted whole. Rows without a
    value count nowhere; a NULL key is a group; a group without values has no row, and no group gives no rows. ``df`` is read some times, so
    values that may differ between readings (sums in no fixed order) are to be written before.
    """
    rows = df.where(F.col(value).isNotNull()).select(*by, F.col(value).cast("double").alias("_v"))
    reach = 2.0 / accuracy
    at = lambda shift: F.percentile_approx("_v", F.array(*[F.lit(min(1.0, max(0.0, q + shift))) for q in quantiles]), accuracy)
    least = lambda c, edge, inner: F.array(*[edge if inner(q) else F.get(c, F.lit(i)) for i, q in enumerate(quantiles)])
    sketch = rows.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.min("_v").alias("_min"), F.max("_v").alias("_max"), at(-reach).alias("_l"), at(reach).alias("_h")).where("n > 0")
    ranks = F.array(*[(F.col("n") - 1) * F.lit(float(q)) for q in quantiles]).alias("_rank")
    low = least(F.col("_l"), F.col("_min"), lambda q: q - reach <= 0).alias("_low")
    high = least(F.col("_h"), F.col("_max"), lambda q: q + reach >= 1).alias("_high")
    brackets = cut(sketch.select(*by, "n", "_min", "_max", ranks, low, high))
    found = cut(_near(rows, brackets.select(*by, "_rank", "_low", "_high"), by, len(quantiles)))
    missed = found.where(F.col("lower").isNull() | ((F.col("part") > 0) & F.col("upper").isNull()))
    if not missed.isEmpty():
        groups = cut(missed.select(*[F.col(b).alias(f"_b_{b}") for b in by], F.lit(1).alias("_one")).distinct())
        whole = brackets.join(groups, _same(by), "left_semi")
        all_of = lambda x: F.array_repeat(F.lit(float(x)), len(quantiles))  # noqa: E731  NaN is over all other numbers
        again = cut(_near(rows, whole.select(*by, "_rank", all_of("-inf").alias("_low"), all_of("nan").alias("_high")), by, len(quantiles)))
        found = found.join(groups, _same(by), "left_anti").unionByName(again)
    value_at = F.when(F.col("part") > 0, F.col("lower") + (F.col("upper") - F.col("lower")) * F.col("part")).otherwise(F.col("lower"))
    listed = found.groupBy(*by).agg(F.transform(F.sort_array(F.collect_list(F.struct("_i", value_at.alias("q")))), lambda x: x["q"]).alias("q"))
    return brackets.select(*[F.col(b).alias(f"_b_{b}") for b in by], "n").join(listed, _same(by)).select(*by, "n", "q")

"""Running sums and ranks over a sort order, without gathering a group in one task."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..storage import cut


def cumulate(counted: DataFrame, by: Sequence[str], value: str, sums: Sequence[str], *, descending: bool = False) -> DataFrame:
    """``counted`` (one row for each ``by`` and ``value``) with ``{s}_before`` for each of ``sums``: its sum over smaller values of the group.

    Rows are dealt into ranges of (group, value), summed within each range, and offset by the totals of the ranges
    before: a table with a row for each range. A group of any size is thereby spread over many tasks.
    """
    order = [F.col(b).asc_nulls_first() for b in by] + [F.col(value).desc() if descending else F.col(value).asc()]
    ranged = cut(counted.repartitionByRange(*order).withColumn("_range", F.spark_partition_id()))
    totals = ranged.groupBy("_range").agg(*[F.sum(s).alias(f"_{s}_total") for s in sums])
    earlier = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select("_range", *[F.coalesce(F.sum(f"_{s}_total").over(earlier), F.lit(0)).alias(f"_{s}_offset") for s in sums])
    within = Window.partitionBy("_range").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    summed = ranged.select("*", *[F.coalesce(F.sum(s).over(within), F.lit(0)).alias(f"_{s}_within") for s in sums])
    run = summed.join(F.broadcast(offsets), "_range").select(*counted.columns, *[(F.col(f"_{s}_within") + F.col(f"_{s}_offset")).alias(f"{s}_before") for s in sums])
    if not by:
        return run
    starts = run.groupBy(*by).agg(*[F.min(f"{s}_before").alias(f"_{s}_start") for s in sums]).select(*[F.col(b).alias(f"_by_{b}") for b in by], *[f"_{s}_start" for s in sums])
    same = F.lit(True)
    for b in by:
        same = same & F.col(b).eqNullSafe(F.col(f"_by_{b}"))
    return run.join(starts, same).select(*counted.columns, *[(F.col(f"{s}_before") - F.col(f"_{s}_start")).alias(f"{s}_before") for s in sums])


def average_rank(df: DataFrame, value: str, by: Sequence[str] = (), *, out: str = "rank", count: str | None = None) -> DataFrame:
    """``df`` with the rank of ``value`` in its group, equal values sharing the mean of their ranks. Rows without a value go; a row counts ``count`` times."""
    counted = df.where(F.col(value).isNotNull()).groupBy(*by, value).agg((F.sum(count) if count else F.count(F.lit(1))).alias("_n"))
    ranked = cumulate(counted, by, value, ["_n"]).select(*[F.col(b).alias(f"_k_{b}") for b in by], F.col(value).alias("_v"), (F.col("_n_before") + (F.col("_n") + 1) / F.lit(2.0)).cast("double").alias(out))
    same = F.col(value) == F.col("_v")
    for b in by:
        same = same & F.col(b).eqNullSafe(F.col(f"_k_{b}"))
    return df.join(ranked, same).drop("_v", *[f"_k_{b}" for b in by])


def rank_column(value: Column | str, by: Sequence[str] = ()) -> Column:
    """The same rank as a window expression, for groups that are known to be small."""
    w = Window.partitionBy(*by)
    v = F.col(value) if isinstance(value, str) else value
    return (F.rank().over(w.orderBy(v)) + (F.count(v).over(Window.partitionBy(*by, v)) - 1) / F.lit(2.0)).cast("double")

"""Distinct rows with a stated winner, and rule-based resolution of repeated measurements.

Every operator takes a total order, because rows have none in Spark.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def keep_first(df: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """The first row of each key. A window with a rank filter: Spark drops the losers before the shuffle too."""
    return df.withColumn("_rn", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("_rn = 1").drop("_rn")


def union_override(first: DataFrame, second: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """Rows of both tables; for a key of both the row of ``second`` wins, and within a table the last by ``order``."""
    both = first.withColumn("_source", F.lit(1)).unionByName(second.withColumn("_source", F.lit(2)), allowMissingColumns=True)
    w = Window.partitionBy(*keys).orderBy(F.col("_source").desc(), *order)
    return both.withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn", "_source")


def keep_least(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """All rows that share the least value of their key; rows without a value stay, and a NULL key is a key."""
    least = df.groupBy(*keys).agg(F.min(value).alias("_least")).withColumnsRenamed({k: f"_k_{k}" for k in keys})
    same = F.lit(True)
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"_k_{k}"))
    return df.join(least, same).where(F.col(value).isNull() | (F.col(value) == F.col("_least"))).select(*df.columns)


def duplicate_census(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Key and count of all keys with more than one row."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_rows")).where("n_rows > 1")


def duplicate_members(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The rows of all keys with more than one row, with their number; NULL keys are keys."""
    repeated = duplicate_census(df, keys).withColumnsRenamed({k: f"_k_{k}" for k in keys})
    same = F.lit(True)
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"_k_{k}"))
    return df.join(repeated, same).select(*df.columns, "n_rows")


def drop_suffixed(df: DataFrame, name: str, sequence: str, *, letters: str = "NSCAQ", fields: int = 2, length: int = 181, out: str = "allele_name") -> DataFrame:
    """``df`` without names that have one of ``letters`` after their star, names cut to their first ``fields`` fields, and of those that
    are then equal the rows whose sequence is nearest in length to ``length`` (all of equally near ones). Names without a star have no such part and go.
    """
    after = F.get(F.split(name, r"\*"), F.lit(1))
    rows = df.where(after.isNotNull() & ~after.rlike(f"[{letters}]"))
    cut_name = F.array_join(F.slice(F.split(name, ":"), 1, fields), ":")
    placed = rows.withColumns({out: cut_name, "_away": F.abs(F.length(sequence) - length)})
    return keep_least(placed, [out], "_away").drop("_away")


def resolve_duplicates(df: DataFrame, keys: Sequence[str], value: str, has_source: str, order: Sequence[Column], *, tolerance: float = 10.0) -> DataFrame:
    """``df`` with ``verdict`` (keep, drop, flag) for each measurement of a key.

    One: keep. Two, one of them without a source: the other stays. Two without sources: the first stays if they differ by at
    most ``tolerance``, else both go. Two with sources: the second stays if they differ by less than ``tolerance``,
    else both are flagged. More: those without a source go; if two or fewer are left all of them stay, and else
    the one nearest to their median, the first of equals. A key's rows are repeats of one measurement, so they are few.
    """
    w = Window.partitionBy(*keys)
    src = F.coalesce(F.col(has_source), F.lit(False))
    base = df.withColumns({"_n": F.count(F.lit(1)).over(w), "_with": F.count_if(src).over(w), "_rn": F.row_number().over(w.orderBy(*order)), "_gap": F.max(value).over(w) - F.min(value).over(w)})
    medians = df.where(src).groupBy(*keys).agg(F.median(value).alias("_median"))
    same = F.lit(True)
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"_m_{k}"))
    placed = base.join(medians.select(*[F.col(k).alias(f"_m_{k}") for k in keys], "_median"), same, "left").drop(*[f"_m_{k}" for k in keys])
    nearest = F.row_number().over(Window.partitionBy(*keys, src).orderBy(F.abs(F.col(value) - F.col("_median")).asc_nulls_last(), *order))
    ranked = placed.withColumn("_near", nearest)
    n, k = F.col("_n"), F.col("_with")
    verdict = (
        F.when(n == 1, "keep")
        .when((n == 2) & (k == 1), F.when(src, "keep").otherwise("drop"))
        .when((n == 2) & (k == 0), F.when((F.col("_gap") <= tolerance) & (F.col("_rn") == 1), "keep").otherwise("drop"))
        .when(n == 2, F.when(F.col("_gap") >= tolerance, "flag").when(F.col("_rn") == 2, "keep").otherwise("drop"))
        .when(~src, "drop")
        .when((k <= 2) | (F.col("_near") == 1), "keep")
        .otherwise("drop")
    )
    return ranked.withColumn("verdict", verdict).drop("_n", "_with", "_rn", "_gap", "_median", "_near")

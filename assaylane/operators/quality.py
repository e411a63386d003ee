"""Data-quality expectations: each gives one row with its name, the rows that break it, and whether it holds."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _report(violations: DataFrame, name: str) -> DataFrame:
    return violations.agg(F.count(F.lit(1)).alias("violations")).select(F.lit(name).alias("expectation"), "violations", (F.col("violations") == 0).alias("holds"))


def expect(df: DataFrame, name: str, condition: Column) -> DataFrame:
    """The condition holds in every row; NULL breaks it."""
    return _report(df.where(~F.coalesce(condition, F.lit(False))), name)


def expect_equal(df: DataFrame, name: str, a: str, b: str, tolerance: float = 1e-6) -> DataFrame:
    """Two columns agree, or both are missing."""
    return expect(df, name, (F.col(a).isNull() & F.col(b).isNull()) | (F.abs(F.col(a) - F.col(b)) <= tolerance))


def expect_unique(df: DataFrame, name: str, keys: Sequence[str]) -> DataFrame:
    return _report(df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where("n > 1"), name)


def expect_members(df: DataFrame, name: str, keys: Sequence[str], expected: int) -> DataFrame:
    return _report(df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") != expected), name)


def expect_no_strays(df: DataFrame, name: str, right: DataFrame, keys: Sequence[str]) -> DataFrame:
    return _report(df.join(right, list(keys), "left_anti"), name)


def expect_monotone(funnel: DataFrame, name: str) -> DataFrame:
    return _report(funnel.where("removed < 0"), name)


def expect_close(df: DataFrame, name: str, right: DataFrame, keys: Sequence[str], value: str, tolerance: float = 1e-3) -> DataFrame:
    """A stored value equals its source's, key by key. A key without a source breaks it, as does a missing value; NULL keys are keys."""
    other = right.select(*[F.col(k).alias(f"_k_{k}") for k in keys], F.col(value).alias("_source"))
    same = F.lit(True)
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"_k_{k}"))
    return _report(df.join(other, same, "left").where(~F.coalesce(F.abs(F.col(value) - F.col("_source")) <= tolerance, F.lit(False))), name)


def expect_total(df: DataFrame, name: str, total: Column, right: DataFrame, right_total: Column, tolerance: float = 0.0) -> DataFrame:
    """A total over ``df`` ties to one over its source: one violation if they differ by more than ``tolerance``, or one is missing."""
    totals = df.agg(total.cast("double").alias("_t")).withColumn("_j", F.lit(1)).join(right.agg(right_total.cast("double").alias("_s")).withColumn("_j", F.lit(1)), "_j")
    return _report(totals.where(~F.coalesce(F.abs(F.col("_t") - F.col("_s")) <= tolerance, F.lit(False))), name)


def expect_columns_once(df: DataFrame, name: str) -> DataFrame:
    """No two columns have one name, capitals aside: a violation for each that repeats an earlier one."""
    seen, repeated = set(), 0
    for c in df.columns:
        repeated += c.lower() in seen
        seen.add(c.lower())
    return df.sparkSession.range(repeated).transform(lambda x: _report(x, name))


def write_if(report_: DataFrame, df: DataFrame, path: str) -> None:
    """Writes ``df`` as Parquet, unless an expectation of the report does not hold: then nothing is written."""
    require(report_)
    df.write.parquet(path)


def report(*expectations: DataFrame) -> DataFrame:
    out = expectations[0]
    for e in expectations[1:]:
        out = out.unionByName(e)
    return out


def require(report_: DataFrame) -> None:
    """Raises with the names of the expectations that don't hold."""
    broken = [r["expectation"] for r in report_.where("not holds").select("expectation").collect()]
    if broken:
        raise ValueError("broken expectations: " + ", ".join(broken))


def refuse_overwrite(source: str, target: str) -> None:
    if source.rstrip("/") == target.rstrip("/"):
        raise ValueError("the output would replace its own input")

"""Censoring predicates, tiers and text filters as columns. A missing value is never censored."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def no_nan(value: Column) -> Column:
    """NaN as NULL: Spark ranks NaN above every number, and a missing value must pass no threshold."""
    return F.when(~F.isnan(value), value)


def is_censored(value: Column, ceilings: Sequence[float], floor: float | None = None) -> Column:
    """Whether a value is one of the assay's ceilings or at least the floor; False for a missing value."""
    clean = no_nan(value.cast("double"))
    hit = clean.isin([float(c) for c in ceilings])
    return F.coalesce(hit | (clean >= floor) if floor is not None else hit, F.lit(False))


def not_flagged(flag: Column) -> Column:
    """A missing flag means not flagged."""
    return ~F.coalesce(flag, F.lit(False))


def any_prefix(text: Column, prefixes: Sequence[str]) -> Column:
    found = F.lit(False)
    for p in prefixes:
        found = found | text.startswith(p)
    return F.coalesce(found, F.lit(False))


def full_match(text: Column, pattern: str) -> Column:
    return F.coalesce(text.rlike(f"^(?:{pattern})$"), F.lit(False))


def in_open_interval(value: Column, low: float, high: float) -> Column:
    return (value > low) & (value < high)


def confidence_tier(identity: Column, rmsd: Column) -> Column:
    """Order matters: no template, then outliers by distance, then identity."""
    return F.when(identity.isNull(), "no_template").when(rmsd > 2, "outlier").when(identity >= 80, "high").when(identity <= 35, "low").otherwise("moderate")


def right_closed_bin(value: Column, edges: Sequence[float]) -> Column:
    """The number (from 0) of the interval (low, high] that holds the value; the lowest edge belongs to the first; NULL outside."""
    found = F.when((value >= edges[0]) & (value <= edges[1]), 0)
    for i, (low, high) in enumerate(zip(edges[1:], edges[2:], strict=False), start=1):
        found = found.when((value > low) & (value <= high), i)
    return found.cast("int")


def canonical_label(label: Column, mapping: Mapping[str, str], default: str | None = None) -> Column:
    """A label's canonical spelling; unknown ones stay, or become ``default``."""
    found = F.lit(None).cast("string")
    for old, new in mapping.items():
        found = F.when(label == old, F.lit(new)).otherwise(found)
    return F.coalesce(found, label if default is None else F.lit(default))

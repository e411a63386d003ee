"""Joins of measurements with templates, lookups, and similarity joins of short sequences."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.sequences import hamming, windows
from .dedup import keep_first


def attach(df: DataFrame, right: DataFrame, keys: Mapping[str, str] | Sequence[str], *, how: str = "left") -> DataFrame:
    """``df`` with the columns of ``right``, joined on keys that may have other names there; the right keys go."""
    pairs = keys if isinstance(keys, Mapping) else {k: k for k in keys}
    renamed = right.withColumnsRenamed({r: f"_r_{r}" for r in pairs.values()})
    condition = F.lit(True)
    for left, r in pairs.items():
        condition = condition & (F.col(left) == F.col(f"_r_{r}"))
    return df.join(renamed, condition, how).drop(*[f"_r_{r}" for r in pairs.values()])


def lookup(df: DataFrame, key: str, table: DataFrame, table_key: str, value: str, *, missing: str, empty: str, out: str) -> DataFrame:
    """``df`` with a looked-up label; ``missing`` if the key is not in the table, ``empty`` if it is there without a value."""
    one = keep_first(table.where(F.col(table_key).isNotNull()), [table_key], [F.col(value).asc_nulls_last()]).select(F.col(table_key).alias("_key"), F.col(value).alias("_value"))
    found = df.join(one, F.col(key) == F.col("_key"), "left")
    return found.withColumn(out, F.when(F.col("_key").isNull(), missing).otherwise(F.coalesce("_value", F.lit(empty)))).drop("_key", "_value")


def known(df: DataFrame, right: DataFrame, keys: Sequence[str]) -> DataFrame:
    return df.join(right, list(keys), "left_semi")


def orphans(df: DataFrame, right: DataFrame, keys: Sequence[str]) -> DataFrame:
    return df.join(right, list(keys), "left_anti")


def ambiguous_keys(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """Keys that would multiply rows in a join, because they have several values."""
    return df.groupBy(*keys).agg(F.count_distinct(value).alias("n_values")).where("n_values > 1")


def pairs_within(df: DataFrame, group: str, index: str, columns: Sequence[str]) -> DataFrame:
    """All pairs i < j of a group's members (an ensemble has a fixed number of them), columns suffixed _i and _j."""
    side = lambda s: df.select(F.col(group).alias(f"{group}{s}"), F.col(index).alias(f"{index}{s}"), *[F.col(c).alias(f"{c}{s}") for c in columns])
    i, j = side("_i"), side("_j")
    return i.join(j, (F.col(f"{group}_i") == F.col(f"{group}_j")) & (F.col(f"{index}_i") < F.col(f"{index}_j"))).withColumnRenamed(f"{group}_i", group).drop(f"{group}_j")


def _segments(sequence: Column, distance: int) -> Column:
    """Pairs of pieces, of distance + 2 into which the sequence is cut, with their numbers and the length: of two near sequences one pair is equal."""
    n, k = F.length(sequence), distance + 2
    cut = lambda i: F.floor(n * i / k).cast("int")
    piece = lambda i: F.substring(sequence, cut(i) + 1, cut(i + 1) - cut(i))
    return F.array(*[F.struct(F.lit(i).alias("first"), F.lit(j).alias("second"), n.alias("n"), piece(i).alias("a"), piece(j).alias("b")) for i in range(k) for j in range(i + 1, k)])


def hamming_candidates(df: DataFrame, sequence: str, *, distance: int = 2) -> DataFrame:
    """a < b of different sequences of one length that share two of distance + 2 pieces: no pair within the distance is missing."""
    keyed = df.where(F.col(sequence).isNotNull()).select(F.col(sequence).alias("s")).distinct().select("s", F.explode(_segments(F.col("s"), distance)).alias("k"))
    left, right = keyed.withColumnRenamed("s", "a"), keyed.withColumnsRenamed({"s": "b", "k": "k2"})
    return left.join(right, (F.col("k") == F.col("k2")) & (F.col("a") < F.col("b"))).select("a", "b").distinct()


def hamming_pairs(df: DataFrame, sequence: str, *, distance: int = 2) -> DataFrame:
    """a < b and distance of all pairs of different sequences of one length at most ``distance`` apart.

    By the pigeonhole principle such pairs share two of distance + 2 pieces: an equi-join on the length and two numbered pieces, each hit
    verified. Exact, without comparing all pairs; two pieces are longer together than one of distance + 1, so fewer pairs share them by chance.
    """
    met = hamming_candidates(df, sequence, distance=distance)
    return met.withColumn("distance", hamming(F.col("a"), F.col("b"))).where(F.col("distance") <= distance)


def substring_links(df: DataFrame, sequence: str) -> DataFrame:
    """short and long of all pairs of sequences of which one contains the other: windows of the longer, looked up by equality."""
    different = df.where((F.col(sequence).isNotNull()) & (F.length(sequence) > 0)).select(F.col(sequence).alias("s")).distinct()
    lengths = different.select(F.length("s").alias("n")).distinct().agg(F.collect_set("n").alias("lengths"))
    long = different.withColumn("_j", F.lit(1)).join(F.broadcast(lengths.withColumn("_j", F.lit(1))), "_j").select("s", F.explode(F.filter("lengths", lambda n: n < F.length("s"))).alias("n"))
    windowed = long.select(F.col("s").alias("long"), F.explode(F.array_distinct(windows(F.col("s"), F.col("n")))).alias("w"))
    return windowed.join(different.withColumnRenamed("s", "short"), F.col("w") == F.col("short")).select("short", "long")


def in_listed(df: DataFrame, item: str, lists: DataFrame, listed: str, out: str) -> DataFrame:
    """Joined with the rows of ``lists`` whose space-separated list has the item as a whole entry."""
    entries = lists.withColumn("_entry", F.explode(F.split(listed, " +"))).withColumnRenamed(listed, out)
    return df.join(entries, F.col(item) == F.col("_entry"), "left").drop("_entry")


def top_k_per(df: DataFrame, keys: Sequence[str], order: Sequence[Column], k: int, *, out: str = "rank") -> DataFrame:
    return df.withColumn(out, F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col(out) <= k)


def attach_members(scores: DataFrame, files: DataFrame, path: str, tag: str, *, strict: bool = True) -> DataFrame:
    """Score rows with the path of the file whose stem is their tag; strict: a row without a file is an error."""
    stems = files.select(F.regexp_extract(path, r"([^/]+?)(\.[^./]*)?$", 1).alias("_stem"), F.col(path).alias("member_path"))
    found = scores.join(stems, F.col(tag) == F.col("_stem"), "left" if strict else "inner").drop("_stem")
    if strict and not found.where("member_path is null").isEmpty():
        raise ValueError("scores without a file")
    return found

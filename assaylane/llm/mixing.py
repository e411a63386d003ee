"""Mixing sources to target weights by Poisson replication."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..storage import cut

#: Hexadecimal digits of an MD5 that make a uniform number: 52 bits, exact as a double.
DIGITS = 13


def uniform(*parts: Column) -> Column:
    """A number in [0, 1) from the MD5 of the parts joined by colons."""
    digest = F.md5(F.concat_ws(":", *parts))
    return F.conv(F.substring(digest, 1, DIGITS), 16, 10).cast("bigint").cast("double") / F.lit(2.0 ** (4 * DIGITS))


def replication_rates(docs: DataFrame, weights: DataFrame | None = None, *, alpha: float = 0.5, epochs: float = 1.0) -> DataFrame:
    """The mean number of copies for each source.

    A source's size is the characters of its texts. With ``weights`` (source, weight)
    a source's share of the output is its weight over the sum of weights of the
    sources present, and a source without a weight has rate 0. Without, the weight is
    ``size ** alpha``. The rate is ``epochs * share * total size / source size``; a
    source whose texts are all empty has rate ``epochs``. Null is a source like any other.

    Returns source, size, rate; one row per source.
    """
    sizes = cut(docs.groupBy("source").agg(F.sum(F.length(F.coalesce("text", F.lit("")))).cast("double").alias("size")))
    if weights is None:
        weighed = sizes.withColumn("weight", F.when(F.col("size") > 0, F.pow("size", F.lit(alpha))).otherwise(0.0))
    else:
        w = weights.select(F.col("source").alias("_source"), F.col("weight").cast("double").alias("_weight"))
        weighed = sizes.join(w, sizes["source"].eqNullSafe(w["_source"]), "left").select("source", "size", F.coalesce("_weight", F.lit(0.0)).alias("weight"))
    total, weight = weighed.agg(F.sum("size"), F.sum(F.when(F.col("size") > 0, F.col("weight")))).first()
    share = F.col("weight") * F.lit(float(total or 0.0)) / F.lit(float(weight or 1.0) or 1.0)
    return weighed.select("source", "size", F.when(F.col("size") > 0, F.lit(float(epochs)) * share / F.col("size")).otherwise(F.lit(float(epochs))).alias("rate"))


def poisson_table(rate: float) -> tuple[int, list[float]]:
    """The count that the distribution of mean ``rate`` begins with, and the bounds P(X <= count), count by count, to its far end.

    Counts beyond ten standard deviations and some are left out: together they have less than 2 ** -52. So a table has
    some ``20 * sqrt(rate)`` bounds.
    """
    if not rate > 0:
        return 0, []
    reach = 10 * math.sqrt(rate) + 30
    first = max(0, math.floor(rate - reach))
    counts = np.arange(first, math.ceil(rate + reach) + 1)
    logs = counts * math.log(rate) - rate - np.fromiter(map(math.lgamma, counts + 1.0), dtype=float, count=len(counts))
    return first, np.cumsum(np.exp(logs)).tolist()


def poisson_copies(docs: DataFrame, rates: DataFrame, *, seed: int = 17) -> DataFrame:
    """``_row`` (the row of ``docs``), ``_doc`` (its doc_id as text) and ``_copies``: the Poisson distribution of the source's rate, inverted at a number hashed from seed and doc_id.

    Tasks make a table of bounds for each source; a document then looks its number up.
    """

    def tables(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            made = [poisson_table(rate) for rate in batch["rate"]]
            yield pd.DataFrame({"_source": batch["source"], "_first": pd.array([m[0] for m in made], dtype="int32"), "_bounds": [m[1] for m in made]})

    kind = rates.schema["source"].dataType.simpleString()
    made = cut(rates.select("source", "rate").mapInPandas(tables, f"_source {kind}, _first int, _bounds array<double>"))
    doc = F.coalesce(F.col("doc_id").cast("string"), F.lit(""))
    # rows travel in a struct, so that their columns can have any name
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"), doc.alias("_doc"), F.col("source").alias("_from"))
    joined = rows.withColumn("_draw", uniform(F.lit(str(seed)), F.col("_doc"))).join(made, F.col("_from").eqNullSafe(F.col("_source")), "left")
    below = F.size(F.filter("_bounds", lambda bound: bound <= F.col("_draw")))
    copies = F.when(F.size("_bounds") > 0, F.col("_first") + below).otherwise(0)
    return joined.select("_row", "_doc", copies.alias("_copies"))


def mix_sources(docs: DataFrame, weights: DataFrame | None = None, *, alpha: float = 0.5, epochs: float = 1.0, seed: int = 17) -> DataFrame:
    """A global shuffle of ``docs`` in which sources have their target weights.

    Each document appears ``n_copies`` times, a Poisson number with the rate of its
    source (:func:`replication_rates`), drawn from a hash of seed and doc_id: a rerun
    or a lost executor gives the same copies. Adds ``copy`` (1, 2, ...) and
    ``shuffle_key`` (60 hashed bits), by which the output is sorted over all partitions.

    The rates are a table with a row per source. Spark broadcasts it if it is small
    enough, and otherwise splits a source that holds much of the rows.

    Null text: size 0. Null source: a source like any other. Null doc_id: drawn as
    if it were empty. Repeated rows: drawn alike, and each is kept as often. Empty
    table: empty result. Other columns pass through, but for those named copy or shuffle_key, which are replaced.
    """
    counted = poisson_copies(docs, replication_rates(docs, weights, alpha=alpha, epochs=epochs), seed=seed)
    copied = counted.where("_copies > 0").withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("_copies"))))
    key = F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(f"{seed}-order"), F.col("_doc"), F.col("copy").cast("string"))), 1, 15), 16, 10).cast("bigint")
    columns = [F.col("_row")[c].alias(c) for c in docs.columns if c not in ("copy", "shuffle_key")]
    return copied.select(*columns, "copy", key.alias("shuffle_key")).orderBy("shuffle_key", "doc_id", "copy")

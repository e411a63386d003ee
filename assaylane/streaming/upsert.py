"""Keep-last upserts of an append-only stream, an extension: the batch rule is "the last record of a tag wins"."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def latest(stream: DataFrame, keys: Sequence[str], order: str, values: Sequence[str]) -> DataFrame:
    """The values of the largest ``order`` of each key, kept up by Spark's streaming aggregation state."""
    best = F.max(F.struct(F.col(order), *[F.col(v) for v in values])).alias("_best")
    return stream.groupBy(*keys).agg(best).select(*keys, f"_best.{order}", *[f"_best.{v}" for v in values])


def start(stream: DataFrame, table: str, checkpoint: str) -> StreamingQuery:
    """Runs what has come so far into an in-memory table, and ends."""
    query = stream.writeStream.outputMode("complete").format("memory").queryName(table).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return query


def windowed_counts(stream: DataFrame, time: str, key: str, *, window: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Rows of each key and tumbling window, late ones up to ``late``."""
    return stream.withWatermark(time, late).groupBy(F.window(time, window), key).agg(F.count(F.lit(1)).alias("n")).select(F.col("window.start").alias("start"), key, "n")

"""Keep-last tables: micro-batches of a stream merged into a partitioned table, each once."""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery


@dataclass
class KeepLastTable:
    """The last row of each key, in buckets of keys, under ``path``.

    A batch rewrites only the buckets that it touches, into a folder with its number, and is then committed by a list of these buckets. A
    bucket is read from its last committed batch. A batch that is run again reads what was there before it and writes the same, so a
    restart in the middle changes nothing; what was written without a commit is never read.
    """

    spark: SparkSession
    path: str
    schema: T.StructType
    keys: Sequence[str]
    order: str
    buckets: int = 64
    _commit: str = field(default="batch long, buckets array<int>", init=False, repr=False)

    def _last(self, rows: DataFrame) -> DataFrame:
        """The row of the greatest ``order`` of each key; of equal ones the greatest by the other columns, whatever came first."""
        rest = [c for c in self.schema.names if c not in self.keys and c != self.order]
        best = F.max(F.struct(F.col(self.order).alias("_order"), *rest)).alias("_best")
        found = rows.groupBy(*self.keys).agg(best)
        return found.select(*[F.col("_best._order").alias(c) if c == self.order else F.col(f"_best.{c}") if c in rest else F.col(c) for c in self.schema.names])

    def read(self, before: int | None = None) -> DataFrame:
        """The table, or what it was before a batch."""
        try:
            commits = self.spark.read.schema(self._commit).parquet(f"{self.path}/commits")
        except AnalysisException as e:
            if e.getCondition() != "PATH_NOT_FOUND":
                raise
            return self.spark.createDataFrame([], self.schema)
        commits = commits if before is None else commits.where(F.col("batch") < before)
        latest = commits.select("batch", F.explode("buckets").alias("bucket")).groupBy("bucket").agg(F.max("batch").alias("batch")).collect()
        by_batch: dict[int, list[int]] = defaultdict(list)
        for r in latest:  # a row for each bucket
            by_batch[r["batch"]].append(r["bucket"])
        out = self.spark.createDataFrame([], self.schema)
        for batch, buckets in sorted(by_batch.items()):
            data = self.spark.read.schema(T.StructType([*self.schema.fields, T.StructField("_bucket", T.IntegerType())])).parquet(f"{self.path}/data/batch={batch}")
            out = out.unionByName(data.where(F.col("_bucket").isin(buckets)).drop("_bucket"))
        return out

    def merge(self, rows: DataFrame, batch: int) -> None:
        """Merges the rows of one batch. Rows with a NULL key are a key; a batch without rows commits nothing."""
        bucket = F.pmod(F.xxhash64(*self.keys), F.lit(self.buckets)).cast("int")
        new = self._last(rows.select(*self.schema.names))
        touched = sorted(r[0] for r in new.select(bucket.alias("b")).distinct().collect())
        if not touched:
            return
        merged = self._last(self.read(before=batch).where(bucket.isin(touched)).unionByName(new))
        merged.withColumn("_bucket", bucket).repartition("_bucket").write.mode("overwrite").partitionBy("_bucket").parquet(f"{self.path}/data/batch={batch}")
        self.spark.createDataFrame([(batch, touched)], self._commit).coalesce(1).write.mode("overwrite").parquet(f"{self.path}/commits/part={batch}")

    def start(self, stream: DataFrame, checkpoint: str) -> StreamingQuery:
        """Merges what has come so far, and ends."""
        query = stream.writeStream.foreachBatch(self.merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
        query.awaitTermination()
        return query

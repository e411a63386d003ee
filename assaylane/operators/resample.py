"""Bootstrap confidence intervals whose replicates are sums, so that none is ever gathered.

A row's weights in all replicates are one draw of Poisson numbers from a generator that is keyed by seed and row, so they don't
depend on partitions, batches or order. What a replicate needs is then summed where the rows are: an array over replicates for each
task or range of scores.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..storage import cut

#: Weights (rows times replicates) that a task holds at once.
HELD = 1 << 21


def _percentiles(found: DataFrame, alpha: float, n_boot: int) -> DataFrame:
    bounds = F.percentile("value", F.array(F.lit(alpha / 2), F.lit(1 - alpha / 2)))
    good = found.where(F.col("value").isNotNull() & ~F.isnan("value"))
    rows = good.agg(F.count(F.lit(1)).alias("n_replicates"), bounds.alias("_b"), F.avg("value").alias("mean"))
    enough = F.col("n_replicates") * 2 >= n_boot
    return rows.select("n_replicates", F.when(enough, F.get("_b", F.lit(0))).alias("low"), F.when(enough, F.get("_b", F.lit(1))).alias("high"), F.when(enough, F.col("mean")).alias("mean"))


def poisson_weights(keys: np.ndarray, counts: np.ndarray, n_boot: int) -> np.ndarray:
    """Weights of rows (down) in replicates (across): for a row that stands for ``counts`` equal ones the sum of their Poisson(1) draws."""
    out = np.empty((len(keys), n_boot), np.int64)
    for i, (key, n) in enumerate(zip(keys.astype(np.uint64).tolist(), counts.tolist(), strict=True)):
        out[i] = np.random.Generator(np.random.Philox(key=key)).poisson(n, n_boot)
    return out


def _pieces(batches: Iterable[pd.DataFrame], n_boot: int) -> Iterator[pd.DataFrame]:
    step = max(1, HELD // n_boot)
    for batch in batches:
        for start in range(0, len(batch), step):
            yield batch.iloc[start : start + step]


def _key(seed: int, *columns: Column | str) -> Column:
    return F.xxhash64(F.lit(seed), *columns).alias("key")


class _Sums:
    """Sums over replicates of one range of scores in rising order: positives, negatives, and twice the pairs in order, ties counting half.

    Rows of the last score wait until it is known that no more of them come, so that equal scores are ties wherever batches end.
    """

    def __init__(self, n_boot: int) -> None:
        self.pos, self.neg, self.twice, self.p, self.n = (np.zeros(n_boot, np.int64) for _ in range(5))
        self.at: float | None = None

    def add(self, scores: np.ndarray, p: np.ndarray, n: np.ndarray) -> None:
        starts = np.flatnonzero(np.append(True, np.diff(scores) != 0))
        p, n = np.add.reduceat(p, starts, axis=0), np.add.reduceat(n, starts, axis=0)
        if self.at == scores[0]:
            p[0] += self.p
            n[0] += self.n
        else:
            self.close()
        self.at, self.p, self.n = scores[-1], p[-1], n[-1]
        below = n[:-1].cumsum(axis=0) - n[:-1] + self.neg
        self.twice += (p[:-1] * (2 * below + n[:-1])).sum(axis=0)
        self.pos += p[:-1].sum(axis=0)
        self.neg += n[:-1].sum(axis=0)

    def close(self) -> None:
        self.twice += self.p * (2 * self.neg + self.n)
        self.pos += self.p
        self.neg += self.n
        self.p, self.n = np.zeros_like(self.p), np.zeros_like(self.n)


def auroc_replicates(df: DataFrame, score: str, label: str, *, n_boot: int = 1000, seed: int = 0, cluster: str | None = None) -> DataFrame:
    """replicate and value: the AUROC of each resample, NULL where a class is missing.

    Rows are resampled by independent Poisson(1) weights, the form of the bootstrap that needs no draw from the whole table; with ``cluster`` all rows
    of a cluster share one weight. Scores are sorted in ranges; a range gives each replicate's positives, negatives, and pairs in order
    within it, and a running sum over ranges adds the negatives below. All of these are whole numbers, so the values are the same
    whatever the partitions. Rows without score or label count nowhere.
    """
    rows = df.where(F.col(score).isNotNull() & F.col(label).isNotNull()).select(F.col(score).cast("double").alias("s"), F.col(label).cast("int").alias("y"), *([F.col(cluster).alias("c")] if cluster else []))
    counted = rows.groupBy("s", *(["c"] if cluster else [])).agg(F.sum("y").alias("pos"), F.sum(1 - F.col("y")).alias("neg"))
    keys = [F.xxhash64(F.lit(seed), "c"), F.xxhash64(F.lit(seed), "c")] if cluster else [F.xxhash64(F.lit(seed), "s", F.lit(1)), F.xxhash64(F.lit(seed), "s", F.lit(0))]
    keyed = counted.select("s", "pos", "neg", keys[0].alias("pos_key"), keys[1].alias("neg_key"))
    ranged = cut(keyed.repartitionByRange("s").withColumn("part", F.spark_partition_id()))

    def add(group: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums: dict[int, _Sums] = {}
        for piece in _pieces(group, n_boot):
            for part, mine in piece.groupby("part", sort=False):
                if cluster:
                    weights = poisson_weights(mine["pos_key"].to_numpy(), np.ones(len(mine)), n_boot)
                    p, n = (weights * mine[k].to_numpy()[:, None] for k in ("pos", "neg"))
                else:
                    p, n = (poisson_weights(mine[f"{k}_key"].to_numpy(), mine[k].to_numpy(), n_boot) for k in ("pos", "neg"))
                sums.setdefault(part, _Sums(n_boot)).add(mine["s"].to_numpy(), p, n)
        for part, found in sums.items():
            found.close()
            yield pd.DataFrame({"part": part, "replicate": np.arange(n_boot), "pos": found.pos, "neg": found.neg, "twice": found.twice})

    in_order = ranged.repartitionByRange("part").sortWithinPartitions("part", "s")
    totals = in_order.mapInPandas(add, "part int, replicate int, pos long, neg long, twice long")
    earlier = Window.partitionBy("replicate").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    placed = totals.withColumn("before", F.coalesce(F.sum("neg").over(earlier), F.lit(0)))
    whole = lambda c: F.sum(c.cast("decimal(38,0)")).cast("double")
    sums = placed.groupBy("replicate").agg(whole(F.col("twice") + 2 * F.col("pos") * F.col("before")).alias("twice"), whole(F.col("pos")).alias("pos"), whole(F.col("neg")).alias("neg"))
    return sums.select("replicate", F.try_divide(F.col("twice"), 2 * F.col("pos") * F.col("neg")).alias("value"))


def bootstrap_auroc(df: DataFrame, score: str, label: str, *, n_boot: int = 1000, alpha: float = 0.05, seed: int = 0, cluster: str | None = None) -> DataFrame:
    """Percentile interval of the AUROC over resamples (:func:`auroc_replicates`): one row; NULL if under half of them have both classes."""
    return _percentiles(auroc_replicates(df, score, label, n_boot=n_boot, seed=seed, cluster=cluster), alpha, n_boot)


def paired_auroc_delta(df: DataFrame, label: str, first: str, second: str, cluster: str, *, n_boot: int = 1000, alpha: float = 0.05, seed: int = 0) -> DataFrame:
    """Percentile interval of the difference of two scores' AUROCs, both on the same resamples of clusters, over rows that have both scores."""
    rows = df.where(F.col(first).isNotNull() & F.col(second).isNotNull())
    a, b = (auroc_replicates(rows, s, label, n_boot=n_boot, seed=seed, cluster=cluster).withColumnRenamed("value", v) for s, v in ((first, "a"), (second, "b")))
    return _percentiles(a.join(b, "replicate").select((F.col("a") - F.col("b")).alias("value")), alpha, n_boot)


def cluster_bootstrap(df: DataFrame, cluster: str, sums: Sequence[str], metric: Callable[[pd.DataFrame], pd.Series], *, n_boot: int = 1000, alpha: float = 0.05, seed: int = 0) -> DataFrame:
    """Percentile interval of a metric of column sums, whole clusters being resampled: one row.

    Clusters are first summed, then weighed by Poisson(1) draws keyed by seed and cluster; a task hands on one row of sums for each
    replicate. ``metric`` gets a row of sums for each replicate. Rows without a cluster are a cluster.
    """
    totals = df.groupBy(cluster).agg(*[F.sum(s).cast("double").alias(f"sum_{i}") for i, s in enumerate(sums)]).select(_key(seed, F.col(cluster)), *[F.coalesce(f"sum_{i}", F.lit(0.0)).alias(f"sum_{i}") for i in range(len(sums))])

    def draw(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        added = np.zeros((n_boot, len(sums)))
        for piece in _pieces(batches, n_boot):
            added += poisson_weights(piece["key"].to_numpy(), np.ones(len(piece)), n_boot).T @ piece.iloc[:, 1:].to_numpy(float)
        yield pd.DataFrame({"replicate": np.arange(n_boot), **{f"sum_{i}": added[:, i] for i in range(len(sums))}})

    schema = "replicate int, " + ", ".join(f"sum_{i} double" for i in range(len(sums)))
    added = cut(totals).mapInPandas(draw, schema).groupBy("replicate").agg(*[F.sum(f"sum_{i}").alias(f"sum_{i}") for i in range(len(sums))])

    def value(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame({"value": metric(batch.rename(columns={f"sum_{i}": s for i, s in enumerate(sums)})).astype(float)})

    return _percentiles(added.mapInPandas(value, "value double"), alpha, n_boot)


def paired_delta(df: DataFrame, cluster: str, truth: str, first: str, second: str, **options) -> DataFrame:
    """Interval of the difference of two predictions' mean squared errors, both on the same resamples of clusters."""
    errors = df.select(cluster, (F.pow(F.col(first) - F.col(truth), F.lit(2.0))).alias("e1"), (F.pow(F.col(second) - F.col(truth), F.lit(2.0))).alias("e2"), F.lit(1.0).alias("n"))
    return cluster_bootstrap(errors, cluster, ["e1", "e2", "n"], lambda t: (t["e1"] - t["e2"]) / t["n"], **options)

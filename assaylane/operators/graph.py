"""Connected components of a graph whose edges are rows, by DataFrame operations only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..storage import cut, discard


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v"))).first())


def _attach_least(edges: DataFrame, least: DataFrame) -> DataFrame:
    """``edges`` (u, v) with the least neighbour ``m`` of u; a u with many edges is split over tasks by the skew join."""
    return edges.join(least.withColumnRenamed("u", "_u"), edges["u"] == F.col("_u")).select("u", "v", "m")


def connected_components(edges: DataFrame) -> DataFrame:
    """node and root (the least node of its component) for every node of ``edges`` (columns a, b of one orderable type).

    Alternates large-star and small-star rounds until the edges are stars around the roots: every
    node hands its larger neighbours, then its smaller ones, to the least of them. A round
    joins the edges with one minimum for each node, so no neighbourhood is ever gathered in a task.
    Each round is written to the shared folder, where it takes the place of the one before. Self-loops keep a node with itself as root;
    edges with a null end are ignored; repeated edges count once; no edges give no rows.
    """
    ends = cut(edges.select("a", "b").where(F.col("a").isNotNull() & F.col("b").isNotNull()))
    loops = ends.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    now = cut(ends.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    state = _state(now)
    while state[0]:
        both = now.select(F.explode(F.array(F.struct(F.col("u"), F.col("v")), F.struct(F.col("v").alias("u"), F.col("u").alias("v")))).alias("e")).select("e.u", "e.v")
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = cut(_attach_least(both, least).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct())
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = _attach_least(large, least).select(F.explode(F.array(F.struct(F.col("u"), F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e")).select("e.u", "e.v")
        old, now = now, cut(small.where("u <> v").distinct())
        discard(old, large)
        before, state = state, _state(now)
        if before == state:
            break
    if state[0] == 0:
        return loops.select("node", F.col("node").alias("root"))
    roots = now.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return loops.join(roots, "node", "left").select("node", F.coalesce("root", "node").alias("root"))


def cluster_ids(components: DataFrame) -> DataFrame:
    """``components`` with cluster: roots numbered from 0 in their order. The table of roots is sorted in ranges."""
    from .ordered import cumulate

    roots = components.select("root").distinct().withColumn("n", F.lit(1))
    numbered = cumulate(roots, [], "root", ["n"]).select(F.col("root").alias("_root"), F.col("n_before").cast("bigint").alias("cluster"))
    return components.join(numbered, F.col("root") == F.col("_root")).drop("_root")


def cluster_diagnostics(clusters: DataFrame, cluster: str = "cluster") -> DataFrame:
    """Clusters, members, the largest, and the share of members alone in theirs: one row."""
    sizes = clusters.groupBy(cluster).agg(F.count(F.lit(1)).alias("size"))
    return sizes.agg(F.count(F.lit(1)).alias("n_clusters"), F.sum("size").alias("n_members"), F.max("size").alias("largest"), (F.count_if(F.col("size") == 1) / F.sum("size")).alias("alone"))

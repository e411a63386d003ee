"""Near-duplicates by the Jaccard similarity of word shingles: candidates by MinHash and SimHash, each pair verified exactly."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.graph import connected_components
from ..storage import cut
from .grams import chunks, mix64
from .simhash import CALL, SEED, TILE, majority, near_pairs, shingles

#: MinHash bins in a band, and bands: two texts of similarity 0.8 share a band with probability 0.9998.
ROWS, BANDS = 4, 16
#: Differing bits of fingerprints over different shingles up to which a pair is verified: two texts of
#: similarity 0.8 differ in 9.7 bits, give or take 2.9, so five deviations are left.
RADIUS = 24
#: Leaders of a bucket in the second round, which buckets of no more members skip.
LEADERS = 8


def shingle_set(text: str, width: int) -> np.ndarray:
    """The sorted hashes of a text's different shingles; none for a text without words."""
    found = [xxhash.xxh64_intdigest(s, SEED) for s in set(shingles(text, width))]
    return np.sort(np.array(found, dtype=np.uint64))


def jaccard(a: np.ndarray, b: np.ndarray) -> float:
    """Jaccard similarity of two sorted sets; 1 for two empty ones."""
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both / (len(a) + len(b) - both) if len(a) + len(b) else 1.0


def band_keys(hashes: np.ndarray) -> list[int]:
    """A key for each band that holds a shingle at all, by one permutation: the least hash of each bin, folded by band."""
    if not len(hashes):
        return [0]
    h = mix64(hashes)
    bins = (h % np.uint64(ROWS * BANDS)).astype(np.int64)
    least = np.full(ROWS * BANDS, np.iinfo(np.uint64).max, dtype=np.uint64)
    np.minimum.at(least, bins, h)
    rows = least.reshape(BANDS, ROWS)
    some = (np.bincount(bins, minlength=ROWS * BANDS).reshape(BANDS, ROWS) > 0).any(axis=1)
    key = np.arange(1, BANDS + 1, dtype=np.uint64)
    for i in range(ROWS):
        key = mix64(key ^ rows[:, i])
    return key[some].view(np.int64).tolist()


def _pairs(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()


def _verified(pairs: DataFrame, texts: DataFrame, width: int, threshold: float) -> DataFrame:
    """The pairs a, b whose texts have at least the threshold's similarity."""

    def check(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        last: tuple[int, np.ndarray] | None = None
        for batch in batches:
            near = np.zeros(len(batch), dtype=bool)
            for i, (b, left, right) in enumerate(zip(batch["b"], batch["left"], batch["right"], strict=True)):
                if last is None or last[0] != b:  # rows come by b: a leader's shingles are made once
                    last = (b, shingle_set(right, width))
                near[i] = jaccard(shingle_set(left, width), last[1]) >= threshold
            yield batch.loc[near, ["a", "b"]]

    left = texts.select(F.col("node").alias("_a"), F.col("text").alias("left"))
    right = texts.select(F.col("node").alias("_b"), F.col("text").alias("right"))
    both = cut(pairs).join(left, F.col("a") == F.col("_a")).join(right, F.col("b") == F.col("_b")).select("a", "b", "left", "right")
    return cut(both.mapInPandas(check, "a long, b long"))


def _mixed(members: DataFrame, roots: DataFrame) -> DataFrame:
    """Members (key, node, fp, root, size) of the buckets that hold several components."""
    known = members.join(roots.select(F.col("node").alias("_node"), F.col("root").alias("_root")), F.col("node") == F.col("_node"), "left")
    named = cut(known.select("key", "node", "fp", F.coalesce("_root", "node").alias("root")))
    several = cut(named.groupBy("key").agg(F.min("root").alias("_low"), F.max("root").alias("_high"), F.count(F.lit(1)).alias("size")).where("_low < _high"))
    return cut(named.join(several.select(F.col("key").alias("_key"), "size"), F.col("key") == F.col("_key")).drop("_key"))


def _led(mixed: DataFrame, radius: int) -> DataFrame:
    """Pairs of the members of large buckets with up to LEADERS members of other components."""
    large = mixed.where(F.col("size") > LEADERS)
    slot = F.pmod(F.xxhash64("root", F.lit(11)), F.lit(LEADERS))
    leaders = large.groupBy("key", slot.alias("slot")).agg(F.min(F.struct("node", "fp", "root")).alias("_l")).select(F.col("key").alias("_key"), "_l")
    met = large.join(cut(leaders), (F.col("key") == F.col("_key")) & (F.col("root") != F.col("_l.root")))
    return _pairs(met.where(F.bit_count(F.col("fp").bitwiseXOR(F.col("_l.fp"))) <= radius).select(F.col("node").alias("a"), F.col("_l.node").alias("b")))


def _all(mixed: DataFrame, radius: int) -> DataFrame:
    """All pairs of different components within the radius that share a bucket; large buckets are compared by pairs of tiles."""
    tiled = mixed.withColumn("tiles", F.ceil(F.col("size") / TILE).cast("int"))
    mine = F.pmod(F.xxhash64("node", F.lit(7)), F.col("tiles")).cast("int")
    units = tiled.withColumn("_mine", mine).withColumn("_other", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)))
    unit = F.xxhash64("key", F.least("_mine", "_other"), F.greatest("_mine", "_other"))
    rows = tiled.agg(F.sum("tiles")).first()[0] or 0
    dealt = units.select(unit.alias("unit"), "node", "fp", "root").withColumn("call", F.pmod("unit", F.lit(max(1, rows // CALL))))

    def compare(rows: pd.DataFrame) -> pd.DataFrame:
        left, right = near_pairs(rows["unit"].to_numpy(), rows["fp"].to_numpy().view(np.uint64), radius)
        node, root = rows["node"].to_numpy(), rows["root"].to_numpy()
        apart = root[left] != root[right]
        return pd.DataFrame({"a": node[left[apart]], "b": node[right[apart]]})

    return _pairs(dealt.groupBy("call").applyInPandas(compare, "a long, b long"))


def near_components(docs: DataFrame, *, width: int = 5, threshold: float = 0.8, radius: int = RADIUS) -> DataFrame:
    """doc_id and component_id of every row: the smallest doc_id reachable over pairs of at least ``threshold`` Jaccard similarity.

    The sets are the different shingles of ``width`` words, words as in :func:`.simhash.fingerprint`; two texts without words are
    alike. Equal texts are one node. Nodes that share a band key meet in a bucket. They are compared with the bucket's
    least node, then, in buckets of more than LEADERS that still hold several components, with LEADERS members, and
    at last all pairs of different components are compared: components that the first rounds join save comparisons and nothing
    is left out. What can be missed is what the bands and the radius miss. A pair is only ever joined by its exact similarity.
    The last round grows with the square of a bucket where its texts are not near each other.

    Null text is an empty text. Null doc_id: gets its component, but is never its smallest id.
    """
    read = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text")).withColumn("node", F.xxhash64("text"))

    def sketch(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for piece in chunks(batches):
            sets = [shingle_set(t, width) for t in piece["text"]]
            fp = np.array([majority(s) for s in sets], dtype=np.uint64).view(np.int64)
            yield pd.DataFrame({"doc_id": piece["doc_id"].astype("Int64"), "node": piece["node"], "fp": fp, "keys": [band_keys(s) for s in sets]})

    rows = cut(read.mapInPandas(sketch, "doc_id long, node long, fp long, keys array<long>"))
    nodes = cut(rows.groupBy("node").agg(F.min("doc_id").alias("first_id"), F.first("fp").alias("fp"), F.first("keys").alias("keys")))
    keyed = nodes.select("node", "fp", F.explode("keys").alias("key"))
    buckets = cut(keyed.groupBy("key").agg(F.min(F.struct("node", "fp")).alias("_l"), F.max("node").alias("_most")).where("_l.node < _most"))
    members = cut(keyed.join(buckets.select(F.col("key").alias("_key"), "_l"), F.col("key") == F.col("_key")).drop("_key"))
    met = cut(members.select(F.col("node").alias("_id")).distinct())
    texts = cut(read.join(met, F.col("node") == F.col("_id"), "left_semi").groupBy("node").agg(F.first("text").alias("text")))

    close = F.bit_count(F.col("fp").bitwiseXOR(F.col("_l.fp"))) <= radius
    first = members.where((F.col("node") != F.col("_l.node")) & close).select(F.col("node").alias("a"), F.col("_l.node").alias("b"))
    roots = connected_components(_verified(_pairs(first), texts, width, threshold))
    members = members.drop("_l")
    for compare in (_led, _all):
        mixed = _mixed(members, roots)
        if compare is _led and mixed.where(F.col("size") > LEADERS).isEmpty():
            continue
        more = _verified(compare(mixed, radius), texts, width, threshold)
        if not more.isEmpty():
            roots = connected_components(more.unionByName(roots.select(F.col("node").alias("a"), F.col("root").alias("b"))))
    roots = roots.withColumnRenamed("node", "_node")
    placed = cut(nodes.select("node", "first_id").join(roots, F.col("node") == F.col("_node"), "left").select("node", "first_id", F.coalesce("root", "node").alias("root")))
    least = placed.groupBy("root").agg(F.min("first_id").alias("component_id")).withColumnRenamed("root", "_root")
    named = placed.join(least, F.col("root") == F.col("_root")).select(F.col("node").alias("_node"), "component_id")
    return rows.select("doc_id", "node").join(named, F.col("node") == F.col("_node")).select("doc_id", "component_id")


def keep_one_near(docs: DataFrame, **options) -> DataFrame:
    """The row of ``docs`` with the smallest doc_id of each component of :func:`near_components`; of rows that repeat this doc_id, one.

    Rows with a null doc_id stay.
    """
    found = near_components(docs, **options)
    keep = found.where("doc_id = component_id").select(F.col("doc_id").alias("_id")).distinct()
    # rows travel in a struct, so that their columns can have any name
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"), F.col("doc_id").cast("bigint").alias("_doc"))
    chosen = rows.join(keep, F.col("_doc") == F.col("_id"), "left_semi").dropDuplicates(["_doc"])
    return chosen.unionByName(rows.where(F.col("_doc").isNull())).select(*[F.col("_row")[c].alias(c) for c in docs.columns])

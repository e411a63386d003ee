"""Near-duplicates by SimHash: fingerprints, and exact comparison in tiles."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.graph import connected_components
from ..storage import cut
from .grams import chunks

BITS = 64
SEED = 42
#: Shingles whose bits are counted at once.
COUNTED = 1 << 15
#: Rows of a tile, about: what two tiles hold is compared in one go.
TILE = 512
#: Rows, about, that a call of the tile comparison gets; small tiles share a call.
CALL = 16_384


def shingles(text: str, width: int) -> list[bytes]:
    """A text's shingles of ``width`` words joined by a space, repeats included (fewer words: all of them; none: no shingle).

    Words are split at ASCII white space after A-Z are made small.
    """
    words = text.encode("utf-8", "replace").lower().split()
    if not words:
        return []
    if len(words) < width:
        return [b" ".join(words)]
    if width == 3:
        return [b"%b %b %b" % s for s in zip(words, words[1:], words[2:], strict=False)]
    return [b" ".join(words[i : i + width]) for i in range(len(words) - width + 1)]


def majority(hashes: np.ndarray) -> int:
    """The number whose bits are set in over half of the hashes; 0 for none."""
    ones = np.zeros(BITS, dtype=np.int64)
    for at in range(0, len(hashes), COUNTED):
        part = hashes[at : at + COUNTED]
        ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view("<u8")[0])


def fingerprint(text: str, width: int = 3) -> int:
    """SimHash of a text as an unsigned number: a bit is set if it is set in over half of the shingles' XXH64 (:func:`shingles`)."""
    digest = xxhash.xxh64_intdigest
    found = shingles(text, width)
    return majority(np.fromiter((digest(s, SEED) for s in found), dtype="<u8", count=len(found)))


def fingerprints(docs: DataFrame, *, width: int = 3) -> DataFrame:
    """doc_id and fp (the fingerprint's 64 bits as a signed number) of every row; null texts are empty."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for piece in chunks(batches):
            found = np.fromiter((fingerprint(t, width) for t in piece["text"]), dtype=np.uint64, count=len(piece))
            yield pd.DataFrame({"doc_id": piece["doc_id"].astype("Int64"), "fp": found.view(np.int64)})

    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").mapInPandas(run, "doc_id long, fp long")


def _keys(fp: Column, n: int, radius: int) -> Column:
    """Keys of which two fingerprints within ``radius`` share one at least.

    The bits are cut into blocks, and ``radius`` differing bits leave all but ``radius`` of the blocks equal: a key is
    a choice of so many blocks. More fingerprints get more blocks and longer keys, so that
    few share one by chance.
    """
    n_blocks = radius + 1
    while n_blocks < radius + 4 and n > 1 << (BITS * (n_blocks - radius) // n_blocks - 3):
        n_blocks += 1
    edges = [BITS * i // n_blocks for i in range(n_blocks + 1)]
    masks = [((1 << hi) - 1) ^ ((1 << lo) - 1) for lo, hi in zip(edges, edges[1:], strict=False)]
    signed = lambda x: x - (1 << BITS) if x >= 1 << (BITS - 1) else x
    chosen = [sum(c) for c in combinations(masks, n_blocks - radius)]
    return F.array(*[F.xxhash64(F.lit(i), fp.bitwiseAND(F.lit(signed(m)))) for i, m in enumerate(chosen)])


def near_pairs(tile: np.ndarray, fp: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Places of all pairs of one tile whose fingerprints differ in at most ``radius`` bits.

    Rows are sorted by tile and population count. Each row is compared with the next one, the
    one after it, and so on, all rows at once; a row stops where its tile ends or the counts
    differ by more than the radius, for then no later row can be near.
    """
    ones = np.bitwise_count(fp).astype(np.int64)
    order = np.lexsort((ones, tile))
    tile, fp, ones = tile[order], fp[order], ones[order]
    left, right = [], []
    at = np.arange(len(fp))
    gap = 1
    while len(at):
        at = at[at + gap < len(fp)]
        to = at + gap
        alive = (tile[at] == tile[to]) & (ones[to] - ones[at] <= radius)
        at, to = at[alive], to[alive]
        near = np.bitwise_count(fp[at] ^ fp[to]) <= radius
        left.append(order[at[near]])
        right.append(order[to[near]])
        gap += 1
    empty = np.zeros(0, np.int64)
    return np.concatenate([empty, *left]), np.concatenate([empty, *right])


def spanning(n: int, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """For each of ``n`` places the least place of its component under the given pairs."""
    root = np.arange(n)
    while len(left):
        low = np.minimum(root[left], root[right])
        new = root.copy()
        for end in (left, right):
            np.minimum.at(new, root[end], low)
            np.minimum.at(new, end, low)
        new = new[new]
        if (new == root).all():
            break
        root = new
    return root


def calls_for(sizes: DataFrame) -> int:
    """Calls among which the tile rows of buckets of the given sizes are dealt: a row comes once for each tile of its bucket."""
    rows = sizes.agg(F.sum(F.col("size") * F.ceil(F.col("size") / TILE))).first()[0] or 0
    return max(1, int(rows) // CALL)


def links(distinct: DataFrame, *, radius: int = 2) -> DataFrame:
    """Edges a, b between distinct fingerprints that span the same components as all pairs within ``radius`` bits.

    Fingerprints meet in buckets by key (:func:`_keys`). A bucket of more than TILE rows is dealt into tiles
    by a hash, and each pair of its tiles is a task's unit of work, so that no bucket lies in
    one task. Within a unit every pair is compared, and a spanning star for each component found
    is returned: rows grow with the fingerprints, not with the pairs.
    """
    n = distinct.count()
    keyed = distinct.select("fp", F.explode(_keys(F.col("fp"), n, radius)).alias("key"))
    sizes = cut(keyed.groupBy("key").agg(F.count(F.lit(1)).alias("size")).where("size > 1").withColumnRenamed("key", "_key"))
    met = keyed.join(sizes, F.col("key") == F.col("_key")).select("fp", "key", F.ceil(F.col("size") / TILE).cast("int").alias("tiles"))
    mine = F.pmod(F.xxhash64("fp", F.lit(7)), F.col("tiles")).cast("int")
    units = met.withColumn("_mine", mine).withColumn("_other", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)))
    unit = F.xxhash64("key", F.least("_mine", "_other"), F.greatest("_mine", "_other"))
    calls = calls_for(sizes)
    dealt = units.select(unit.alias("unit"), "fp").withColumn("call", F.pmod("unit", F.lit(calls)))

    def compare(rows: pd.DataFrame) -> pd.DataFrame:
        fp = rows["fp"].to_numpy()
        left, right = near_pairs(rows["unit"].to_numpy(), fp.view(np.uint64), radius)
        values, place = np.unique(fp, return_inverse=True)
        root = spanning(len(values), place[left], place[right])
        at = np.flatnonzero(root != np.arange(len(root)))
        return pd.DataFrame({"a": values[at], "b": values[root[at]]})

    return dealt.groupBy("call").applyInPandas(compare, "a long, b long").distinct()


def simhash_components(docs: DataFrame, *, width: int = 3, radius: int = 2) -> DataFrame:
    """doc_id, fp and component_id of every row: the smallest doc_id reachable over links of at most ``radius`` bits.

    Equal fingerprints are one node, so a group of copies costs one comparison. Null or empty text: fingerprint 0, linked
    like any other. Null doc_id: gets its component, but is never its smallest id. Repeated rows: equal
    results each. Empty table: empty result. Columns other than doc_id and text aren't read.
    """
    prints = cut(fingerprints(docs, width=width))
    distinct = cut(prints.groupBy("fp").agg(F.min("doc_id").alias("first_id")))
    roots = connected_components(links(distinct.select("fp"), radius=radius))
    placed = distinct.join(roots, distinct["fp"] == roots["node"], "left").select("fp", "first_id", F.coalesce("root", "fp").alias("root"))
    least = placed.groupBy("root").agg(F.min("first_id").alias("component_id")).withColumnRenamed("root", "_root")
    named = placed.join(least, F.col("root") == F.col("_root")).select(F.col("fp").alias("_fp"), "component_id")
    return prints.join(named, F.col("fp") == F.col("_fp")).select("doc_id", "fp", "component_id")


def keep_one_per_component(docs: DataFrame, **options) -> DataFrame:
    """The row of ``docs`` with the smallest doc_id of each component; of rows that repeat this doc_id, one.

    Rows with a null doc_id stay: there is no telling which of them would be meant.
    """
    found = simhash_components(docs, **options)
    keep = found.where("doc_id = component_id").select(F.col("doc_id").alias("_id")).distinct()
    # rows travel in a struct, so that their columns can have any name
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"), F.col("doc_id").cast("bigint").alias("_doc"))
    chosen = rows.join(keep, F.col("_doc") == F.col("_id"), "left_semi").dropDuplicates(["_doc"])
    return chosen.unionByName(rows.where(F.col("_doc").isNull())).select(*[F.col("_row")[c].alias(c) for c in docs.columns])

"""Global alignment of many pairs of sequences at once, with the paired places, and trimming to a reference."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Cells of the tables of steps that are held at once.
CELLS = 1 << 25
LEAST = -1e12


def codes(texts: list[str]) -> np.ndarray:
    """Texts of one length as rows of code points."""
    return np.frombuffer("".join(texts).encode("utf-32-le"), np.uint32).reshape(len(texts), -1)


def trace_many(a: np.ndarray, b: np.ndarray, *, match: float = 1.0, mismatch: float = 0.0, gap_open: float = -2.0, gap_extend: float = -0.5) -> tuple[np.ndarray, np.ndarray]:
    """Scores of the best global alignments with affine gaps of the rows of ``a`` and ``b``, and for each place of ``a`` its place in ``b``, or -1.

    Cells of one antidiagonal depend only on the two before it, so the recurrence runs over antidiagonals and fills
    them for all pairs at once. Of equal alignments the one with a diagonal step, then a gap in ``b``, wins, from the end backwards.
    """
    pairs, n, m = len(a), a.shape[1], b.shape[1]
    came = np.zeros((3, n + m + 1, pairs, n + 1), np.int8)
    before2 = before = None
    for d in range(n + m + 1):
        now = np.full((3, pairs, n + 1), LEAST)
        low, high = max(0, d - m), min(n, d)
        if d == 0:
            now[0, :, 0] = 0
        i = np.arange(max(1, low), min(n, d - 1) + 1)
        if len(i):  # both move
            options = before2[:, :, i - 1]
            came[0, d][:, i] = best = options.argmax(axis=0)
            now[0][:, i] = np.take_along_axis(options, best[None], 0)[0] + np.where(a[:, i - 1] == b[:, d - i - 1], match, mismatch)
        for layer, i, shift in ((1, np.arange(max(1, low), high + 1), 1), (2, np.arange(low, min(n, d - 1) + 1), 0)):  # a gap in b, a gap in a
            if len(i):
                cost = np.full((3, 1, 1), gap_open)
                cost[layer] = gap_extend
                options = before[:, :, i - shift] + cost
                came[layer, d][:, i] = best = options.argmax(axis=0)
                now[layer][:, i] = np.take_along_axis(options, best[None], 0)[0]
        before2, before = before, now
    row = np.arange(pairs)
    layer = before[:, :, n].argmax(axis=0)
    scores = before[layer, row, n]
    partner = np.full((pairs, n), -1, np.int32)
    i, j = np.full(pairs, n), np.full(pairs, m)
    for _ in range(n + m):
        left = i + j > 0
        if not left.any():
            break
        last = came[layer, i + j, row, i]
        both = left & (layer == 0)
        partner[row[both], i[both] - 1] = j[both] - 1
        i, j = np.where(left & (layer != 2), i - 1, i), np.where(left & (layer != 1), j - 1, j)
        layer = np.where(left, last, layer)
    return scores, partner


PLACES = T.StructType([T.StructField("a", T.ArrayType(T.IntegerType())), T.StructField("b", T.ArrayType(T.IntegerType())), T.StructField("score", T.DoubleType())])


def aligned_places(a: Column | str, b: Column | str, *, identical: bool = True, gap_open: float = -2.0, gap_extend: float = -0.5) -> Column:
    """Places (from 0) of ``a`` and ``b`` that the best global alignment puts together, and its score.

    A match counts 1, a mismatch 0. With ``identical`` only equal letters are paired. NULL if either sequence is NULL or empty.
    """

    @F.pandas_udf(PLACES)
    def places(a: pd.Series, b: pd.Series) -> pd.DataFrame:
        out = [(None, None, None)] * len(a)
        good = np.flatnonzero((a.str.len().fillna(0) > 0) & (b.str.len().fillna(0) > 0))
        sizes = pd.DataFrame({"n": a.iloc[good].str.len().to_numpy(), "m": b.iloc[good].str.len().to_numpy(), "at": good})
        for (n, m), rows in sizes.groupby(["n", "m"]):
            n, m = int(n), int(m)
            step = max(1, CELLS // (3 * (n + m + 1) * (n + 1)))
            for start in range(0, len(rows), step):
                at = rows["at"].to_numpy()[start : start + step]
                p, q = codes(a.iloc[at].tolist()), codes(b.iloc[at].tolist())
                scores, partner = trace_many(p, q, gap_open=gap_open, gap_extend=gap_extend)
                kept = partner >= 0
                if identical:
                    kept &= p == np.take_along_axis(q, np.maximum(partner, 0), 1)
                for k, where in enumerate(at):
                    mine = np.flatnonzero(kept[k])
                    out[where] = (mine.tolist(), partner[k, mine].tolist(), float(scores[k]))
        return pd.DataFrame(out, columns=["a", "b", "score"])

    return places(a, b)


def trimmed(sequence: Column, reference: Column) -> Column:
    """The stretch of ``sequence`` of the reference's length with most letters equal to the reference's, the first of equals.

    Windows may hang over either end, where they are shorter; without any equal letter nothing is left. A sequence no longer than
    the reference stays; NULLs give NULL.
    """
    n, k = F.length(sequence), F.length(reference)
    starts = F.sequence(-k, n - 1)  # place of the reference's first letter in the sequence, from 0
    window = lambda s: F.substr(sequence, F.greatest(s, F.lit(0)) + 1, F.least(s + k, n) - F.greatest(s, F.lit(0)))
    part = lambda s: F.substr(reference, F.greatest(-s, F.lit(0)) + 1, F.least(s + k, n) - F.greatest(s, F.lit(0)))
    equal = lambda s: F.size(F.filter(F.zip_with(F.split(window(s), ""), F.split(part(s), ""), lambda x, y: (x == y) & (x != "")), lambda e: e))
    best = F.array_max(F.transform(starts, lambda s: F.struct(equal(s).alias("equal"), (-s).alias("start"))))
    return F.when(n <= k, sequence).otherwise(window(-best["start"]))

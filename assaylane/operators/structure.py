"""Chains, content verdicts, superposition and alignment of structures."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.sequences import AMINO, one_letter

# The BLOSUM62 substitution matrix, rows and columns in this order.
BLOSUM_ORDER = "ARNDCQEGHILKMFPSTWYV"
BLOSUM62 = """
 4 -1 -2 -2  0 -1 -1  0 -2 -1 -1 -1 -1 -2 -1  1  0 -3 -2  0
-1  5  0 -2 -3  1  0 -2  0 -3 -2  2 -1 -3 -2 -1 -1 -3 -2 -3
-2  0  6  1 -3  0  0  0  1 -3 -3  0 -2 -3 -2  1  0 -4 -2 -3
-2 -2  1  6 -3  0  2 -1 -1 -3 -4 -1 -3 -3 -1  0 -1 -4 -3 -3
 0 -3 -3 -3  9 -3 -4 -3 -3 -1 -1 -3 -1 -2 -3 -1 -1 -2 -2 -1
-1  1  0  0 -3  5  2 -2  0 -3 -2  1  0 -3 -1  0 -1 -2 -1 -2
-1  0  0  2 -4  2  5 -2  0 -3 -3  1 -2 -3 -1  0 -1 -3 -2 -2
 0 -2  0 -1 -3 -2 -2  6 -2 -4 -4 -2 -3 -3 -2  0 -2 -2 -3 -3
-2  0  1 -1 -3  0  0 -2  8 -3 -3 -1 -2 -1 -2 -1 -2 -2  2 -3
-1 -3 -3 -3 -1 -3 -3 -4 -3  4  2 -3  1  0 -3 -2 -1 -3 -1  3
-1 -2 -3 -4 -1 -2 -3 -4 -3  2  4 -2  2  0 -3 -2 -1 -2 -1  1
-1  2  0 -1 -3  1  1 -2 -1 -3 -2  5 -1 -3 -1  0 -1 -3 -2 -2
-1 -1 -2 -3 -1  0 -2 -3 -2  1  2 -1  5  0 -2 -1 -1 -1 -1  1
-2 -3 -3 -3 -2 -3 -3 -3 -1  0  0 -3  0  6 -4 -2 -2  1  3 -1
-1 -2 -2 -1 -3 -1 -1 -2 -2 -3 -3 -1 -2 -4  7 -1 -1 -4 -3 -2
 1 -1  1  0 -1  0  0  0 -1 -2 -2  0 -1 -2 -1  4  1 -3 -2 -2
 0 -1  0 -1 -1 -1 -1 -2 -2 -1 -1 -1 -1 -2 -1  1  5 -2 -2  0
-3 -3 -4 -4 -2 -2 -3 -2 -2 -3 -2 -3 -1  1 -4 -3 -2 11  2 -3
-2 -2 -2 -3 -2 -1 -2 -3  2 -1 -1 -2 -1  3 -3 -2 -2  2  7 -1
 0 -3 -3 -3 -1 -2 -2 -3 -3  3  1 -2  1 -1 -2 -2  0 -3 -1  4
"""


def substitution() -> dict[tuple[str, str], float]:
    table = np.array([[float(x) for x in line.split()] for line in BLOSUM62.strip().splitlines()])
    return {(a, b): table[i, j] for i, a in enumerate(BLOSUM_ORDER) for j, b in enumerate(BLOSUM_ORDER)}


def chain_sequences(atoms: DataFrame, keys: list[str]) -> DataFrame:
    """Sequence and length of each chain, from its CA atoms; of alternatives of one residue the first line counts."""
    first = Window.partitionBy(*keys, "chain", "resseq", "icode").orderBy("line_no")
    ca = atoms.where(F.trim("atom") == "CA").withColumn("_rn", F.row_number().over(first)).where("_rn = 1")
    letters = F.sort_array(F.collect_list(F.struct("line_no", one_letter(F.col("resname")).alias("aa"))))
    return ca.groupBy(*keys, "chain").agg(F.array_join(F.transform(letters, lambda x: x["aa"]), "").alias("sequence")).withColumn("length", F.length("sequence"))


def content_verdict(chains: Column, peptide: Column, *, receptor: str = "A", ligand: str = "B", low: int = 170, high: int = 200) -> Column:
    """The first failing check of a model, whose ``chains`` map names to sequences, or ``ok``."""
    found, heavy = F.try_element_at(chains, F.lit(ligand)), F.try_element_at(chains, F.lit(receptor))
    size = F.coalesce(F.cardinality(chains), F.lit(0))
    return (
        F.when(chains.isNull() | (size == 0), "unreadable")
        .when(size > 2, "extra_chain")
        .when(found.isNull() | heavy.isNull(), "wrong_chain_ids")
        .when(~F.length(heavy).between(low, high), "receptor_size")
        .when(found == peptide, "ok")
        .when(peptide.startswith(found), "truncated_peptide")
        .when(F.length(found) != F.length(peptide), "peptide_length")
        .otherwise("peptide_mismatch")
    )


def peptide_chain(chains: DataFrame, keys: list[str], peptide: str, *, low: int = 7, high: int = 15) -> DataFrame:
    """The peptide's chain of each model: an equal sequence first, else one of peptide length, the lowest name of several."""
    rank = F.when(F.col("sequence") == F.col(peptide), 0).when(F.col("length").between(low, high), 1)
    w = Window.partitionBy(*keys).orderBy("_rank", "chain")
    return chains.withColumn("_rank", rank).where("_rank is not null").withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rank", "_rn")


def heavy_chain(chains: DataFrame, keys: list[str], *, low: int = 170, high: int = 290) -> DataFrame:
    """The longest chain of receptor length of each model, the lowest name of equals."""
    w = Window.partitionBy(*keys).orderBy(F.desc("length"), "chain")
    return chains.where(F.col("length").between(low, high)).withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn")


def superpose(fixed: np.ndarray, moving: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rotation and translation that bring ``moving`` nearest to ``fixed`` in the least-squares sense (Kabsch)."""
    a, b = fixed.mean(axis=0), moving.mean(axis=0)
    u, _, vt = np.linalg.svd((moving - b).T @ (fixed - a))
    flip = np.diag([1.0, 1.0, np.sign(np.linalg.det(u @ vt))])
    rotation = u @ flip @ vt
    return rotation, a - b @ rotation


def rmsd(a: np.ndarray, b: np.ndarray) -> float:
    return float(np.sqrt(((a - b) ** 2).sum(axis=1).mean()))


@F.pandas_udf(T.DoubleType())
def superposed_rmsd(fixed: pd.Series, moving: pd.Series) -> pd.Series:
    """RMSD after superposition of two flat arrays of x, y, z; missing for fewer than three or unequal numbers of points."""

    def one(p, q) -> float | None:
        if p is None or q is None or len(p) != len(q) or len(p) < 9:
            return None
        x, y = np.asarray(p, float).reshape(-1, 3), np.asarray(q, float).reshape(-1, 3)
        rotation, shift = superpose(x, y)
        return rmsd(x, y @ rotation + shift)

    return pd.Series([one(p, q) for p, q in zip(fixed, moving, strict=True)], dtype=float)


@F.pandas_udf(T.DoubleType())
def peptide_rmsd(fixed_receptor: pd.Series, moving_receptor: pd.Series, fixed_peptide: pd.Series, moving_peptide: pd.Series) -> pd.Series:
    """RMSD of the peptide after superposing the receptor: flat arrays of paired x, y, z.

    Missing if the receptor has fewer than three pairs, or the sides' numbers of points differ.
    """

    def one(a, b, p, q) -> float | None:
        if any(x is None for x in (a, b, p, q)) or len(a) != len(b) or len(p) != len(q) or len(a) < 9 or not len(p):
            return None
        a, b, p, q = (np.asarray(x, float).reshape(-1, 3) for x in (a, b, p, q))
        rotation, shift = superpose(a, b)
        return rmsd(p, q @ rotation + shift)

    return pd.Series([one(*x) for x in zip(fixed_receptor, moving_receptor, fixed_peptide, moving_peptide, strict=True)], dtype=float)


def align(a: str, b: str, *, score: dict | None = None, match: float = 1.0, mismatch: float = 0.0, gap_open: float = -10.0, gap_extend: float = -0.5) -> tuple[float, list[tuple[int, int]]]:
    """Score and aligned places of the best global alignment with affine gaps (Gotoh); a diagonal step wins ties."""
    n, m = len(a), len(b)
    least = float("-inf")
    best = np.full((3, n + 1, m + 1), least)  # both, gap in b, gap in a
    came = np.zeros((3, n + 1, m + 1), dtype=np.int8)
    best[0, 0, 0] = 0
    for i in range(1, n + 1):
        best[1, i, 0], came[1, i, 0] = gap_open + (i - 1) * gap_extend, 1 if i > 1 else 0
    for j in range(1, m + 1):
        best[2, 0, j], came[2, 0, j] = gap_open + (j - 1) * gap_extend, 2 if j > 1 else 0
    for i in range(1, n + 1):
        for j in range(1, m + 1):
            s = score.get((a[i - 1], b[j - 1]), mismatch) if score else (match if a[i - 1] == b[j - 1] else mismatch)
            for layer, (di, dj), cost in ((0, (1, 1), (s, s, s)), (1, (1, 0), (gap_open, gap_extend, gap_open)), (2, (0, 1), (gap_open, gap_open, gap_extend))):
                options = [best[k, i - di, j - dj] + cost[k] for k in range(3)]
                k = int(np.argmax(options))
                best[layer, i, j], came[layer, i, j] = options[k], k
    layer = int(np.argmax(best[:, n, m]))
    total, i, j, pairs = float(best[layer, n, m]), n, m, []
    while i or j:
        before = int(came[layer, i, j])
        if layer == 0:
            pairs.append((i - 1, j - 1))
        i, j = i - (layer != 2), j - (layer != 1)
        layer = before
    return total, pairs[::-1]


def align_many(a: list[str], b: list[str], *, gap_open: float = -10.0, gap_extend: float = -0.5) -> np.ndarray:
    """Global BLOSUM62 alignment scores of many pairs, all of one length on either side: the recurrence runs over pairs at once."""
    table = np.zeros((128, 128))
    for (x, y), value in substitution().items():
        table[ord(x), ord(y)] = value
    code = lambda texts: np.minimum(np.array([[ord(c) for c in t.upper()] for t in texts]).reshape(len(texts), -1), 127)
    p, q = code(a), code(b)
    n, m = p.shape[1], q.shape[1]
    both, down, across = (np.full((m + 1, len(a)), -np.inf) for _ in range(3))
    both[0] = 0
    for j in range(1, m + 1):
        across[j] = gap_open + (j - 1) * gap_extend
    for i in range(1, n + 1):
        new_both, new_down, new_across = (np.full((m + 1, len(a)), -np.inf) for _ in range(3))
        new_down[0] = gap_open + (i - 1) * gap_extend
        for j in range(1, m + 1):
            before = np.maximum(np.maximum(both[j - 1], down[j - 1]), across[j - 1])
            new_both[j] = before + table[p[:, i - 1], q[:, j - 1]]
            new_down[j] = np.maximum(np.maximum(both[j], across[j]) + gap_open, down[j] + gap_extend)
            new_across[j] = np.maximum(np.maximum(new_both[j - 1], new_down[j - 1]) + gap_open, new_across[j - 1] + gap_extend)
        both, down, across = new_both, new_down, new_across
    return np.maximum(np.maximum(both[m], down[m]), across[m])


@F.pandas_udf(T.DoubleType())
def alignment_score(a: pd.Series, b: pd.Series) -> pd.Series:
    """Global alignment score of two sequences by BLOSUM62, gaps -10 and -0.5; missing if either is."""
    out = pd.Series(np.nan, index=a.index, dtype=float)
    good = a.notna() & b.notna()
    lengths = pd.DataFrame({"n": a[good].str.len(), "m": b[good].str.len()})
    for (n, m), rows in lengths.groupby(["n", "m"]):
        if n and m:
            out[rows.index] = align_many(a[rows.index].tolist(), b[rows.index].tolist())
    return out


def similar_templates(queries: DataFrame, templates: DataFrame, sequence: str, name: str, order: str, *, k: int = 10, omit_self: bool = False) -> DataFrame:
    """The k best templates of a query's length by alignment score, ties in the templates' own order."""
    right = templates.select(F.col(sequence).alias("template"), F.col(name).alias("template_name"), F.col(order).alias("template_order"))
    met = queries.join(right, F.length(sequence) == F.length("template"))
    met = met.where(F.col(sequence) != F.col("template")) if omit_self else met
    scored = met.withColumn("score", alignment_score(F.col(sequence), F.col("template")))
    w = Window.partitionBy(sequence).orderBy(F.desc("score"), F.asc("template_order"))
    return scored.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def best_window(target: str, reference: str) -> str:
    """The stretch of ``target`` of the reference's length with most equal places, the first of equals."""
    n = len(reference)
    if len(target) <= n:
        return target
    scores = [sum(x == y for x, y in zip(target[i : i + n], reference, strict=True)) for i in range(len(target) - n + 1)]
    at = scores.index(max(scores))
    return target[at : at + n]


def is_peptide(sequence: str) -> bool:
    return 7 <= len(sequence) <= 15 and all(x in AMINO for x in sequence)

"""Chains of structures, which of them to compare, and RMSD after superposition on aligned residues.

Alignment and the rotations need arrays of numbers and run as Arrow-batched functions of columns; everything else is column
expressions. A chain is a row, so pairs of chains are joined like any other rows.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.sequences import one_letter
from .alignment import aligned_places

# The atoms of the backbone, in this order.
BACKBONE = ("N", "CA", "C", "O")


def chain_table(atoms: DataFrame, keys: Sequence[str], *, min_residues: int = 5) -> DataFrame:
    """A row for each protein chain: sequence, length, backbone, ca_sequence, ca and line_no.

    ``atoms`` has keys, chain, resseq, icode, resname, atom, x, y, z, line_no. Residues other than the twenty amino acids are left out, and of
    alternatives of one atom the first line counts. ``backbone`` has four points for each residue, NULL where the atom is missing; ``ca_sequence``
    and ``ca`` (flat x, y, z) are of the residues with a CA. Chains of fewer than ``min_residues`` residues go; NULL names of chains are names.
    """
    letter = one_letter(F.col("resname"), unknown=None)
    point = lambda name: F.min_by(F.array("x", "y", "z"), F.when(F.trim("atom") == name, F.col("line_no")))
    seen = lambda name: F.max(F.trim("atom") == name)
    points = [F.when(seen(name), point(name)).alias(name) for name in BACKBONE]
    residues = atoms.withColumn("_letter", letter).where("_letter is not null").groupBy(*keys, "chain", "resseq", "icode").agg(F.min("line_no").alias("_first"), F.min_by("_letter", "line_no").alias("_aa"), *points)
    in_order = F.sort_array(F.collect_list(F.struct("_first", F.col("_aa").alias("aa"), F.array(*BACKBONE).alias("points"))))
    chains = residues.groupBy(*keys, "chain").agg(in_order.alias("_r"), F.min("_first").alias("line_no")).where(F.size("_r") >= min_residues)
    with_ca = F.filter("_r", lambda r: r["points"][1].isNotNull())
    return chains.select(
        *keys, "chain", F.array_join(F.transform("_r", lambda r: r["aa"]), "").alias("sequence"), F.size("_r").alias("length"), F.flatten(F.transform("_r", lambda r: r["points"])).alias("backbone"),
        F.array_join(F.transform(with_ca, lambda r: r["aa"]), "").alias("ca_sequence"), F.flatten(F.transform(with_ca, lambda r: r["points"][1])).alias("ca"), "line_no",
    )


def choose_chains(chains: DataFrame, keys: Sequence[str], peptides: DataFrame, peptide: str, *, modelled: bool = False) -> DataFrame:
    """For each row of ``peptides`` (keys and the expected sequence) its peptide_chain, heavy_chain, n_candidates and verdict.

    The peptide's chain is the first in the file with the expected sequence, else of chains of 7 to 15 residues the lowest name; n_candidates counts
    the chains among which the rule chose, so 1 means that there was no choice. The heavy chain is the longest other one of 170 to 290
    residues. In ``modelled`` structures the peptide is the equal sequence, else chain B, and the heavy chain the longest other one
    of 100 or more. Of equal lengths the first in the file wins. verdict: ``ok``, ``no peptide chain``, ``no heavy chain`` or ``no chains``.
    """
    listed = chains.groupBy(*keys).agg(F.collect_list(F.struct("line_no", "chain", "sequence", "length")).alias("_chains"))
    rows = peptides.join(listed.hint("merge"), list(keys), "left")  # chains look small to the planner, which can't tell their sequences' lengths, and would be broadcast.withColumn("_chains", F.sort_array("_chains"))
    exact = F.filter("_chains", lambda c: c["sequence"] == F.col(peptide))
    other = F.filter("_chains", lambda c: c["chain"] == "B") if modelled else F.array_sort(F.filter("_chains", lambda c: c["length"].between(7, 15)), lambda x, y: F.when(x["chain"] < y["chain"], -1).when(x["chain"] > y["chain"], 1).otherwise(0))
    rows = rows.withColumn("_peptides", F.when(F.size(exact) > 0, exact).otherwise(other)).withColumn("peptide_chain", F.get("_peptides", F.lit(0))["chain"])
    long = (lambda c: c["length"] >= 100) if modelled else (lambda c: c["length"].between(170, 290))
    heavy = F.filter("_chains", lambda c: ~c["chain"].eqNullSafe(F.col("peptide_chain")) & long(c))
    longest = F.array_max(F.transform(heavy, lambda c: F.struct(c["length"], -c["line_no"], c["chain"].alias("chain"))))["chain"]
    verdict = F.when(F.col("_chains").isNull(), "no chains").when(F.col("peptide_chain").isNull(), "no peptide chain").when(longest.isNull(), "no heavy chain").otherwise("ok")
    return rows.withColumns({"heavy_chain": longest, "n_candidates": F.coalesce(F.size("_peptides"), F.lit(0)), "verdict": verdict}).drop("_chains", "_peptides")


def template_verdicts(declared: DataFrame, chains: DataFrame, keys: Sequence[str], chain: str, sequence: str) -> DataFrame:
    """``declared`` (keys, the name of a chain and the sequence it should have) with found and verdict.

    verdict: ``ok``, ``sequence differs`` or ``chain missing``; a template is bad unless it is ok. Every declared row stays.
    """
    found = chains.select(*keys, F.col("chain").alias("_chain"), F.col("sequence").alias("found"))
    same = F.col(f"d.{chain}") == F.col("f._chain")
    for k in keys:
        same = same & (F.col(f"d.{k}") == F.col(f"f.{k}"))
    rows = declared.alias("d").join(found.alias("f").hint("merge"), same, "left").select("d.*", "f.found")
    return rows.withColumn("verdict", F.when(F.col("found").isNull(), "chain missing").when(F.col("found") == F.col(sequence), "ok").otherwise("sequence differs"))


def sound_templates(declared: DataFrame, chains: DataFrame, keys: Sequence[str], chain: str, sequence: str) -> DataFrame:
    """The declared templates without those of which any chain is bad."""
    bad = template_verdicts(declared, chains, keys, chain, sequence).where("verdict <> 'ok'").select(*keys).distinct()
    return declared.join(bad.hint("merge"), list(keys), "left_anti")


def whole_residues(atoms: DataFrame, keys: Sequence[str], *, min_atoms: int = 3) -> DataFrame:
    """``atoms`` without residues that have fewer than ``min_atoms`` atoms."""
    residue = [*keys, "chain", "resseq", "icode"]
    short = atoms.groupBy(*residue).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") < min_atoms)
    same = F.lit(True)
    for c in residue:
        same = same & F.col(f"a.{c}").eqNullSafe(F.col(f"s.{c}"))
    return atoms.alias("a").join(short.alias("s"), same, "left_anti")


MOTION = T.StructType([T.StructField("rotation", T.ArrayType(T.DoubleType())), T.StructField("shift", T.ArrayType(T.DoubleType())), T.StructField("n_pairs", T.IntegerType()), T.StructField("rmsd", T.DoubleType())])


def motions(fixed: list[np.ndarray], moving: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rotations, shifts and RMSDs that bring each list of moving points nearest to its fixed ones (Kabsch): one stacked decomposition."""
    sizes = np.array([len(x) for x in fixed])
    starts = np.concatenate([[0], sizes.cumsum()[:-1]])
    p, q = np.concatenate(fixed), np.concatenate(moving)
    a, b = (np.add.reduceat(x, starts) / sizes[:, None] for x in (p, q))
    cp, cq = p - np.repeat(a, sizes, axis=0), q - np.repeat(b, sizes, axis=0)
    u, _, vt = np.linalg.svd(np.add.reduceat(cq[:, :, None] * cp[:, None, :], starts))
    u[:, :, 2] *= np.where(np.linalg.det(u @ vt) < 0, -1.0, 1.0)[:, None]
    rotation = u @ vt
    apart = np.einsum("ni,nij->nj", cq, np.repeat(rotation, sizes, axis=0)) - cp
    rmsd = np.sqrt(np.add.reduceat((apart**2).sum(axis=1), starts) / sizes)
    return rotation, a - np.einsum("ni,nij->nj", b, rotation), rmsd


@F.pandas_udf(MOTION)
def superposition(fixed: pd.Series, moving: pd.Series) -> pd.DataFrame:
    """Rigid motion of ``moving`` onto ``fixed`` (flat x, y, z of paired points): rotation by rows (a point times it, plus shift), n_pairs, rmsd.

    Without motion for fewer than three pairs; NULL points or unequal numbers give NULL.
    """
    out = [(None, None, None, None)] * len(fixed)
    good = []
    for i, (p, q) in enumerate(zip(fixed, moving, strict=True)):
        if p is not None and q is not None and len(p) == len(q) and len(p) % 3 == 0:
            out[i] = (None, None, len(p) // 3, None)
            if len(p) >= 9:
                good.append(i)
    if good:
        rotation, shift, rmsd = motions(*[[np.asarray(x.iloc[i], float).reshape(-1, 3) for i in good] for x in (fixed, moving)])
        for k, i in enumerate(good):
            out[i] = (rotation[k].ravel().tolist(), shift[k].tolist(), out[i][2], float(rmsd[k]))
    return pd.DataFrame(out, columns=["rotation", "shift", "n_pairs", "rmsd"]).astype({"n_pairs": "Int32"})


def moved(point: Column, motion: Column) -> Column:
    """A point (array of x, y, z) after a rigid motion."""
    return F.array(*[point[0] * motion["rotation"][c] + point[1] * motion["rotation"][3 + c] + point[2] * motion["rotation"][6 + c] + motion["shift"][c] for c in range(3)])


def places_to_points(flat: Column, places: Column) -> Column:
    """The flat points at the places."""
    return F.flatten(F.transform(places, lambda i: F.slice(flat, i * 3 + 1, 3)))


def backbone_pairs(first: Column, second: Column, places: Column) -> Column:
    """Pairs (m, e) of backbone points of residues paired by ``places`` (a, b), of atoms that both sides have."""
    atoms = F.array(*[F.lit(k) for k in range(len(BACKBONE))])
    pairs = F.flatten(F.transform(F.arrays_zip(places["a"].alias("a"), places["b"].alias("b")), lambda p: F.transform(atoms, lambda k: F.struct(F.get(first, p["a"] * 4 + k).alias("m"), F.get(second, p["b"] * 4 + k).alias("e")))))
    return F.filter(pairs, lambda p: p["m"].isNotNull() & p["e"].isNotNull())


def peptide_records(pairs: DataFrame, expected: str, *, min_pairs: int = 50, coverage: float = 0.5) -> DataFrame:
    """``pairs`` with rmsd, mhc_alignment_rmsd, n_pairs, n_atoms, n_atoms_dropped and error: the peptide's RMSD after superposing the heavy chains.

    Columns of ``pairs``: m_heavy and e_heavy (structs of ca_sequence and ca of the model and of the experiment), m_peptide and e_peptide (sequence
    and backbone), and the expected peptide. Residues are paired where a global alignment puts equal letters together; the motion of the heavy
    chain is applied to the peptide. error is NULL, or says what is missing: ``chain missing``, fewer than ``min_pairs`` CA pairs, no
    backbone atoms, or fewer of them than ``coverage`` of four for each expected residue; then both RMSDs are NULL.
    """
    heavy = pairs.withColumn("_hp", aligned_places(F.col("m_heavy.ca_sequence"), F.col("e_heavy.ca_sequence"))).withColumn("_pp", aligned_places(F.col("m_peptide.sequence"), F.col("e_peptide.sequence")))
    placed = heavy.withColumns({"_fixed": places_to_points(F.col("e_heavy.ca"), F.col("_hp.b")), "_moving": places_to_points(F.col("m_heavy.ca"), F.col("_hp.a")), "_atoms": backbone_pairs(F.col("m_peptide.backbone"), F.col("e_peptide.backbone"), F.col("_pp"))})
    turned = placed.withColumn("_motion", superposition("_fixed", "_moving")).drop("_fixed", "_moving")
    square = lambda p: F.aggregate(F.zip_with(moved(p["m"], F.col("_motion")), p["e"], lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x)
    n = F.size("_atoms")
    there = lambda c: F.size(F.filter(c, lambda x: x.isNotNull()))
    missing = F.col("m_heavy.ca_sequence").isNull() | F.col("e_heavy.ca_sequence").isNull() | F.col("m_peptide.sequence").isNull() | F.col("e_peptide.sequence").isNull()
    n_pairs = F.coalesce(F.col("_motion.n_pairs"), F.lit(0))
    error = F.when(missing, "chain missing").when(n_pairs < min_pairs, F.concat(F.lit("too few paired CA atoms: "), n_pairs.cast("string"))).when(F.coalesce(n, F.lit(0)) == 0, "no backbone atoms").when(n < coverage * 4 * F.length(expected), F.concat(F.lit("too few backbone atoms: "), n.cast("string")))
    rows = turned.withColumns({"error": error, "n_pairs": n_pairs, "n_atoms": F.when(~missing, n), "n_atoms_dropped": F.when(~missing, there(F.col("m_peptide.backbone")) + there(F.col("e_peptide.backbone")) - 2 * n)})
    good = F.col("error").isNull()
    rmsd = F.sqrt(F.aggregate(F.transform("_atoms", square), F.lit(0.0), lambda s, x: s + x) / n)
    return rows.withColumns({"rmsd": F.when(good, rmsd), "mhc_alignment_rmsd": F.when(good, F.col("_motion.rmsd"))}).drop("_hp", "_pp", "_atoms", "_motion")

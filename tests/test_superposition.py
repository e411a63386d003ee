"""Alignment with paired places, superposition, choice of chains."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from assaylane.operators import alignment, structure, superposition


def random_pairs(n, seed=0):
    draw = np.random.default_rng(seed)
    out = []
    for _ in range(n):
        a = "".join(draw.choice(list("ACDE"), draw.integers(1, 14)))
        b = "".join(c for c in a if draw.random() > 0.2) + "".join(draw.choice(list("ACDE"), draw.integers(0, 4)))
        out.append((a, b or "A"))
    return out


def test_places_equal_the_plain_recurrence(spark):
    pairs = random_pairs(150)
    df = spark.createDataFrame([*pairs, ("", "A"), (None, "A"), ("A", None)], "a string, b string").repartition(3)
    for row in df.select("a", "b", alignment.aligned_places("a", "b", identical=False).alias("all"), alignment.aligned_places("a", "b").alias("p")).collect():
        if not row.a or not row.b:
            assert row.p.a is None and row.all.score is None
            continue
        score, expected = structure.align(row.a, row.b, gap_open=-2.0, gap_extend=-0.5)
        assert row.all.score == pytest.approx(score) and list(zip(row.all.a, row.all.b, strict=True)) == expected
        assert list(zip(row.p.a, row.p.b, strict=True)) == [(i, j) for i, j in expected if row.a[i] == row.b[j]]


def test_small_tables_of_steps(monkeypatch):
    monkeypatch.setattr(alignment, "CELLS", 10)
    a, b = alignment.codes(["ACDE", "AAAA"]), alignment.codes(["ACE", "CCC"])
    scores, partner = alignment.trace_many(a, b)
    assert scores.tolist() == [1.0, -2.0] and (partner[0] == structure_partner("ACDE", "ACE")).all()


def structure_partner(a, b):
    out = np.full(len(a), -1)
    for i, j in structure.align(a, b, gap_open=-2.0, gap_extend=-0.5)[1]:
        out[i] = j
    return out


def turned(points, angle, shift):
    c, s = np.cos(angle), np.sin(angle)
    return points @ np.array([[c, s, 0], [-s, c, 0], [0, 0, 1]]) + shift


def test_stacked_motions():
    draw = np.random.default_rng(3)
    fixed = [draw.normal(size=(n, 3)) for n in (3, 4, 50, 7)]
    moving = [turned(p, k + 0.3, draw.normal(size=3)) for k, p in enumerate(fixed)]
    moving[2] = moving[2] + draw.normal(size=moving[2].shape) * 0.1
    moving[3] = moving[3] * np.array([1, 1, -1.0])  # a mirror image can't be turned into place
    rotation, shift, rmsd = superposition.motions(fixed, moving)
    for k, (p, q) in enumerate(zip(fixed, moving, strict=True)):
        one, move = structure.superpose(p, q)
        assert np.allclose(rotation[k], one) and np.allclose(shift[k], move) and rmsd[k] == pytest.approx(structure.rmsd(p, q @ one + move))
        assert np.linalg.det(rotation[k]) == pytest.approx(1)
    assert rmsd[0] < 1e-9 and rmsd[1] < 1e-9 < rmsd[3]


AMINO = "ACDEFGHIKLMNPQRSTVWY"


def pdb(chains):
    """ATOM rows of (chain, sequence, points by residue and atom, numbers of residues to leave out)."""
    names = {"A": "ALA", "C": "CYS", "D": "ASP", "E": "GLU", "F": "PHE", "G": "GLY", "H": "HIS", "I": "ILE", "K": "LYS", "L": "LEU", "M": "MET", "N": "ASN", "P": "PRO", "Q": "GLN", "R": "ARG", "S": "SER", "T": "THR", "V": "VAL", "W": "TRP", "Y": "TYR"}
    rows, line = [], 0
    for model, chain, sequence, points, without in chains:
        for i, aa in enumerate(sequence):
            for k, atom in enumerate(superposition.BACKBONE):
                line += 1
                if i not in without and (i, atom) not in without:
                    rows.append((model, chain, i, "", names.get(aa, "HOH"), atom, *map(float, points[i, k]), line))
    return rows


ATOMS = "model string, chain string, resseq int, icode string, resname string, atom string, x double, y double, z double, line_no int"


@pytest.fixture(scope="module")
def complexes(spark):
    draw = np.random.default_rng(8)
    heavy, peptide = "".join(draw.choice(list(AMINO), 180)), "SIINFEKLV"
    at, pep = draw.normal(size=(180, 4, 3)) * 20, draw.normal(size=(9, 4, 3)) * 5
    mutated = heavy[:60] + ("A" if heavy[60] != "A" else "C") + heavy[61:]
    rows = pdb([("exp", "H", heavy + "G" * 40, np.concatenate([at, draw.normal(size=(40, 4, 3))]), {5, 6, 7}), ("exp", "Q", peptide, pep, {4, (2, "O")})])
    rows += pdb([("far", "H", heavy[:40], at[:40], set()), ("far", "Q", peptide, pep, set()), ("gone", "Q", peptide, pep, {0, 1, 2, 3})])
    rows += pdb([("mod", "A", mutated, turned(at, 0.7, [3, -2, 9.0]), {100}), ("mod", "B", peptide, turned(pep, 0.7, [3, -2, 9.0]), set())])
    extra = [("exp", "W", i, "", "HOH", "O", 0.0, 0.0, 0.0, 99999 + i) for i in range(9)] + [(*rows[0][:6], 99.0, 99.0, 99.0, 99990)]
    return superposition.chain_table(spark.createDataFrame(rows + extra, ATOMS).repartition(4), ["model"]), heavy, peptide


def test_chain_table(complexes):
    chains, heavy, peptide = complexes
    rows = {(r.model, r.chain): r for r in chains.collect()}
    assert rows["mod", "B"].sequence == peptide and rows["exp", "Q"].sequence == "SIINEKLV" and rows["exp", "H"].sequence == (heavy + "G" * 40).replace(heavy[5:8], "", 1)
    assert ("exp", "W") not in rows and rows["exp", "Q"].backbone[2 * 4 + 3] is None and len(rows["exp", "Q"].backbone) == 32
    assert rows["exp", "H"].ca[:3] == rows["exp", "H"].backbone[1] and rows["exp", "H"].backbone[0][0] != 99.0


def record(spark, complexes, model, experiment, expected=None):
    chains, _, peptide = complexes
    pick = lambda m, lengths, cols: chains.where((F.col("model") == m) & F.col("length").between(*lengths)).select(F.struct(*cols).alias("c"))
    get = lambda m, lengths, cols: (pick(m, lengths, cols).collect() or [[None]])[0][0]
    big, little = ["ca_sequence", "ca"], ["sequence", "backbone"]
    schema = "m_heavy struct<ca_sequence:string,ca:array<double>>, e_heavy struct<ca_sequence:string,ca:array<double>>, m_peptide struct<sequence:string,backbone:array<array<double>>>, e_peptide struct<sequence:string,backbone:array<array<double>>>, expected string"
    row = (get(model, (40, 300), big), get(experiment, (40, 300), big), get(model, (5, 15), little), get(experiment, (5, 15), little), expected or peptide)
    return superposition.peptide_records(spark.createDataFrame([row], schema), "expected").first()


def test_planted_motion_is_found_through_gaps_and_mutations(spark, complexes):
    r = record(spark, complexes, "mod", "exp")
    assert r.error is None and r.rmsd == pytest.approx(0, abs=1e-9) and r.mhc_alignment_rmsd == pytest.approx(0, abs=1e-9)
    assert r.n_pairs == 180 - 3 - 1 - 1 and r.n_atoms == 31 and r.n_atoms_dropped == 5 + 0


def test_records_say_what_is_missing(spark, complexes):
    assert record(spark, complexes, "mod", "far").error == "too few paired CA atoms: 40"
    assert record(spark, complexes, "mod", "gone").error == "chain missing"
    r = record(spark, complexes, "mod", "exp", "S" * 20)
    assert r.error == "too few backbone atoms: 31" and r.rmsd is None and r.n_atoms == 31


CHAIN = "model string, chain string, sequence string, length int, line_no int"


def chosen(spark, chains, peptide, **options):
    rows = spark.createDataFrame([("m", c, s, len(s), i) for i, (c, s) in enumerate(chains)], CHAIN)
    asked = spark.createDataFrame([("m", peptide)], "model string, peptide string")
    return superposition.choose_chains(rows, ["model"], asked, "peptide", **options).first()[2:]


def test_choice_of_chains(spark):
    long, longer = "G" * 180, "G" * 275
    assert chosen(spark, [("A", long), ("Z", "SIINFEKL"), ("C", "SIINFEKL"), ("D", longer)], "SIINFEKL") == ("Z", "D", 2, "ok")
    assert chosen(spark, [("A", long), ("Z", "AAAAAAAA"), ("C", "CCCCCCC"), ("D", long)], "SIINFEKL") == ("C", "A", 2, "ok")
    assert chosen(spark, [("A", long), ("B", "SIINFE")], "SIINFEKL")[3] == "no peptide chain"
    assert chosen(spark, [("A", "G" * 150), ("B", "SIINFEKL")], "SIINFEKL") == ("B", None, 1, "no heavy chain")
    assert chosen(spark, [("A", long)], long) == ("A", None, 1, "no heavy chain")  # the peptide's chain is never the heavy one
    assert chosen(spark, [], "SIINFEKL") == (None, None, 0, "no chains")
    assert chosen(spark, [("A", "G" * 120), ("B", "SIINFE"), ("C", "G" * 99)], "SIINFEKL", modelled=True) == ("B", "A", 1, "ok")
    assert chosen(spark, [("A", "SIINFEKL"), ("B", "G" * 120)], "SIINFEKL", modelled=True) == ("A", "B", 1, "ok")


def test_bad_templates_and_short_residues(spark):
    chains = spark.createDataFrame([("a", "P", "SIINFEKL"), ("b", "P", "SIINFEK"), ("c", "X", "SIINFEKL")], "pdb string, chain string, sequence string")
    declared = spark.createDataFrame([(m, "P", "SIINFEKL") for m in "abc"], "pdb string, named string, peptide string")
    verdicts = {r.pdb: r.verdict for r in superposition.template_verdicts(declared, chains, ["pdb"], "named", "peptide").collect()}
    assert verdicts == {"a": "ok", "b": "sequence differs", "c": "chain missing"}
    assert [r.pdb for r in superposition.sound_templates(declared, chains, ["pdb"], "named", "peptide").collect()] == ["a"]
    atoms = spark.createDataFrame(pdb([("m", "A", "AC", np.zeros((2, 4, 3)), {(0, "N"), (0, "O")})]), ATOMS).withColumn("icode", F.lit(None).cast("string"))
    assert {r.resseq for r in superposition.whole_residues(atoms, ["model"]).collect()} == {1}


def test_trimmed(spark):
    def plain(seq, ref):
        if len(seq) <= len(ref):
            return seq
        wins = [(seq[max(s, 0) : s + len(ref)], ref[max(-s, 0) :][: max(0, min(s + len(ref), len(seq)) - max(s, 0))]) for s in range(-len(ref), len(seq))]
        scores = [sum(x == y for x, y in zip(w, r, strict=True)) for w, r in wins]
        return wins[scores.index(max(scores))][0]

    draw = np.random.default_rng(4)
    pairs = [("".join(draw.choice(list("ABC"), draw.integers(1, 12))), "".join(draw.choice(list("ABC"), draw.integers(1, 7)))) for _ in range(200)] + [("XXXX", "AB")]
    df = spark.createDataFrame([*pairs, (None, "A")], "s string, r string")
    for s, r, t in df.select("s", "r", alignment.trimmed(F.col("s"), F.col("r"))).collect():
        assert t == (plain(s, r) if s else None)


@pytest.mark.parametrize("name", ["choose_chains", "template_verdicts", "sound_templates"])
def test_chains_are_not_broadcast(spark, sf_dir, name):
    from assaylane.plans import catalogue

    plan = catalogue.QUERIES[name](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Broadcast" not in plan

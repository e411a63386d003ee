from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from assaylane.functions import scalars, sequences
from assaylane.operators import dedup, graph, joins, ml, structure
from assaylane.schemas import require_columns
from assaylane.sources import text
from assaylane.streaming import upsert


def resolve(spark, values):
    df = spark.createDataFrame([("k", i, float(v), s) for i, (v, s) in enumerate(values)], "k string, i int, v double, s boolean")
    found = dedup.resolve_duplicates(df, ["k"], "v", "s", [F.asc("i")], tolerance=10.0)
    return [r.verdict for r in found.orderBy("i").collect()]


@pytest.mark.parametrize(
    ("values", "expected"),
    [
        ([(5, False)], ["keep"]),
        ([(5, True), (900, None)], ["keep", "drop"]),
        ([(5, False), (10, False)], ["keep", "drop"]),
        ([(5, False), (50, False)], ["drop", "drop"]),
        ([(5, True), (10, True)], ["drop", "keep"]),
        ([(5, True), (15, True)], ["flag", "flag"]),
        ([(5, True), (10, True), (7, False)], ["keep", "keep", "drop"]),
        ([(1, True), (5, True), (100, True), (6, False)], ["drop", "keep", "drop", "drop"]),
    ],
)
def test_duplicate_rules(spark, values, expected):
    assert resolve(spark, values) == expected


def test_keep_least_keeps_missing(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", 1.0), ("a", 2.0), ("a", None)], "k string, v double")
    assert sorted(str(r.v) for r in dedup.keep_least(df, ["k"], "v").collect()) == ["1.0", "1.0", "None"]


def test_union_override(spark):
    a, b = spark.createDataFrame([(1, "x"), (2, "y")], "k int, v string"), spark.createDataFrame([(2, "z")], "k int, v string")
    assert {r.k: r.v for r in dedup.union_override(a, b, ["k"], [F.desc("v")]).collect()} == {1: "x", 2: "z"}


def test_hamming_pairs_equal_brute_force(spark):
    rng = np.random.default_rng(5)
    words = sorted({"".join(rng.choice(list("ab"), 9)) for _ in range(60)} | {"abc", "abd"})
    found = {(r.a, r.b): r.distance for r in joins.hamming_pairs(spark.createDataFrame([(w,) for w in words], "s string"), "s").collect()}
    expected = {(a, b): d for a in words for b in words if a < b and len(a) == len(b) and (d := sum(x != y for x, y in zip(a, b, strict=True))) <= 2}
    assert found == expected


def test_substring_links_equal_brute_force(spark):
    words = ["abc", "bc", "c", "zabcz", "zz", ""]
    found = {(r.short, r.long) for r in joins.substring_links(spark.createDataFrame([(w,) for w in words], "s string"), "s").collect()}
    assert found == {(a, b) for a in words for b in words if a and a != b and a in b}


def test_components_equal_union_find(spark):
    rng = np.random.default_rng(6)
    edges = [(int(a), int(b)) for a, b in rng.integers(0, 120, (90, 2))] + [(200 + i, 201 + i) for i in range(40)]
    root = {x: x for e in edges for x in e}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        a, b = sorted((find(a), find(b)))
        root[b] = a
    found = {r.node: r.root for r in graph.connected_components(spark.createDataFrame(edges, "a int, b int")).collect()}
    assert found == {x: find(x) for x in root}
    assert graph.connected_components(spark.createDataFrame([], "a int, b int")).count() == 0
    assert graph.connected_components(spark.createDataFrame([(1, 1)], "a int, b int")).first().root == 1


def test_scalars(spark):
    df = spark.createDataFrame([("HLA-A*02:01", "a/b/c.txt", " 22508927.0", "x_y_0001")], "a string, p string, m string, n string")
    c = F.col
    row = df.select(scalars.compact_allele(c("a")), scalars.four_digit_allele(c("a")), scalars.file_safe_allele(c("a")), scalars.last_token(c("p")), scalars.normal_pmid(c("m")), scalars.strip_suffix(c("n")), scalars.before_last(c("n"))).first()
    assert tuple(row) == ("A0201", "A*0201", "HLA-A_02_01", "c.txt", "22508927", "x_y", "x_y")
    assert spark.range(1).select(scalars.normal_pmid(F.lit(None)), scalars.last_token(F.lit("abc")), scalars.to_number(F.lit("abc"))).first()[:] == ("nan", None, None)


def test_anchor_and_one_hot(spark):
    df = spark.createDataFrame([("ACDEFGHIK",), ("ACDEFGHIKLMN",), ("ACDEF",), ("AC",)], "s string")
    assert [r[0] for r in df.select(sequences.anchor9(F.col("s"))).collect()] == ["ACDEFGHIK", "ACDEIKLMN"[:4] + "IKLMN", "ACDEACDEF"[:9], "ACXXXXXXX"]
    assert len(df.select(sequences.one_hot(F.col("s"))).first()[0]) == 180


def test_superposition_undoes_a_rotation():
    rng = np.random.default_rng(7)
    fixed = rng.normal(size=(12, 3))
    turn = np.array([[0.0, -1, 0], [1, 0, 0], [0, 0, 1]])
    rotation, shift = structure.superpose(fixed, fixed @ turn + 5)
    assert structure.rmsd(fixed, (fixed @ turn + 5) @ rotation + shift) < 1e-9
    assert structure.rmsd(fixed, fixed + np.array([1.0, 0, 0])) == pytest.approx(1)


def test_alignment_forms_agree():
    table = structure.substitution()
    assert all(table[a, b] == table[b, a] for a, b in table)
    rng = np.random.default_rng(8)
    pairs = [("".join(rng.choice(list("ACDEFG"), 8)), "".join(rng.choice(list("ACDEFG"), 6))) for _ in range(20)]
    many = structure.align_many([a for a, _ in pairs], [b for _, b in pairs])
    assert many.tolist() == [structure.align(a, b, score=table)[0] for a, b in pairs]
    assert structure.align("ACDEF", "ACEF")[1][0] == (0, 0)


def test_verdicts(spark):
    schema = T.StructType([T.StructField("c", T.MapType(T.StringType(), T.StringType()))])
    rows = [None, {}, {"A": "x" * 180, "B": "PEP", "C": "P"}, {"A": "x" * 180, "Z": "PEP"}, {"A": "x" * 20, "B": "PEPTIDE"}, {"A": "x" * 180, "B": "PEPTIDE"}, {"A": "x" * 180, "B": "PEP"}, {"A": "x" * 180, "B": "PEPTIDEXX"}, {"A": "x" * 180, "B": "PEPTIDX"}]
    df = spark.createDataFrame([(r,) for r in rows], schema)
    assert [r[0] for r in df.select(structure.content_verdict(F.col("c"), F.lit("PEPTIDE"))).collect()] == ["unreadable", "unreadable", "extra_chain", "wrong_chain_ids", "receptor_size", "ok", "truncated_peptide", "peptide_length", "peptide_mismatch"]


def test_group_folds_keep_groups_whole(spark):
    df = spark.createDataFrame([(f"g{i % 17}", i) for i in range(400)], "g string, i int")
    folds = ml.group_folds(df, "g", 5)
    assert folds.count() == 17 and {r.fold for r in folds.collect()} == set(range(5))


def test_grouped_folds_stop_leakage(spark):
    """The target is a function of the group alone: rows split at random see it, groups kept whole don't."""
    rng = np.random.default_rng(9)
    target = rng.normal(size=60)
    df = spark.createDataFrame([(i, float(target[i]), float(i), int(j % 3), int(i % 3)) for i in range(60) for j in range(9)], "g int, target double, x double, naive int, whole int")
    ready = ml.features(df, None, ["x"]).select("features", "target", "naive", "whole")
    r = {f: ml.fold_metrics(ml.out_of_fold(ready, f, "target", range(3), rounds=20, depth=5).withColumn("all", F.lit(1)), "target", ["all"]).first().r for f in ("naive", "whole")}
    assert r["naive"] > 0.6 and r["whole"] < 0.3


def test_require_columns(spark):
    with pytest.raises(ValueError, match="flagged"):
        require_columns(spark.range(1), "id", "flagged")


def test_headers():
    assert text.flatten_header(["Epitope", "", "Assay"], ["Name", "IRI", "Units"]) == ["Epitope | Name", "Epitope | IRI", "Assay | Units"]
    assert text.normal_header([" MHC Allele ", "a/b"]) == ["mhc_allele", "a-b"]


def test_csv_with_two_header_rows(spark, tmp_path):
    (tmp_path / "a.csv").write_text("Epitope,,Assay\nName,IRI,Units\nSIIN,x,nM\nSIIN,x,nM\n")
    df = text.read_csv(spark, str(tmp_path / "a.csv"), header_rows=(0, 1))
    assert df.columns == ["Epitope | Name", "Epitope | IRI", "Assay | Units"] and df.count() == 2


def test_score_files(spark, tmp_path):
    folder = tmp_path / "A0201" / "PEP"
    folder.mkdir(parents=True)
    (folder / "score.sc").write_text("SEQUENCE: x\nSCORE: total I_sc description\nSCORE: 1.5 -2 t1\nSCORE: total I_sc description\nSCORE: 9 t1\nSCORE: 2.5 nan? t1\nSCORE: 3 4 t2\n")
    lines = text.file_lines(spark, str(tmp_path / "*/*/score.sc"))
    found = {r.tag: dict(r.scores) for r in text.parse_scores(lines, ["path"]).collect()}
    assert found == {"t1": {"total": 2.5}, "t2": {"total": 3.0, "I_sc": 4.0}}
    assert text.parse_scores(lines, ["path"], strict=False).count() == 5


def test_fasta_round_trip(spark, tmp_path):
    df = spark.createDataFrame([("a", "SIINFEKL"), ("b", "AC+D")], "n string, s string")
    text.write_fasta(df, "n", "s", str(tmp_path / "out"))
    assert [tuple(r) for r in text.read_fasta(spark, str(tmp_path / "out")).collect()] == [("a", "SIINFEKL")]


def test_atoms_and_chains(spark, tmp_path):
    line = "ATOM  {:>5} {:<4}{}{:<3} {}{:>4}    {:>8.3f}{:>8.3f}{:>8.3f}"
    rows = [line.format(1, " CA", " ", "ALA", "A", 1, 1.0, 2.0, 3.0), line.format(2, " CA", "B", "GLY", "A", 1, 1.0, 2.0, 3.0), line.format(3, " CA", " ", "XYZ", "A", 2, 0, 0, 0), line.format(4, " N", " ", "CYS", "B", 1, 0, 0, 0), line.format(5, " CA", " ", "CYS", "B", 1, 0, 0, 0)]
    (tmp_path / "m.pdb").write_text("HEADER\n" + "\n".join(rows) + "\nEND\n")
    chains = structure.chain_sequences(text.read_atoms(spark, str(tmp_path / "m.pdb")), ["path"])
    assert {r.chain: r.sequence for r in chains.collect()} == {"A": "AX", "B": "C"}


def test_logs_reject_repeated_keys(spark, tmp_path):
    for i in ("1", "2"):
        folder = tmp_path / "A0201" / "PEP" / i
        folder.mkdir(parents=True)
        (folder / "run.log").write_text("using template 1ABC here")
    found = text.scan_logs(spark, str(tmp_path / "A0201/PEP/1/run.log"), r"template (\w+)")
    assert found.first().template == "1ABC"


def test_stream_keeps_the_last(spark, tmp_path):
    spark.createDataFrame([("t", 1, "old"), ("t", 3, "new"), ("u", 2, "x")], "tag string, no int, v string").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("tag string, no int, v string").parquet(str(tmp_path / "in"))
    upsert.start(upsert.latest(stream, ["tag"], "no", ["v"]), "kept_last", str(tmp_path / "ck"))
    assert {r.tag: r.v for r in spark.table("kept_last").collect()} == {"t": "new", "u": "x"}


def test_small_helpers(spark):
    from assaylane.operators import summaries
    from assaylane.schemas import columns_like

    df = spark.createDataFrame([("SIXN", 0.5), ("AAAA", 1.0)], "s string, f double")
    assert [tuple(r) for r in df.select(scalars.mark_residue(F.col("s"), F.lit(2), "NCAA"), scalars.mark_unknown(F.col("s"))).collect()] == [("SI[NCAA]XN", "SIX[NCAA]N"), ("AA[NCAA]AA", "AAAA")]
    assert sorted(r.f for r in summaries.fractions_to_percent(df, "f").collect()) == [50.0, 100.0]
    assert sorted(r.f for r in summaries.fractions_to_percent(df.withColumn("f", F.col("f") * 100), "f").collect()) == [50.0, 100.0]
    assert columns_like(df.withColumn("x_best", F.lit(1)), "x", suffix="_best") == ["x_best"]


def test_members_need_files(spark):
    scores = spark.createDataFrame([("m_1", 1.0), ("m_2", 2.0)], "tag string, total double")
    files = spark.createDataFrame([("/a/m_1.pdb",)], "path string")
    assert joins.attach_members(scores, files, "path", "tag", strict=False).count() == 1
    with pytest.raises(ValueError):
        joins.attach_members(scores, files, "path", "tag")


def test_peptide_moves_with_a_fixed_receptor(spark):
    rng = np.random.default_rng(10)
    receptor, peptide = rng.normal(size=(20, 3)), rng.normal(size=(8, 3))
    turn = np.array([[0.0, -1, 0], [1, 0, 0], [0, 0, 1]])
    flat = lambda x: [float(v) for v in x.ravel()]
    row = (flat(receptor), flat(receptor @ turn + 3), flat(peptide), flat((peptide + np.array([1.0, 0, 0])) @ turn + 3))
    df = spark.createDataFrame([row, (None, None, None, None)], "a array<double>, b array<double>, p array<double>, q array<double>")
    found = [r[0] for r in df.select(structure.peptide_rmsd("a", "b", "p", "q")).collect()]
    assert found[0] == pytest.approx(1) and found[1] is None

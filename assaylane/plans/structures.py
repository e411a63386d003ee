"""Queries over chains of structures that are derived from the tables: parts as entries, embeddings as coordinates."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.sequences import AMINO
from ..operators import superposition
from ..operators.alignment import aligned_places, trimmed
from .registry import query, rounded, table

_CHAINS = """
WITH named AS (SELECT p_partkey, unnest([{'chain': 'A', 'sequence': repeat('G', 160 + p_size % 20)}, {'chain': 'C', 'sequence': repeat('G', 150 + p_size % 30)},
  {'chain': 'P', 'sequence': CASE p_size % 4 WHEN 0 THEN 'SIINFEKL' WHEN 1 THEN 'SIINFEK' WHEN 2 THEN repeat('S', 19) ELSE 'AIINFEKL' END},
  {'chain': 'D', 'sequence': CASE WHEN p_size % 3 = 0 THEN 'QQQQQQQQ' END}]) AS c FROM part),
chains AS (SELECT p_partkey, c.chain AS chain, c.sequence AS sequence, length(c.sequence) AS n FROM named WHERE c.sequence IS NOT NULL)"""


def part_chains(spark, d):
    """Four chains at most for each part: two receptors, a peptide, and a decoy of peptide length."""
    m = lambda k: F.col("p_size") % k
    peptide = F.when(m(4) == 0, "SIINFEKL").when(m(4) == 1, "SIINFEK").when(m(4) == 2, F.repeat(F.lit("S"), 19)).otherwise("AIINFEKL")
    sequences = {"A": F.repeat(F.lit("G"), 160 + m(20)), "C": F.repeat(F.lit("G"), 150 + m(30)), "P": peptide, "D": F.when(m(3) == 0, "QQQQQQQQ")}
    listed = F.array(*[F.struct(F.lit(i).alias("line_no"), F.lit(k).alias("chain"), s.alias("sequence")) for i, (k, s) in enumerate(sequences.items())])
    return table(spark, d, "part").select("p_partkey", F.explode(listed).alias("c")).select("p_partkey", "c.*").where("sequence is not null").withColumn("length", F.length("sequence"))


@query("choose_chains", _CHAINS + """,
exact AS (SELECT p_partkey, min(chain) AS chain, count(*) AS n FROM chains WHERE sequence = 'SIINFEKL' GROUP BY 1),
sized AS (SELECT p_partkey, min(chain) AS chain, count(*) AS n FROM chains WHERE n BETWEEN 7 AND 15 GROUP BY 1),
heavy AS (SELECT p_partkey, chain AS heavy FROM chains WHERE n BETWEEN 170 AND 290 QUALIFY row_number() OVER (PARTITION BY p_partkey ORDER BY n DESC, chain) = 1)
SELECT p.p_partkey, coalesce(e.chain, s.chain) AS peptide_chain, heavy AS heavy_chain, CAST(coalesce(e.n, s.n, 0) AS INTEGER) AS n_candidates,
  CASE WHEN coalesce(e.chain, s.chain) IS NULL THEN 'no peptide chain' WHEN heavy IS NULL THEN 'no heavy chain' ELSE 'ok' END AS verdict
FROM part p LEFT JOIN exact e USING (p_partkey) LEFT JOIN sized s USING (p_partkey) LEFT JOIN heavy USING (p_partkey)""")
def choose_chains(spark, d):
    asked = table(spark, d, "part").select("p_partkey", F.lit("SIINFEKL").alias("peptide"))
    return superposition.choose_chains(part_chains(spark, d), ["p_partkey"], asked, "peptide").drop("peptide")


@query("template_verdicts", _CHAINS + """
SELECT p.p_partkey, c.sequence AS found, CASE WHEN c.sequence IS NULL THEN 'chain missing' WHEN c.sequence = 'SIINFEKL' THEN 'ok' ELSE 'sequence differs' END AS verdict
FROM part p LEFT JOIN chains c ON c.p_partkey = p.p_partkey AND c.chain = CASE WHEN p_size % 5 = 0 THEN 'D' ELSE 'P' END""")
def template_verdicts(spark, d):
    declared = table(spark, d, "part").select("p_partkey", F.when(F.col("p_size") % 5 == 0, "D").otherwise("P").alias("named"), F.lit("SIINFEKL").alias("peptide"))
    return superposition.template_verdicts(declared, part_chains(spark, d), ["p_partkey"], "named", "peptide").select("p_partkey", "found", "verdict")


@query("sound_templates", _CHAINS + " SELECT p_partkey FROM chains WHERE chain = 'P' AND sequence = 'SIINFEKL'")
def sound_templates(spark, d):
    declared = table(spark, d, "part").select("p_partkey", F.lit("P").alias("named"), F.lit("SIINFEKL").alias("peptide"))
    return superposition.sound_templates(declared, part_chains(spark, d), ["p_partkey"], "named", "peptide").select("p_partkey")


def model_pairs(spark, d, *, residues: int = 60, peptide: int = 9):
    """For each vector a model and its experiment: chains whose letters come from the label, with gaps and mutations, and coordinates that the vector turns, shifts and disturbs."""
    e = lambda k: F.element_at("embedding", F.pmod(k, F.lit(64)).cast("int") + 1).cast("double")
    drawn = lambda i, what, n: F.pmod(F.xxhash64("vec_id", i, F.lit(what)), F.lit(n)) == 0
    letter = lambda *of: F.substr(F.lit(AMINO), F.pmod(F.xxhash64(*of), F.lit(20)).cast("int") + 1, F.lit(1))
    place = lambda i, k: F.array(10 * F.cos(i * 1.7 + k * 0.4), 10 * F.sin(i * 1.7 + k * 0.4), i * 1.5 + k)
    turn = lambda p, i: F.array(F.cos(e(F.lit(0))) * p[0] - F.sin(e(F.lit(0))) * p[1] + e(F.lit(1)), F.sin(e(F.lit(0))) * p[0] + F.cos(e(F.lit(0))) * p[1] + e(F.lit(2)) + e(i) * 0.1, p[2] - e(F.lit(3)))
    at = lambda first, n: F.sequence(F.lit(first), F.lit(first + n - 1))
    residue = lambda i: F.struct(letter("label", i).alias("aa"), F.when(drawn(i, "mutated", 25), letter("vec_id", i)).otherwise(letter("label", i)).alias("found"), drawn(i, "missing", 30).alias("gap"), i.alias("i"))
    rows = table(spark, d, "embeddings").withColumns({"heavy": F.transform(at(0, residues), residue), "short": F.transform(at(residues, peptide), residue)})
    there = lambda c: F.filter(c, lambda r: ~r["gap"])
    text = lambda c, name: F.array_join(F.transform(c, lambda r: r[name]), "")
    four = F.array(*[F.lit(k) for k in range(4)])
    lacks = lambda r, k: drawn(r["i"] * 4 + k, "atom", 20)
    ca = lambda c, to: F.flatten(F.transform(c, lambda r: to(place(r["i"], F.lit(1)), r["i"])))
    backbone = lambda c, to: F.flatten(F.transform(c, lambda r: F.transform(four, lambda k: to(place(r["i"], k), r, k))))
    heavy, short = F.col("heavy"), F.col("short")
    return rows.select(
        "vec_id", "label", text(short, "aa").alias("peptide"),
        F.struct(text(there(heavy), "found").alias("ca_sequence"), ca(there(heavy), turn).alias("ca")).alias("m_heavy"),
        F.struct(text(heavy, "aa").alias("ca_sequence"), ca(heavy, lambda p, i: p).alias("ca")).alias("e_heavy"),
        F.struct(text(there(short), "found").alias("sequence"), backbone(there(short), lambda p, r, k: F.when(~lacks(r, k), turn(p, r["i"]))).alias("backbone")).alias("m_peptide"),
        F.struct(text(short, "aa").alias("sequence"), backbone(short, lambda p, r, k: p).alias("backbone")).alias("e_peptide"),
    )


@query("peptide_records")
def peptide_records(spark, d):
    """RMSD record of every model against its experiment; that of its rows which have too few pairs says so."""
    found = superposition.peptide_records(model_pairs(spark, d), "peptide")
    return rounded(found.select("vec_id", "n_pairs", "n_atoms", "n_atoms_dropped", "error", "rmsd", "mhc_alignment_rmsd"), "rmsd", "mhc_alignment_rmsd")


@query("backbone_alignment")
def backbone_alignment(spark, d):
    """How many residues of each model the alignment pairs with equal ones, and its score."""
    rows = model_pairs(spark, d).withColumn("p", aligned_places(F.col("m_heavy.ca_sequence"), F.col("e_heavy.ca_sequence")))
    return rounded(rows.select("vec_id", F.size("p.a").alias("n_equal"), F.col("p.score").alias("score")), "score")


@query("trimmed_windows", """
WITH s AS (SELECT p_partkey, p_name AS seq, substr(p_name, 1 + p_size % 5, 6) AS ref FROM part), k AS (SELECT *, length(seq) AS n, length(ref) AS k FROM s),
w AS (SELECT p_partkey, seq, n, k, i, substr(seq, greatest(i, 0) + 1, least(i + k, n) - greatest(i, 0)) AS win, substr(ref, greatest(-i, 0) + 1, least(i + k, n) - greatest(i, 0)) AS part
  FROM k, unnest(range(-k, n)) AS r(i)),
c AS (SELECT *, len(list_filter(range(1, length(win) + 1), lambda j: substr(win, j, 1) = substr(part, j, 1))) AS hits FROM w),
b AS (SELECT * FROM c QUALIFY row_number() OVER (PARTITION BY p_partkey ORDER BY hits DESC, i) = 1)
SELECT p_partkey, CASE WHEN n <= k THEN seq ELSE win END AS trimmed FROM b""")
def trimmed_windows(spark, d):
    rows = table(spark, d, "part").select("p_partkey", "p_name", F.substr("p_name", 1 + F.col("p_size") % 5, F.lit(6)).alias("ref"))
    return rows.select("p_partkey", trimmed(F.col("p_name"), F.col("ref")).alias("trimmed"))

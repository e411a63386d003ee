"""Queries over short sequences: the words of seven to fifteen letters of the benchmark texts stand in for peptides."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.sequences import anchor9, hamming, one_hot, percent_identity
from ..operators import graph, joins, templates
from .registry import query, rounded, table

_TOKENS = "SELECT DISTINCT s FROM (SELECT unnest(regexp_extract_all(lower(text), '[a-z]+')) AS s FROM benchmark) WHERE length(s) BETWEEN 7 AND 15"


def peptides(spark, d):
    words = F.regexp_extract_all(F.lower("text"), F.lit("[a-z]+"), F.lit(0))
    return table(spark, d, "benchmark").select(F.explode(words).alias("s")).where(F.length("s").between(7, 15)).distinct()


_EDGES = f"WITH RECURSIVE t AS ({_TOKENS}), e AS (SELECT a.s AS a, b.s AS b FROM t a JOIN t b ON length(a.s) = length(b.s) AND a.s < b.s WHERE hamming(a.s, b.s) <= 2 UNION SELECT a.s, b.s FROM t a JOIN t b ON a.s <> b.s AND contains(b.s, a.s))"


@query("percent_identity", f"""
WITH t AS ({_TOKENS}), f AS (SELECT length(s) AS n, min(s) AS ref FROM t GROUP BY 1)
SELECT s, ref, hamming(s, ref) AS distance, round(100.0 * (n - hamming(s, ref)) / n, 6) AS identity FROM t JOIN f ON length(s) = n""")
def identity(spark, d):
    rows = peptides(spark, d)
    ref = rows.groupBy(F.length("s").alias("n")).agg(F.min("s").alias("ref"))
    found = rows.join(ref, F.length("s") == F.col("n"))
    return rounded(found.select("s", "ref", hamming(F.col("s"), F.col("ref")).cast("bigint").alias("distance"), percent_identity(F.col("s"), F.col("ref")).alias("identity")), "identity")


@query("hamming_pairs", f"WITH t AS ({_TOKENS}) SELECT a.s AS a, b.s AS b, hamming(a.s, b.s) AS distance FROM t a JOIN t b ON length(a.s) = length(b.s) AND a.s < b.s WHERE hamming(a.s, b.s) <= 2")
def hamming_pairs(spark, d):
    return joins.hamming_pairs(peptides(spark, d), "s", distance=2).withColumn("distance", F.col("distance").cast("bigint"))


@query("substring_links", f"WITH t AS ({_TOKENS}) SELECT a.s AS short, b.s AS long FROM t a JOIN t b ON a.s <> b.s AND contains(b.s, a.s)")
def substring_links(spark, d):
    return joins.substring_links(peptides(spark, d), "s")


def clusters(spark, d):
    rows = peptides(spark, d)
    near = joins.hamming_pairs(rows, "s", distance=2).select("a", "b")
    inside = joins.substring_links(rows, "s").select(F.col("short").alias("a"), F.col("long").alias("b"))
    alone = rows.select(F.col("s").alias("a"), F.col("s").alias("b"))
    return graph.cluster_ids(graph.connected_components(near.unionByName(inside).unionByName(alone)))


_CLUSTERS = _EDGES + """,
l AS (SELECT a, b FROM e UNION SELECT b, a FROM e UNION SELECT s, s FROM t),
r AS (SELECT a, b FROM l UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a),
c AS (SELECT a AS node, min(b) AS root FROM r GROUP BY 1)"""


@query("similarity_clusters", _CLUSTERS + " SELECT node, root, dense_rank() OVER (ORDER BY root) - 1 AS cluster FROM c")
def similarity_clusters(spark, d):
    return clusters(spark, d)


@query("cluster_diagnostics", _CLUSTERS + """, z AS (SELECT root, count(*) AS size FROM c GROUP BY 1)
SELECT count(*) AS n_clusters, CAST(sum(size) AS BIGINT) AS n_members, max(size) AS largest, round(count(*) FILTER (size = 1) / sum(size), 6) AS alone FROM z""")
def cluster_diagnostics(spark, d):
    return rounded(graph.cluster_diagnostics(clusters(spark, d)), "alone")


@query("topk_similar")
def topk_similar(spark, d):
    """The three best templates of every sequence by BLOSUM62 alignment, itself left out."""
    rows = peptides(spark, d)
    found = templates.top_templates(rows, rows.select("s", F.col("s").alias("name")), "s", "name", "name", k=3, omit_self=True)
    return found.select(F.col("query").alias("s"), "template", "score", "rank")


def document_words(spark, d):
    """The different words of seven to fifteen letters of all whole documents, with the least doc_id that has each."""
    words = F.regexp_extract_all(F.lower("text"), F.lit("[a-z]+"), F.lit(0))
    return table(spark, d, "documents").select("doc_id", F.explode(words).alias("s")).where(F.length("s").between(7, 15)).groupBy("s").agg(F.min("doc_id").alias("doc_id"))


@query("template_search")
def template_search(spark, d):
    """The three best templates, among the words of all documents, of every word that first comes in a document whose doc_id is divisible by 50."""
    words = document_words(spark, d)
    found = templates.top_templates(words.where(F.col("doc_id") % 50 == 0), words.select("s", F.col("s").alias("name")), "s", "name", "name", k=3, omit_self=True)
    return found.select("query", "template", "score", "rank")


@query("ranked_alleles")
def ranked_alleles(spark, d):
    """Parts as alleles and brands as genes: for each part the five first parts of its brand, by alignment of their names without spaces."""
    parts = table(spark, d, "part").select("p_brand", "p_partkey", F.regexp_replace(F.upper("p_name"), "[^A-Z]", "").alias("s"))
    few = joins.top_k_per(parts, ["p_brand"], [F.asc("p_partkey")], 5)
    return templates.ranked_alleles(parts, few, "p_brand", "p_partkey", "s").selectExpr("gene as p_brand", "name as p_partkey", "reference", "score", "rank")


@query("anchor9_onehot", f"""
WITH t AS ({_TOKENS}), x AS (SELECT s, substr(substr(s, 1, 4) || right(s, 5), 1, 9) AS core FROM t)
SELECT s, core, len(list_filter(string_split(upper(core), ''), lambda c: contains('ACDEFGHIKLMNPQRSTVWY', c))) AS n_ones FROM x""")
def anchor9_onehot(spark, d):
    core = anchor9(F.col("s"))
    ones = F.aggregate(one_hot(core), F.lit(0), lambda a, x: a + x)
    return peptides(spark, d).select("s", core.alias("core"), ones.cast("bigint").alias("n_ones"))


@query("sequence_to_alleles", f"""
WITH t AS ({_TOKENS}) SELECT length(s) AS n, count(*) AS n_sequences, string_agg(DISTINCT substr(s, 1, 1), ' ' ORDER BY substr(s, 1, 1)) AS initials FROM t GROUP BY 1""")
def sequence_to_alleles(spark, d):
    initials = F.array_join(F.sort_array(F.collect_set(F.substring("s", 1, 1))), " ")
    return peptides(spark, d).groupBy(F.length("s").cast("bigint").alias("n")).agg(F.count(F.lit(1)).alias("n_sequences"), initials.alias("initials"))

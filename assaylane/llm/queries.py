"""The registered queries of this subpackage and their DuckDB SQL."""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .bpe import decode, encode
from .common import table
from .html import main_text
from .language import fit_languages, identify, remainder
from .lines import drop_duplicate_lines
from .mixing import mix_sources
from .phrases import collocations
from .pii import sanitise
from .quality import quality_verdicts
from .ranked import rank_documents
from .search import search
from .simhash import simhash_components
from .substring import remove_repeats
from .toxicity import fit_toxicity, score_toxicity


def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Copies of documents, sources weighted by the square root of their size."""
    return mix_sources(table(spark, sf_dir, "documents"), alpha=0.5, epochs=1.0, seed=17)


def op2_substring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is left of every document without passages of 50 words that an earlier document has."""
    kept = remove_repeats(table(spark, sf_dir, "documents"), window=50)
    return kept.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


def op3_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Languages of all documents, learned from the four fifths that are not held out."""
    docs = table(spark, sf_dir, "documents")
    model = fit_languages(docs.where(remainder(F.col("doc_id"), 5) != 0))
    found = identify(docs, model)
    return found.select("doc_id", (remainder(F.col("doc_id"), 5) == 0).alias("held_out"), "lang_pred", "score", "mixture")


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of all documents, learned from the labels that are not held out."""
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    mine = remainder(F.col("doc_id"), 4) != 2
    model = fit_toxicity(docs.where(mine), labels.where(mine))
    scored = score_toxicity(docs, model, threshold=0.3)
    return scored.select("doc_id", (remainder(F.col("doc_id"), 4) == 2).alias("held_out"), "score", "predicted")


def op5_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten best documents for every document whose doc_id is divisible by 50, its whole text being the query."""
    docs = table(spark, sf_dir, "documents")
    return search(docs, docs.where(F.col("doc_id") % 50 == 0), k=10)


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and component of every document."""
    found = simhash_components(table(spark, sf_dir, "documents"), width=3, radius=2)
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op7_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document without the lines that repeat an earlier one."""
    kept = drop_duplicate_lines(table(spark, sf_dir, "documents"), threshold=0.8, min_chars=40)
    return kept.select("doc_id", "n_lines", "n_removed", F.sha2("text", 256).alias("kept_sha256"))


@F.pandas_udf(T.StringType())
def ids_digest(ids: pd.Series) -> pd.Series:
    """SHA-256 of ids as little-endian unsigned 32-bit integers."""
    return ids.map(lambda x: hashlib.sha256(np.asarray(x, dtype="<u4").tobytes()).hexdigest())


def encode_public(docs: DataFrame) -> DataFrame:
    """``docs`` with ids, n_tokens, the decoded bytes, and whether these are the text's, by the public vocabulary for many languages."""
    ranks, pattern = public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN
    decoded = decode(encode(docs, ranks, pattern), ranks, pattern)
    same = F.col("decoded") == F.encode(F.coalesce("text", F.lit("")), "UTF-8")
    return decoded.withColumns({"n_tokens": F.size("ids").cast("bigint"), "decodes": same})


def op8_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document encoded and decoded again."""
    found = encode_public(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", "n_tokens", ids_digest("ids").alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Statistics and verdict of every document; the label model is fitted on all of them."""
    judged = quality_verdicts(table(spark, sf_dir, "documents"))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", F.round("quality", 6).alias("quality"))


def op10_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every page."""
    return main_text(table(spark, sf_dir, "pages"))


def op11_ranked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten best documents for every item of ``benchmark``, ranked with the statistics of all documents."""
    return rank_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), k=10)


def op12_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data in every document, and terms that give away whose it is, estimated from all documents."""
    found = sanitise(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", "n_email", "n_ip", "n_card", "n_phone", F.sha2("base", 256).alias("base_sha256"), "spans")


def op13_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first 2,000 phrases of every language, by the score of their weakest cut."""
    return collocations(table(spark, sf_dir, "documents"), min_count=100, max_words=5, top=2000)


QUERIES = {
    "op1_mixing": op1_mixing,
    "op2_substring": op2_substring,
    "op3_language": op3_language,
    "op4_toxicity": op4_toxicity,
    "op5_search": op5_search,
    "op6_simhash": op6_simhash,
    "op7_lines": op7_lines,
    "op8_bpe": op8_bpe,
    "op9_quality": op9_quality,
    "op10_html": op10_html,
    "op11_ranked": op11_ranked,
    "op12_pii": op12_pii,
    "op13_phrases": op13_phrases,
}

SQL = {
    "op13_phrases": """
WITH pieces AS (SELECT doc_id, lang, row_number() OVER () AS piece, regexp_extract_all(p, '[^\\x20\\x09]+') AS w
  FROM (SELECT doc_id, coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\\x0A-\\x0D]')) AS p FROM documents)),
grams AS (SELECT lang, k, list_slice(w, i, i + k - 1) AS g FROM pieces, range(1, 6) AS ks(k), unnest(range(1, len(w) - k + 2)) AS starts(i)),
f AS (SELECT lang, k, array_to_string(g, ' ') AS phrase, g, count(*) AS f FROM grams GROUP BY lang, k, g HAVING count(*) >= 100),
total AS (SELECT lang, CAST(sum(len(w)) AS BIGINT) AS n FROM pieces GROUP BY lang),
cuts AS (SELECT p.lang, p.k, p.phrase, p.g, p.f AS a, t.n, c.cut, x.f AS l, y.f AS r, CAST((1000::HUGEINT * p.f * t.n) // (x.f::HUGEINT * y.f) AS BIGINT) AS score
  FROM f p JOIN total t USING (lang), range(1, 5) AS c(cut), f x, f y
  WHERE p.k >= 2 AND c.cut < p.k AND x.lang = p.lang AND x.phrase = array_to_string(list_slice(p.g, 1, c.cut), ' ') AND y.lang = p.lang AND y.phrase = array_to_string(list_slice(p.g, c.cut + 1, p.k), ' ')),
weakest AS (SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cut) = 1),
held AS (SELECT DISTINCT s.lang, s.phrase FROM f s JOIN f b ON b.lang = s.lang AND b.k > s.k AND b.f >= s.f AND s.k >= 2 AND contains(' ' || b.phrase || ' ', ' ' || s.phrase || ' ')),
ranked AS (SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score
  FROM weakest ANTI JOIN held USING (lang, phrase))
SELECT * FROM ranked WHERE rank <= 2000
""",
    "op11_ranked": """
WITH words AS (SELECT doc_id, translate(t, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS term
  FROM (SELECT doc_id, unnest(regexp_extract_all(text, '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+')) AS t FROM documents)),
asked AS (SELECT DISTINCT item_id, translate(t, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS term
  FROM (SELECT item_id, unnest(regexp_extract_all(text, '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+')) AS t FROM benchmark)),
lengths AS (SELECT doc_id, count(*) AS n FROM words GROUP BY doc_id),
total AS (SELECT count(*) AS n_docs, CAST(sum(n) AS BIGINT) AS n_terms FROM lengths),
tf AS (SELECT doc_id, term, count(*) AS tf FROM words WHERE term IN (SELECT term FROM asked) GROUP BY ALL),
weights AS (SELECT term, CAST(floor(1000 * ln((2.0::DOUBLE * n_docs + 2) / (2 * count(*) + 1))) AS BIGINT) AS w FROM tf, total GROUP BY term, n_docs),
scored AS (SELECT item_id, doc_id, CAST(sum(w * ((1000000000 * tf) // (1000 * tf + 8 * (10 + (90 * n * n_docs) // n_terms)))) AS BIGINT) AS score
  FROM asked JOIN tf USING (term) JOIN weights USING (term) JOIN lengths USING (doc_id), total GROUP BY item_id, doc_id),
ranked AS (SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank, doc_id, score FROM scored WHERE score > 0)
SELECT * FROM ranked WHERE rank <= 10
""",
    "op5_search": """
WITH terms AS (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+')) AS term FROM documents),
tf AS (SELECT doc_id, term, count(*) AS tf FROM terms GROUP BY ALL),
len AS (SELECT doc_id, count(*) AS n FROM terms GROUP BY doc_id),
total AS (SELECT (SELECT count(*) FROM documents) AS docs, (SELECT count(*) FROM terms) AS words),
df AS (SELECT term, count(*) AS df FROM tf GROUP BY term),
scored AS (
  SELECT q.doc_id AS query_id, d.doc_id,
    round(sum(q.tf * ln(1 + (docs - df + 0.5) / (df + 0.5)) * d.tf * 2.2 / (d.tf + 1.2 * (0.25 + 0.75 * n / (words / docs)))), 6) AS score
  FROM tf q JOIN tf d ON q.term = d.term JOIN df ON df.term = q.term JOIN len ON len.doc_id = d.doc_id, total
  WHERE q.doc_id % 50 = 0 GROUP BY ALL),
ranked AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank FROM scored)
SELECT query_id, doc_id, score, rank FROM ranked WHERE rank <= 10
""",
    "op1_mixing": """
WITH sizes AS (SELECT source, CAST(sum(length(coalesce(text, ''))) AS DOUBLE) AS size FROM documents GROUP BY source),
total AS (SELECT sum(size) AS t, sum(CASE WHEN size > 0 THEN sqrt(size) END) AS w FROM sizes),
rates AS (SELECT source, CASE WHEN size > 0 THEN sqrt(size) * t / w / size ELSE 1.0 END AS rate FROM sizes, total),
masses AS (SELECT source, i, sum(exp(i * ln(rate) - rate - lgamma(i + 1))) OVER (PARTITION BY source ORDER BY i) AS bound
  FROM rates, range(0, 200) AS r(i) WHERE rate > 0),
bounds AS (SELECT source, list(bound) AS bounds FROM masses GROUP BY source),
drawn AS (SELECT d.*, CAST(CAST('0x' || substr(md5('17:' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 13) AS BIGINT) AS DOUBLE) / 4503599627370496.0 AS u FROM documents d),
counted AS (SELECT d.* EXCLUDE (u), len(list_filter(b.bounds, lambda x: x <= u)) AS n FROM drawn d JOIN bounds b ON d.source IS NOT DISTINCT FROM b.source)
SELECT * EXCLUDE (n, c), CAST(c AS INTEGER) AS copy,
  CAST('0x' || substr(md5('17-order:' || coalesce(CAST(doc_id AS VARCHAR), '') || ':' || c), 1, 15) AS BIGINT) AS shuffle_key
FROM (SELECT *, unnest(range(1, n + 1)) AS c FROM counted)
""",
}

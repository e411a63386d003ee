"""The corpus pipeline: quality rules, line dedup, near-duplicate removal, source mixing, encoding.

Each stage takes (spark, docs, sf_dir), docs being what the stage before returned, and returns a
DataFrame. All but the last return the columns of ``documents``, and further columns, whatever their names, with their values.
An empty table gives an empty one at every stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from assaylane.llm.common import table
from assaylane.llm.lines import drop_duplicate_lines
from assaylane.llm.mixing import mix_sources
from assaylane.llm.near import keep_one_near
from assaylane.llm.quality import keep_quality
from assaylane.llm.queries import encode_public
from assaylane.storage import cut


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the weighed rules reject go.

    A null or empty text has too few words and goes. Repeated rows are judged alike. A null doc_id, lang or source changes nothing.
    """
    return keep_quality(docs)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that repeat an earlier one, nearly or exactly, go; n_chars follows the text.

    Of equal lines the one of least doc_id and then place stays. A null text, or one that loses all its lines, stays as a null or empty text; rows
    with a null doc_id stay as they are; rows that repeat a doc_id count as one document.
    """
    kept = drop_duplicate_lines(docs, threshold=0.8, min_chars=40, n_lines=None, n_removed=None)
    return kept.select(*[F.length("text").cast(docs.schema["n_chars"].dataType).alias(c) if c == "n_chars" else F.col(f"`{c}`") for c in docs.columns])


def simhash_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates stays: five-word shingles of Jaccard similarity 0.8 or more.

    The one of least doc_id stays, and of rows that repeat it one. Null and empty texts are alike, so one of them stays. Rows with a null doc_id stay.
    """
    return keep_one_near(docs, width=5, threshold=0.8)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources by the square root of their size, documents repeated or left out, in one global shuffle.

    The columns of ``documents`` have no place for the copies' numbers and shuffle keys, so copies are equal rows, and
    their order lies in the written files. A null source is a source like any other; empty texts have size 0.
    """
    return mix_sources(docs, alpha=0.5, epochs=1.0, seed=17).select(*[F.col(f"`{c}`") for c in docs.columns])


def encode_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, source, n_tokens, ids and decodes (whether the ids decode to its text) of every row. A null or empty text has no ids, and it decodes."""
    return encode_public(docs.select("doc_id", "source", "text")).select("doc_id", "source", "n_tokens", "ids", "decodes")


STAGES = [
    ("quality_rules", quality_rules),
    ("line_dedup", line_dedup),
    ("simhash_dedup", simhash_dedup),
    ("mix", mix),
    ("encode_tokens", encode_tokens),
]

#: EM over rule votes, MinHash and SimHash components and BPE merges have no SQL form; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written to the shared folder before the next reads it."""
    docs = table(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = cut(docs)
    return docs

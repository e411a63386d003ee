"""Search reads texts once for all rounds, and its groups, blocks and single precision change no score."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from assaylane.llm import search


def test_texts_are_read_once_for_all_rounds(spark, monkeypatch):
    monkeypatch.setattr(search, "ROUND_TERMS", 20)
    made = spark.sparkContext.accumulator(0)

    @F.udf("string")
    def counted(i):
        made.add(1)
        return f"word{i} word{i % 3} word{i % 7} common"

    df = spark.range(40).select(F.col("id").alias("doc_id"), counted("id").alias("text"))
    found = search.search(df, spark.createDataFrame([(i, f"word{i} word{i % 3} common") for i in range(0, 40, 2)], "doc_id long, text string"), k=3)
    assert found.count() == 60 and made.value == 40


@pytest.mark.parametrize("limits", [(8, 2, 0.0), (64, 5, 2.0), (32, 3, 0.01)])
def test_blocks_change_no_score(monkeypatch, limits):
    """Against sums in double precision: alike and unlike documents, many ties, and a share above one, so that no term is dense."""
    for name, value in zip(("BLOCK_DOCS", "QUERY_ROWS", "DENSE_SHARE"), limits, strict=True):
        monkeypatch.setattr(search, name, value)
    draw = np.random.default_rng(3)
    n, n_terms, k = 90, 40, 4
    table = (draw.random((n, n_terms)) < np.where(np.arange(n)[:, None] % 2 == np.arange(n_terms) % 2, 0.4, 0.02)) * draw.integers(1, 4, (n, n_terms)) / 3
    table[60:70] = table[5]
    asked = table[::6] * 1.7
    row, term = np.nonzero(asked)
    group = np.sort(np.arange(len(asked)) % 3)
    queries = search.Queries(np.arange(len(asked)), np.arange(n_terms).astype(np.uint64), row, term, asked[row, term], group, np.arange(5), np.ones((5, search.GROUPS), np.float32))
    best = search.Best(len(asked), k)
    for lo in range(0, n, limits[0]):
        part = table[lo : lo + limits[0]]
        doc, at = np.nonzero(part)
        search.Block(np.arange(lo, lo + len(part)), doc, at, part[doc, at]).score(queries, best)
    for q, w in enumerate(asked):
        scores = np.round(table @ w, search.PLACES)
        wanted = sorted((-s, d) for d, s in enumerate(scores) if s > 0)[:k]
        assert best.doc[q].tolist()[: len(wanted)] == [d for _, d in wanted]
        assert best.score[q][: len(wanted)] == pytest.approx([-s for s, _ in wanted], abs=1e-9)

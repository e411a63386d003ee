"""Nulls, empty and long texts, repeated rows, empty tables and clashing names, for every operator."""

from __future__ import annotations

import pytest

import public_tokenizers
from assaylane.llm import bpe, html, language, lines, mixing, near, quality, search, simhash, substring, toxicity

RANKS, PATTERN = public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN


def labels(spark):
    return spark.createDataFrame([(4, 1, 1), (5, 1, 0), (5, None, 1), (None, 1, 1), (7, 1, None)], "doc_id long, quality int, toxic int")


OPERATORS = {
    "mixing": lambda spark, d: mixing.mix_sources(d),
    "substring": lambda spark, d: substring.remove_repeats(d, window=50),
    "language": lambda spark, d: language.identify(d, language.fit_languages(d)),
    "toxicity": lambda spark, d: toxicity.score_toxicity(d, toxicity.fit_toxicity(d, labels(spark))),
    "search": lambda spark, d: search.search(d, d, k=3),
    "simhash": lambda spark, d: simhash.simhash_components(d),
    "near_keep": lambda spark, d: near.keep_one_near(d),
    "simhash_keep": lambda spark, d: simhash.keep_one_per_component(d),
    "lines": lambda spark, d: lines.drop_duplicate_lines(d),
    "bpe": lambda spark, d: bpe.decode(bpe.encode(d, RANKS, PATTERN), RANKS, PATTERN),
    "quality": lambda spark, d: quality.quality_verdicts(d),
    "quality_keep": lambda spark, d: quality.keep_quality(d),
}
EVERY_ROW = ["substring", "language", "toxicity", "simhash", "lines", "bpe", "quality"]


@pytest.mark.parametrize("name", OPERATORS)
def test_odd_rows(spark, odd, name):
    found = OPERATORS[name](spark, odd).collect()
    if name in EVERY_ROW:
        assert sorted(str(r.doc_id) for r in found) == sorted(str(r.doc_id) for r in odd.collect())


@pytest.mark.parametrize("name", OPERATORS)
def test_empty_table(spark, odd, name):
    assert OPERATORS[name](spark, odd.where("false")).count() == 0


@pytest.mark.parametrize("name", OPERATORS)
def test_clashing_names(spark, clashing, name):
    """The columns of the input come through with their values, but for those that an operator adds itself, and the result is that without them."""
    found = OPERATORS[name](spark, clashing)
    plain = OPERATORS[name](spark, clashing.select("doc_id", "text", "lang", "source", "n_chars"))
    assert len(found.columns) == len(set(found.columns)) and set(plain.columns) <= set(found.columns)
    own = lambda df: sorted(str([r[c] for c in plain.columns]) for r in df.collect())
    assert own(found) == own(plain)
    assert all(r[c] == 7 for r in found.collect() for c in found.columns if c not in plain.columns)


def test_html_edges(spark):
    pages = spark.createDataFrame([(1, "u", None, "x"), (2, None, "", "x"), (3, "u", "<p>", "x"), (4, "u", "plain words without a tag", "x"), (5, "u", "<div><p>unclosed <a href='x>y'>link" + " w" * 20_000, "x"), (5, "u", "<p>x", "x")], "page_id long, url string, html string, text string")
    found = {(r.page_id, r.n_chars) for r in html.main_text(pages).collect()}
    assert {(1, 0), (2, 0), (3, 0)} <= found and len(found) == 6
    assert html.main_text(pages.where("false")).count() == 0


def test_defined_results(spark, odd):
    by_id = {r.doc_id: r for r in language.identify(odd, language.fit_languages(odd)).collect()}
    assert by_id[1].lang_pred == by_id[2].lang_pred == "und" and by_id[1].score == 0
    kept = {r.doc_id: r for r in quality.quality_verdicts(odd).collect()}
    assert not kept[1].kept and kept[1].n_words == 0 and kept[4].n_words == 30_000
    prints = {r.doc_id: r for r in simhash.simhash_components(odd).collect()}
    assert prints[1].fp == prints[2].fp == prints[3].fp == 0 and {prints[i].component_id for i in (1, 2, 3)} == {1}
    assert prints[5].component_id == prints[7].component_id == 5
    assert {r.doc_id for r in simhash.keep_one_per_component(odd).collect()} == {None, 1, 4, 5, 6, 8}
    assert {r.doc_id: r.text for r in lines.drop_duplicate_lines(odd).collect()}[1] is None

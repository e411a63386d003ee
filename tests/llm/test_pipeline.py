from __future__ import annotations

import corpus_pipeline
from assaylane.llm.simhash import simhash_components
from assaylane.storage import cut


def test_stages_take_effect(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    columns, seen = docs.columns, {}
    for name, stage in corpus_pipeline.STAGES:
        seen[name] = (docs, cut(stage(spark, docs, sf_dir)))
        docs = seen[name][1]
        if name != corpus_pipeline.STAGES[-1][0]:
            assert docs.columns == columns
    before, after = seen["quality_rules"]
    assert 0 < after.count() < before.count()
    assert seen["line_dedup"][1].count() == after.count()
    left = seen["simhash_dedup"][1]
    assert left.count() == simhash_components(seen["line_dedup"][1]).select("component_id").distinct().count()
    assert seen["mix"][1].select("doc_id").distinct().exceptAll(left.select("doc_id")).count() == 0
    assert docs.count() == seen["mix"][1].count() and docs.where("not decodes").count() == 0


def test_odd_rows_pass(spark, odd):
    docs = odd
    for _, stage in corpus_pipeline.STAGES:
        docs = cut(stage(spark, docs, ""))
    docs = odd.where("false")
    for _, stage in corpus_pipeline.STAGES:
        docs = cut(stage(spark, docs, ""))
    assert docs.count() == 0

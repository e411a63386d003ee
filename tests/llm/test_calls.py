from __future__ import annotations

from assaylane.llm import simhash


def test_calls_grow_with_tile_rows(spark):
    sizes = spark.createDataFrame([(100_000,), (2,)], "size long")
    assert simhash.calls_for(sizes) == (100_000 * 196 + 2) // simhash.CALL

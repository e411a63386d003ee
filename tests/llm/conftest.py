from __future__ import annotations

import pytest

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"

#: What operators add or use on the way.
CLASHING = (
    "n_words kept _words size rate copy copy_no shuffle_key n_copies _draw _source _bounds _from _doc _row _copies _first fp root node removed spans anchor score line key "
    "_id _removed _lines _found n_lines n_removed ids n_tokens decoded decodes _statistics quality base_failed component_id doc text_id _text_id label id pos first_id query_id rank"
).split()


@pytest.fixture(scope="session")
def make(spark):
    """Documents from (doc_id, text) or (doc_id, text, lang, source)."""

    def build(*rows):
        full = [(r[0], r[1], *(r[2:] or ("en", "s")), None if r[1] is None else len(r[1])) for r in rows]
        return spark.createDataFrame(full, COLUMNS)

    return build


@pytest.fixture(scope="session")
def odd(make):
    """Nulls in every column, empty and very long texts, ties and repeated rows."""
    long = " ".join(f"word{i % 977}" for i in range(30_000))
    return make((1, None), (2, ""), (3, " \n\t "), (4, long), (4, long), (5, "a b c"), (None, "no id here"), (6, "x" * 5000, None, None), (7, "a b c", None, "s"), (8, "one\x00two \U0001f600 é　ü"))


@pytest.fixture(scope="session")
def clashing(make):
    """Extra columns with names that operators might use themselves."""
    from pyspark.sql import functions as F

    df = make((1, "alpha beta gamma " * 30), (2, "alpha beta gamma " * 30), (3, "other words entirely here"))
    for name in CLASHING:
        df = df.withColumn(name, F.lit(7))
    return df

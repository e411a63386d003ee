from __future__ import annotations

import duckdb
import pytest

import __spark_entry__ as entry
from assaylane.plans import catalogue


def test_entry(spark):
    found = entry.entry(spark)
    assert found.columns == ["p_brand", "n", "rho"] and found.count() > 0


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    for t in "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split():
        con.execute(f"create view {t} as select * from read_parquet('{sf_dir}/{t}.parquet')")
    return con


def plain(rows, columns):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(str([round(r[i], 6) if isinstance(r[i], float) else r[i] for i in order]) for r in rows)


@pytest.mark.parametrize("name", sorted(catalogue.SQL))
def test_query_equals_sql(spark, sf_dir, duck, name):
    found = catalogue.QUERIES[name](spark, sf_dir)
    cursor = duck.execute(catalogue.SQL[name])
    columns = [c[0] for c in cursor.description]
    assert sorted(found.columns) == sorted(columns)
    assert plain([tuple(r) for r in found.collect()], found.columns) == plain(cursor.fetchall(), columns)

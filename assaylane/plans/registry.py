"""The table of registered queries."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}

#: A total order of lineitem: the whole row is unique.
LINE_ORDER = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_shipdate", "l_quantity", "l_discount", "l_tax", "l_returnflag", "l_linestatus"]
LINE_ORDER_SQL = ", ".join(LINE_ORDER)
#: Stand-ins on the driver's tables: quantities are assay values, with these ceilings and floor.
CEILINGS, FLOOR = (10.0, 20.0, 50.0), 50.0
CENSORED_SQL = "(l_quantity IN (10, 20, 50) OR l_quantity >= 50)"


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    """Registers a query, and the DuckDB SQL that gives the same rows."""

    def put(f: Query) -> Query:
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return put


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def rounded(df: DataFrame, *columns: str, places: int = 6) -> DataFrame:
    return df.withColumns({c: F.round(c, places) for c in columns})

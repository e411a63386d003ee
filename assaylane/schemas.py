"""Table schemas and column checks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import types as T

MEASUREMENTS = T.StructType(
    [
        T.StructField("allele", T.StringType()),
        T.StructField("peptide", T.StringType()),
        T.StructField("measurement_type", T.StringType()),
        T.StructField("measurement_value", T.DoubleType()),
        T.StructField("pubmed_id", T.LongType()),
        T.StructField("flagged", T.BooleanType()),
    ]
)
DECOY_SCORES = T.StructType([T.StructField("allele_dir", T.StringType()), T.StructField("peptide", T.StringType()), T.StructField("description", T.StringType()), T.StructField("scores", T.MapType(T.StringType(), T.DoubleType()))])
ATOMS = T.StructType(
    [
        T.StructField("path", T.StringType()),
        T.StructField("chain", T.StringType()),
        T.StructField("resseq", T.IntegerType()),
        T.StructField("icode", T.StringType()),
        T.StructField("resname", T.StringType()),
        T.StructField("atom", T.StringType()),
        T.StructField("x", T.DoubleType()),
        T.StructField("y", T.DoubleType()),
        T.StructField("z", T.DoubleType()),
        T.StructField("line_no", T.LongType()),
    ]
)


def require_columns(df: DataFrame, *columns: str) -> DataFrame:
    """``df``, or an error that names the columns it lacks."""
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise ValueError(f"missing columns: {', '.join(missing)}")
    return df


def columns_like(df: DataFrame, *parts: str, suffix: str = "") -> list[str]:
    """Names that hold one of the parts, or any if none is given, and end in the suffix."""
    return [c for c in df.columns if (not parts or any(p.lower() in c.lower() for p in parts)) and c.endswith(suffix)]

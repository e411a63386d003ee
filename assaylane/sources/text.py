"""Readers of CSV with unusual headers, score files, FASTA, logs and PDB files.

What is parsed stands in lines, so that readers work on any path that Spark can read. Line numbers within a
file come from its whole text, which a file of this kind has in one row.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.scalars import is_number, to_number


def flatten_header(first: Sequence[str], second: Sequence[str], sep: str = " | ") -> list[str]:
    """Names of a two-row header; an empty upper cell repeats the one before it."""
    out, group = [], ""
    for a, b in zip(first, second, strict=True):
        group = a.strip() or group
        out.append(sep.join(x for x in (group, b.strip()) if x))
    return out


def normal_header(names: Sequence[str]) -> list[str]:
    """Small letters, spaces as underscores, slashes as hyphens."""
    return [n.strip().replace(" ", "_").replace("/", "-").lower() for n in names]


def read_csv(spark: SparkSession, path: str, *, header_rows: Sequence[int] = (0,), comment: str | None = None, sep: str = " | ", types: Mapping[str, str] | None = None) -> DataFrame:
    """CSV files whose header is one row, two rows that are joined, or a row further down.

    Names come from the first lines of the first file. Every file loses its own first rows down to the header, by their place, so a data
    row that is equal to a header stays. Columns are strings, but for those with a type in ``types``; what can't be cast is NULL.
    """
    reader = spark.read.option("multiLine", False)
    reader = reader.option("comment", comment) if comment else reader
    above = max(header_rows) + 1
    top = reader.csv(path).limit(above).collect()
    cells = [[c or "" for c in top[i]] for i in header_rows]
    names = cells[0] if len(cells) == 1 else flatten_header(cells[0], cells[1], sep)
    raw = [f"_c{i}" for i in range(len(names))]
    reader = reader.schema(T.StructType([T.StructField(c, T.StringType()) for c in raw]))
    if above == 1:
        rows = reader.option("header", True).option("enforceSchema", True).csv(path)
    else:
        rows = _below_top(reader.csv(path), above).select(*raw)
    return rows.select(*[F.col(c).try_cast((types or {}).get(n, "string")).alias(n) for c, n in zip(raw, names, strict=True)])


def _below_top(rows: DataFrame, above: int) -> DataFrame:
    """``rows`` of files without the first ``above`` of each: rows of a file's first block are numbered in order by the task that reads it."""
    placed = rows.select("*", F.col("_metadata.file_path").alias("_path"), F.col("_metadata.file_block_start").alias("_block"), F.monotonically_increasing_id().alias("_at"))
    first = placed.groupBy("_path").agg(F.min(F.when(F.col("_block") == 0, F.col("_at"))).alias("_first")).withColumnRenamed("_path", "_of")
    return placed.join(first, F.col("_path") == F.col("_of")).where((F.col("_block") > 0) | (F.col("_at") - F.col("_first") >= above))


def file_lines(spark: SparkSession, path: str) -> DataFrame:
    """path, line_no (from 1) and line of every line of the files."""
    whole = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), "value")
    return whole.select("path", F.posexplode(F.split("value", "\r?\n")).alias("_i", "line")).select("path", (F.col("_i") + 1).alias("line_no"), "line")


def path_part(path: Column, from_end: int) -> Column:
    """A part of a path, counted from its end: 0 is the file's name."""
    return F.element_at(F.split(path, "/"), -1 - from_end)


def parse_scores(lines: DataFrame, keys: Sequence[str], *, strict: bool = True) -> DataFrame:
    """tag and scores (name to number) of the ``SCORE:`` lines of each file (``keys``, line_no, line).

    The header is the first SCORE line, in strict mode the first whose first value is no number. Strict: repeated
    headers and lines with another number of values are left out, and the last line of a tag stays. Lenient:
    short lines are padded, long ones cut. What is no number has no score.
    """
    score = lines.where(F.col("line").startswith("SCORE:")).select(*keys, "line_no", F.split(F.trim(F.substring("line", 7, 1 << 30)), r"\s+").alias("cells"))
    heads = score.where(~is_number(F.get("cells", F.lit(0)))) if strict else score
    head = heads.groupBy(*keys).agg(F.min_by("cells", "line_no").alias("names"), F.min("line_no").alias("_head_no"))
    body = score.join(head, list(keys)).where(F.col("line_no") > F.col("_head_no"))
    body = body.where((F.size("cells") == F.size("names")) & (F.col("cells") != F.col("names"))) if strict else body
    width = F.size("names")
    padded = F.slice(F.concat("cells", F.array_repeat(F.lit(""), width)), F.lit(1), width)
    pairs = F.arrays_zip(F.col("names").alias("k"), F.transform(padded, lambda c: c).alias("v"))
    numbers = F.map_from_entries(F.transform(F.filter(pairs, lambda p: is_number(p["v"])), lambda p: F.struct(p["k"], to_number(p["v"]))))
    tagged = body.select(*keys, "line_no", F.get(padded, width - 1).alias("tag"), numbers.alias("scores"))
    if not strict:
        return tagged
    w = Window.partitionBy(*keys, "tag").orderBy(F.desc("line_no"))
    return tagged.withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn")


def read_fasta(spark: SparkSession, path: str) -> DataFrame:
    """name and sequence of each record."""
    records = spark.read.option("lineSep", ">").text(path).where(F.length(F.trim("value")) > 0)
    parts = F.split("value", "\r?\n", 2)
    return records.select(F.trim(F.get(parts, F.lit(0))).alias("name"), F.regexp_replace(F.coalesce(F.get(parts, F.lit(1)), F.lit("")), r"\s", "").alias("sequence"))


def write_fasta(df: DataFrame, name: str, sequence: str, path: str, partition_by: Sequence[str] = ()) -> None:
    text = F.concat(F.lit(">"), F.col(name), F.lit("\n"), F.col(sequence)).alias("value")
    df.where(~F.col(sequence).contains("+")).select(text, *partition_by).write.partitionBy(*partition_by).text(path)


def scan_logs(spark: SparkSession, path: str, pattern: str, *, suffix: str | None = None) -> DataFrame:
    """allele_dir, peptide (from the path) and the first capture of the pattern in each log; a repeated key is an error.

    Logs stand in folders allele/peptide/run, or, with a ``suffix``, flat as files of a peptide's name and the suffix in folders of alleles; other
    files are then left out. Logs without the pattern have no row.
    """
    logs = spark.read.option("recursiveFileLookup", suffix is not None).text(path, wholetext=True)
    where = F.col("_metadata.file_path")
    name = path_part(where, 0)
    if suffix is None:
        places = (path_part(where, 2), path_part(where, 1))
    else:
        logs = logs.where(name.endswith(suffix))
        places = (path_part(where, 1), F.substr(name, F.lit(1), F.length(name) - len(suffix)))
    found = logs.select(places[0].alias("allele_dir"), places[1].alias("peptide"), F.regexp_extract("value", pattern, 1).alias("template")).where("template <> ''")
    if not found.groupBy("allele_dir", "peptide").count().where("count > 1").isEmpty():
        raise ValueError("several logs for one pair")
    return found


def read_atoms(spark: SparkSession, path: str, *, records: Sequence[str] = ("ATOM",)) -> DataFrame:
    """The atoms of PDB files, by their fixed columns: ATOM, and HETATM if it is among ``records``. altloc is empty for atoms with one place."""
    line = F.col("line")
    cell = lambda a, n: F.trim(F.substring(line, a, n))
    return file_lines(spark, path).where(cell(1, 6).isin(*records)).select(
        "path", F.substring(line, 22, 1).alias("chain"), cell(23, 4).cast("int").alias("resseq"), cell(27, 1).alias("icode"), cell(18, 3).alias("resname"), cell(13, 4).alias("atom"),
        to_number(cell(31, 8)).alias("x"), to_number(cell(39, 8)).alias("y"), to_number(cell(47, 8)).alias("z"), "line_no", cell(17, 1).alias("altloc"), cell(1, 6).alias("record"),
    )


def write_csv(df: DataFrame, path: str) -> None:
    """CSV with a header, as many files as the table has partitions."""
    df.write.option("header", True).csv(path)


def write_json(df: DataFrame, path: str) -> None:
    df.write.json(path)


def file_digests(spark: SparkSession, path: str) -> DataFrame:
    """path and SHA-256 of files: witnesses for a promotion."""
    return spark.read.format("binaryFile").load(path).select("path", F.sha2("content", 256).alias("sha256"))

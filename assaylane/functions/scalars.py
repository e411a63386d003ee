"""Spelling of alleles, identifiers and paths, and lenient casts, as columns."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def compact_allele(allele: Column) -> Column:
    """``HLA-A*02:01`` or ``A*02:01`` as ``A0201``."""
    return F.translate(F.regexp_replace(allele, "^HLA-", ""), "*:", "")


def four_digit_allele(allele: Column) -> Column:
    """``A*02:01`` as ``A*0201``."""
    return F.translate(F.regexp_replace(allele, "^HLA-", ""), ":", "")


def file_safe_allele(allele: Column) -> Column:
    """``HLA-A*02:01`` as ``HLA-A_02_01``."""
    return F.translate(allele, ":*", "__")


def two_field_allele(allele: Column) -> Column:
    return F.array_join(F.slice(F.split(allele, ":"), 1, 2), ":")


def locus(allele: Column) -> Column:
    return F.substring(allele, 1, 1)


def normal_pmid(pmid: Column) -> Column:
    """Trimmed, without the ``.0`` of a number once read as a float; missing becomes ``nan`` so that it joins with itself."""
    return F.coalesce(F.regexp_replace(F.trim(pmid.cast("string")), r"\.0$", ""), F.lit("nan"))


def last_token(path: Column) -> Column:
    """What follows the last slash; NULL without one."""
    return F.when(path.contains("/"), F.element_at(F.split(path, "/"), -1))


def first_listed(text: Column, sep: str = ",") -> Column:
    return F.trim(F.get(F.split(text, sep), F.lit(0)))


def strip_suffix(name: Column, suffix: str = "_0001") -> Column:
    return F.regexp_replace(name, f"{suffix}$", "")


def before_last(text: Column, sep: str = "_") -> Column:
    """Up to the last separator; NULL without one."""
    return F.when(text.contains(sep), F.regexp_replace(text, f"\\Q{sep}\\E(?!.*\\Q{sep}\\E).*$", ""))


def to_number(text: Column) -> Column:
    """A double, or NULL for what is no number."""
    return text.try_cast("double")


def to_whole(text: Column) -> Column:
    return text.try_cast("bigint")


def is_number(text: Column) -> Column:
    return text.try_cast("double").isNotNull()


def structure_path(allele_dir: Column, peptide: Column) -> Column:
    return F.concat(F.lit("structures/"), allele_dir, F.lit("/"), F.substring(peptide, 1, 1), F.lit("/"), peptide, F.lit(".silent"))


def redact(text: Column, pairs: Sequence[tuple[str, str]]) -> Column:
    """Literal substitutions, the longest first, so that a path is not hidden by its own prefix."""
    for old, new in sorted(pairs, key=lambda p: -len(p[0])):
        text = F.replace(text, F.lit(old), F.lit(new))
    return text


def p_label(p: Column) -> Column:
    """A p-value for a table: ``< 0.001`` or three places."""
    return F.when(p.isNull(), None).when(p < 0.001, "< 0.001").otherwise(F.format_string("%.3f", p))


def stable_seed(text: Column, modulus: int = 1000) -> Column:
    return F.crc32(text.cast("binary")) % modulus


def mark_residue(sequence: Column, position: Column, name: str) -> Column:
    """The residue at a place (from 1) followed by a bracketed name, as of a modified amino acid."""
    return F.concat(F.substring(sequence, F.lit(1), position), F.lit(f"[{name}]"), F.substring(sequence, position + 1, F.length(sequence)))


def mark_unknown(sequence: Column, name: str = "NCAA") -> Column:
    return F.replace(sequence, F.lit("X"), F.lit(f"X[{name}]"))

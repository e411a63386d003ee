"""Distances and encodings of short sequences as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The twenty amino acids and their three-letter codes.
AMINO = "ACDEFGHIKLMNPQRSTVWY"
THREE_LETTERS = {
    "ALA": "A", "CYS": "C", "ASP": "D", "GLU": "E", "PHE": "F", "GLY": "G", "HIS": "H", "ILE": "I", "LYS": "K", "LEU": "L",
    "MET": "M", "ASN": "N", "PRO": "P", "GLN": "Q", "ARG": "R", "SER": "S", "THR": "T", "VAL": "V", "TRP": "W", "TYR": "Y",
}


def hamming(a: Column, b: Column) -> Column:
    """Places at which two sequences of one length differ; NULL for different lengths."""
    places = F.sequence(F.lit(1), F.length(a))
    differing = F.size(F.filter(places, lambda i: F.substring(a, i, F.lit(1)) != F.substring(b, i, F.lit(1))))
    return F.when(F.length(a) != F.length(b), None).when(F.length(a) == 0, 0).otherwise(differing)


def percent_identity(a: Column, b: Column) -> Column:
    """Equal places in per cent; NULL for different lengths or empty sequences."""
    return F.when(F.length(a) > 0, 100.0 * (F.length(a) - hamming(a, b)) / F.length(a))


def anchor9(sequence: Column) -> Column:
    """Nine places: the first four and the last five; short sequences overlap, or are padded with X."""
    n = F.length(sequence)
    return F.when(n < 5, F.rpad(sequence, 9, "X")).otherwise(F.substring(F.concat(F.substring(sequence, 1, 4), F.right(sequence, F.lit(5))), 1, 9))


def one_hot(sequence: Column, alphabet: str = AMINO) -> Column:
    """An array with a one for each place and letter of the alphabet; letters outside it have none."""
    letters = F.array(*[F.lit(x) for x in alphabet])
    return F.flatten(F.transform(F.split(sequence, ""), lambda c: F.transform(letters, lambda x: F.when(F.upper(c) == x, 1).otherwise(0))))


def one_letter(residue: Column, unknown: str | None = "X") -> Column:
    """Three-letter code to one letter; others become ``unknown``, or NULL."""
    table = F.create_map(*[F.lit(x) for pair in THREE_LETTERS.items() for x in pair])
    return F.coalesce(F.try_element_at(table, residue), F.lit(unknown))


def is_canonical(sequence: Column, low: int = 7, high: int = 15) -> Column:
    return F.coalesce(sequence.rlike(f"^[{AMINO}]{{{low},{high}}}$"), F.lit(False))


def windows(sequence: Column, size: Column) -> Column:
    """All stretches of ``size`` letters."""
    return F.when(F.length(sequence) >= size, F.transform(F.sequence(F.lit(1), F.length(sequence) - size + 1), lambda i: F.substring(sequence, i, size)))

"""Column functions over bases. The order of bases is C < A < T < G, the codes 0 to 3."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def encode(seq: Column) -> Column:
    """Digits 0 to 3, whose order is that of the bases."""
    return F.translate(F.upper(seq), "CATG", "0123")


def decode(digits: Column) -> Column:
    return F.translate(digits, "0123", "CATG")


def complement(seq: Column) -> Column:
    return F.translate(seq, "ACGTacgt", "TGCAtgca")


def revcomp(seq: Column) -> Column:
    return complement(F.reverse(seq))


def canonical(seq: Column) -> Column:
    """The smaller of a sequence and its reverse complement."""
    return F.when(encode(seq) <= encode(revcomp(seq)), seq).otherwise(revcomp(seq))


def windows(seq: Column, size: int) -> Column:
    """All windows of a size, in order; none where the sequence is shorter."""
    some = F.transform(F.sequence(F.lit(1), F.length(seq) - (size - 1)), lambda p: F.substring(seq, p, size))
    return F.when(F.length(seq) >= size, some).otherwise(F.array().cast("array<string>"))


def letters(text: Column) -> Column:
    """The characters of a text; none of an empty one. A split alone leaves an empty part at the end."""
    return F.filter(F.split(text, "(?!^)"), lambda c: c != "")

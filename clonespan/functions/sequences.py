"""Column expressions over nucleotide and amino-acid sequences."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .scalars import col, total

# The standard genetic code, codons enumerated with bases in the order T, C, A, G; '*' is a stop codon.
CODE_BASES = "TCAG"
CODE_RESIDUES = "FFLLSSSSYY**CC*WLLLLPPPPHHQQRRRRIIIMTTTTNNKKSSRRVVVVAAAADDEEGGGG"

# The 20 standard residues and the Kyte-Doolittle hydrophobicity scale.
RESIDUES = "ACDEFGHIKLMNPQRSTVWY"
HYDROPHOBICITY = {
    "A": 1.8, "C": 2.5, "D": -3.5, "E": -3.5, "F": 2.8, "G": -0.4, "H": -3.2, "I": 4.5, "K": -3.9, "L": 3.8,
    "M": 1.9, "N": -3.5, "P": -1.6, "Q": -3.5, "R": -4.5, "S": -0.8, "T": -0.7, "V": 4.2, "W": -0.9, "Y": -1.3,
}
RESIDUE_GROUPS = {"basic": "KRH", "acidic": "DE", "polar": "STNQCY", "nonpolar": "AVLIMFWGP"}

# Reasons why a clone row is rejected, in the order they are tested.
INVALID_REASONS = [
    "malformed_columns",
    "invalid_read_count",
    "invalid_frequency",
    "empty_sequence",
    "length_not_multiple_of_3",
    "non_acgt_base",
    "stop_codon",
]


def normalize_nt(c: str | Column) -> Column:
    return F.translate(F.upper(F.trim(col(c))), "U", "T")


def translate_nt(nt: str | Column) -> Column:
    """Residues of frame 0, one letter per codon.  Meant for ACGT text whose length is a multiple of 3."""
    seq = col(nt)

    def digit(pos: Column) -> Column:
        return F.position(seq.substr(pos, F.lit(1)), F.lit(CODE_BASES)) - 1

    def residue(i: Column) -> Column:
        p = i * 3 - 2
        index = digit(p) * 16 + digit(p + 1) * 4 + digit(p + 2)
        return F.lit(CODE_RESIDUES).substr((index + 1).cast("int"), F.lit(1))

    codons = (F.length(seq) / 3).cast("int")
    letters = F.transform(F.sequence(F.lit(1), codons), residue)
    return F.when(codons >= 1, F.array_join(letters, "")).otherwise(F.lit(""))


def sequence_reason(nt: str | Column, aa: str | Column) -> Column:
    """First failing rule of a normalised sequence, null when it translates."""
    seq = col(nt)
    return (
        F.when(seq.isNull() | (seq == ""), F.lit("empty_sequence"))
        .when(F.length(seq) % 3 != 0, F.lit("length_not_multiple_of_3"))
        .when(~seq.rlike("^[ACGT]+$"), F.lit("non_acgt_base"))
        .when(col(aa).contains("*"), F.lit("stop_codon"))
    )


def is_valid_aa(aa: str | Column, stated_length: str | Column | None = None) -> Column:
    ok = F.coalesce(col(aa).rlike(f"^[{RESIDUES}]+$"), F.lit(False))
    if stated_length is not None:
        ok = ok & F.coalesce(F.length(col(aa)) == col(stated_length), F.lit(False))
    return ok


def distinct_kmers(aa: str | Column, k: int = 3) -> Column:
    """Distinct windows of k letters; empty when the sequence is shorter than k."""
    seq = col(aa)
    windows = F.transform(F.sequence(F.lit(1), F.length(seq) - (k - 1)), lambda i: seq.substr(i, F.lit(k)))
    return F.when(F.length(seq) >= k, F.array_distinct(windows)).otherwise(F.array().cast("array<string>"))


def letter_count(aa: str | Column, letters: str) -> Column:
    """How many letters of the sequence belong to the given set.

    One term per letter, so that a row with many such columns counts each letter once.
    """
    seq = col(aa)
    return total([F.length(seq) - F.length(F.replace(seq, F.lit(r), F.lit(""))) for r in dict.fromkeys(letters)])


def residue_ratio(aa: str | Column, letters: str) -> Column:
    return letter_count(aa, letters) / F.length(col(aa))


def hydrophobicity(aa: str | Column) -> Column:
    parts = [letter_count(aa, r) * F.lit(v) for r, v in HYDROPHOBICITY.items()]
    return total(parts) / F.length(col(aa))


def charge(aa: str | Column) -> Column:
    return (letter_count(aa, "KR") + F.lit(0.1) * letter_count(aa, "H") - letter_count(aa, "DE")) / F.length(col(aa))


def aromaticity(aa: str | Column) -> Column:
    return residue_ratio(aa, "FWY")

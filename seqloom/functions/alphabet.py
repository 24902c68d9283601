"""Alphabets, backgrounds and residue-level Column functions."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

# Residue orders, and the background frequencies of amino acids in that order.
AMINO = "ACDEFGHIKLMNPQRSTVWY"
DNA = "ACGT"
RNA = "ACGU"
AMINO_BACKGROUND = (
    0.0787945, 0.0151600, 0.0535222, 0.0668298, 0.0397062, 0.0695071, 0.0229198, 0.0590092, 0.0594422, 0.0963728,
    0.0237718, 0.0414386, 0.0482904, 0.0395639, 0.0540978, 0.0683364, 0.0540687, 0.0673417, 0.0114135, 0.0304133,
)
# What the ambiguity letters of nucleotides and amino acids stand for.
DNA_AMBIGUOUS = {"R": "AG", "Y": "CT", "M": "AC", "K": "GT", "S": "CG", "W": "AT", "H": "ACT", "B": "CGT", "V": "ACG", "D": "AGT", "N": "ACGT"}
AMINO_AMBIGUOUS = {"B": "DN", "J": "IL", "Z": "EQ", "O": "K", "U": "C", "X": AMINO}

ALPHABETS = {"amino": AMINO, "dna": DNA, "rna": RNA}


def background(alphabet: str) -> np.ndarray:
    letters = ALPHABETS[alphabet]
    f = np.array(AMINO_BACKGROUND) if alphabet == "amino" else np.full(len(letters), 1 / len(letters))
    return f / f.sum()


def letters(text: Column, alphabet: str = "amino") -> Column:
    """A text as residues: letters only, upper-cased after stripping, then those of the alphabet; '' for null."""
    upper = F.upper(F.regexp_replace(F.coalesce(text, F.lit("")), "[^A-Za-z]", ""))
    return F.regexp_replace(upper, f"[^{ALPHABETS[alphabet]}]", "")


def codes(seq: Column, alphabet: str = "amino") -> Column:
    """Residue codes 0..K-1 of a sequence, -1 for other letters."""
    parts = F.filter(F.split(seq, ""), lambda c: c != "")
    return F.transform(parts, lambda c: F.call_function("locate", c, F.lit(ALPHABETS[alphabet])) - 1)


def reverse_complement(seq: Column) -> Column:
    """The other strand of a DNA sequence, ambiguity letters included."""
    return F.reverse(F.translate(seq, "ACGTURYMKSWHBVDN", "TGCAAYRKMSWDVBHN"))


def digitize(seq: str, alphabet: str = "amino") -> np.ndarray:
    """Residue codes of a string; K for ambiguous or unknown ones."""
    table = np.full(256, len(ALPHABETS[alphabet]), np.int64)
    for i, c in enumerate(ALPHABETS[alphabet]):
        table[ord(c)] = table[ord(c.lower())] = i
    return table[np.frombuffer(seq.encode("latin-1", "replace"), np.uint8)]

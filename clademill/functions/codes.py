"""Characters of alignments and their codes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# IUPAC nucleotide characters as masks of A=1, C=2, G=4, T=8; O, N, X, - and ? are undetermined.
DNA = {
    "A": 1, "C": 2, "G": 4, "T": 8, "U": 8, "M": 3, "R": 5, "W": 9, "S": 6, "Y": 10, "K": 12, "V": 7, "H": 11, "D": 13, "B": 14,
    "N": 15, "O": 15, "X": 15, "-": 15, "?": 15,
}
BINARY = {"0": 1, "1": 2, "-": 3, "?": 3}
# Amino acids in the usual order of their codes; B and Z stand for N|D and Q|E.
AMINO = {a: k for k, a in enumerate("ARNDCQEGHILKMFPSTWYV")} | {"B": 20, "Z": 21, "X": 22, "?": 22, "*": 22, "-": 22}
MULTISTATE = {c: k for k, c in enumerate("0123456789ABCDEFGHIJKLMNOPQRSTUV")} | {"?": 32, "-": 32}
TABLES = {"DNA": DNA, "BIN": BINARY, "AA": AMINO, "MULTI": MULTISTATE}
UNDETERMINED = {"DNA": 15, "BIN": 3, "AA": 22, "MULTI": 32}


def code_of(char: Column, data_type: str = "DNA") -> Column:
    """The code of a character, in either case; null for characters that the type doesn't have."""
    pairs = [F.lit(x) for item in TABLES[data_type].items() for x in item]
    return F.try_element_at(F.create_map(*pairs), F.upper(char)).cast("int")


def char_of(code: Column, data_type: str = "DNA") -> Column:
    """The first character that has the code."""
    back: dict[int, str] = {}
    for c, k in TABLES[data_type].items():
        back.setdefault(k, c)
    return F.try_element_at(F.create_map(*[F.lit(x) for item in back.items() for x in item]), code)

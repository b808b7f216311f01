"""Sequence types, their alphabets, and the names of their symbols."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from kmerframe.functions.sequences import ALPHABET, GAPS, NUCLEOTIDES, ONE_HOT_DNA, ONE_HOT_RNA, symbols

DNA, RNA, AMINO_ACID, UNINITIALISED = "dna", "rna", "aa", "uninitialised"

#: What the symbols of RNA stand for (the public IUPAC code). Fixed values.
RNA_NAMES = {
    "A": "Adenine", "C": "Cytosine", "G": "Guanine", "U": "Uracil", "R": "A or G", "Y": "C or U", "S": "G or C", "W": "A or U", "K": "G or U",
    "M": "A or C", "B": "C or G or U", "D": "A or G or U", "H": "A or C or U", "V": "A or C or G", "N": "any base", ".": "gap", "-": "gap",
}
#: Amino acids by their public one-letter code: names and three-letter codes. Fixed values.
AMINO_ACIDS = {
    "A": "Alanine", "C": "Cysteine", "D": "Aspartic Acid", "E": "Glutamic Acid", "F": "Phenylalanine", "G": "Glycine", "H": "Histidine", "I": "Isoleucine",
    "K": "Lysine", "L": "Leucine", "M": "Methionine", "N": "Asparagine", "P": "Proline", "Q": "Glutamine", "R": "Arginine", "S": "Serine",
    "T": "Threonine", "U": "Selenocysteine", "V": "Valine", "W": "Tryptophan", "Y": "Tyrosine",
}
AMINO_ACID_CODES = {
    "A": "Ala", "C": "Cys", "D": "Asp", "E": "Glu", "F": "Phe", "G": "Gly", "H": "His", "I": "Ile", "K": "Lys", "L": "Leu", "M": "Met",
    "N": "Asn", "P": "Pro", "Q": "Gln", "R": "Arg", "S": "Ser", "T": "Thr", "U": "Sec", "V": "Val", "W": "Trp", "Y": "Tyr",
}

DNA_NAMES = {k: v for k, v in NUCLEOTIDES.items() if k != "U"}
NAMES = {DNA: DNA_NAMES, RNA: RNA_NAMES, AMINO_ACID: AMINO_ACIDS}
#: Order of the symbols in a one-hot vector; amino acids have none.
ORDERS = {DNA: ONE_HOT_DNA, RNA: ONE_HOT_RNA}


def _map(values: dict[str, str]) -> Column:
    return F.create_map(*[F.lit(x) for pair in values.items() for x in pair])


def sequence_kind(seq_type: Column) -> Column:
    """dna, rna or aa for a type in any case; uninitialised for null and for others."""
    kind = F.lower(F.trim(seq_type))
    return F.when(kind.isin(DNA, RNA, AMINO_ACID), kind).otherwise(F.lit(UNINITIALISED))


def name_of(symbol: Column, kind: Column) -> Column:
    """What a symbol stands for in sequences of a kind; null for symbols and kinds without a name."""
    return F.coalesce(*[F.when(kind == k, F.element_at(_map(v), symbol)) for k, v in NAMES.items()])


def code_of(symbol: Column, kind: Column) -> Column:
    """The three-letter code of an amino acid; null for other kinds."""
    return F.when(kind == AMINO_ACID, F.element_at(_map(AMINO_ACID_CODES), symbol))


def known_symbols(sequence: Column, kind: Column) -> Column:
    """Number of symbols, in any case, that belong to the alphabet of the kind; null for the kind uninitialised."""
    upper = F.upper(sequence)
    return F.coalesce(*[F.when(kind == k, F.length(F.regexp_replace(upper, "[^" + "".join(v).replace("-", "") + "-]" if "-" in v else "[^" + "".join(v) + "]", ""))) for k, v in NAMES.items()])


def typed_one_hot_positions(sequence: Column, kind: Column) -> Column:
    """Index of each symbol in its one-hot vector in the order of the kind, that of DNA for the kind uninitialised; -1 for unknown and
    lower-case symbols; null for amino acids."""

    def positions(order: str) -> Column:
        at = F.array(*map(F.lit, order))
        return F.transform(symbols(sequence), lambda c: F.when(c.isin(*GAPS), ALPHABET - 1).otherwise(F.array_position(at, c).cast("int") - 1))

    return F.when(kind == RNA, positions(ONE_HOT_RNA)).when(kind.isin(DNA, UNINITIALISED), positions(ONE_HOT_DNA))


def placed_symbols(positions: Column, kind: Column) -> Column:
    """The text of one-hot positions in the order of the kind: gaps as `-`, unknown symbols as `?`."""

    def text(order: str) -> Column:
        letters = F.array(*map(F.lit, order + "-"))
        return F.array_join(F.transform(positions, lambda p: F.when(p < 0, "?").otherwise(F.element_at(letters, p + 1))), "")

    return F.when(kind == RNA, text(ONE_HOT_RNA)).otherwise(text(ONE_HOT_DNA))

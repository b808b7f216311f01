"""Column functions on sequences, k-mer places and vectors, all evaluated in the JVM."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Order of the symbols in a one-hot vector of DNA; index 15 stands for a gap, `.` or `-`. Fixed values.
ONE_HOT_DNA = "ACGTRYSWKMBDHVN"
ONE_HOT_RNA = "ACGURYSWKMBDHVN"
GAPS = ".-"
ALPHABET = 16

#: What the symbols of nucleic acids stand for (the public IUPAC code). Fixed values.
NUCLEOTIDES = {
    "A": "Adenine", "C": "Cytosine", "G": "Guanine", "T": "Thymine", "U": "Uracil", "R": "A or G", "Y": "C or T", "S": "G or C", "W": "A or T", "K": "G or T",
    "M": "A or C", "B": "C or G or T", "D": "A or G or T", "H": "A or C or T", "V": "A or C or G", "N": "any base", ".": "gap", "-": "gap",
}


def _bound(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), with value computed once: as the element of an array, not again for each turn of the loops in body."""
    return F.transform(F.array(value), body)[0]


def kmers(sequence: Column, k: int) -> Column:
    """All windows of k symbols with stride 1, as an array; empty for a shorter or null sequence."""
    starts = F.sequence(F.lit(1), F.length(sequence) - k + 1)
    return F.when(F.length(sequence) >= k, F.transform(starts, lambda i: F.substring(sequence, i, k))).otherwise(F.array().cast("array<string>"))


def symbol_slice(sequence: Column, first: Column | int, last: Column | int) -> Column:
    """Symbols first..last, both included and counted from 0."""
    first = F.lit(first) if isinstance(first, int) else first
    last = F.lit(last) if isinstance(last, int) else last
    return F.substr(sequence, first + 1, last - first + 1)


def one_hot_positions(sequence: Column, alphabet: str = ONE_HOT_DNA) -> Column:
    """Index of each symbol in its one-hot vector; -1 (all zero) for symbols that are unknown or lower-case."""
    return F.transform(symbols(sequence), lambda c: F.when(c.isin(*GAPS), ALPHABET - 1).otherwise(F.array_position(F.array(*map(F.lit, alphabet)), c).cast("int") - 1))


def symbols(sequence: Column) -> Column:
    """The symbols of a sequence as an array; empty for an empty sequence."""
    return F.filter(F.split(sequence, ""), lambda c: c != "")


def one_hot(sequence: Column, alphabet: str = ONE_HOT_DNA) -> Column:
    """Row-major one-hot code: 16 numbers for each symbol, in one flat array."""
    return F.flatten(F.transform(one_hot_positions(sequence, alphabet), lambda p: F.transform(F.sequence(F.lit(0), F.lit(ALPHABET - 1)), lambda j: F.when(j == p, 1).otherwise(0))))


def one_hot_decoded(code: Column, alphabet: str = ONE_HOT_DNA) -> Column:
    """The text of a flat one-hot code; gaps come back as `-` and all-zero rows as `?`."""
    letters = F.array(*map(F.lit, alphabet + "-"))

    def decoded(rows: Column) -> Column:
        def letter(i: Column) -> Column:
            at = F.array_position(F.slice(rows, i * ALPHABET + 1, ALPHABET), 1)
            return F.when(at > 0, F.element_at(letters, at.cast("int"))).otherwise("?")

        return F.when(F.size(rows) > 0, F.array_join(F.transform(F.sequence(F.lit(0), (F.size(rows) / ALPHABET).cast("int") - 1), letter), "")).otherwise("")

    return _bound(code, decoded)


def transposed(code: Column, rows: int, columns: int) -> Column:
    """A flat row-major matrix with rows and columns exchanged."""
    return _bound(code, lambda m: F.flatten(F.transform(F.sequence(F.lit(0), F.lit(columns - 1)), lambda c: F.transform(F.sequence(F.lit(0), F.lit(rows - 1)), lambda r: F.element_at(m, (r * columns + c + 1).cast("int"))))))


def symbol_name(symbol: Column) -> Column:
    """What a symbol of a nucleic acid stands for; null for others."""
    return F.element_at(F.create_map(*[F.lit(x) for pair in NUCLEOTIDES.items() for x in pair]), symbol)


def packed_place(seq_id: Column, off: Column) -> Column:
    """Sequence and offset in one number, 16 bits each; larger ones wrap, so keys of large data use both columns."""
    return F.shiftleft(seq_id.bitwiseAND(F.lit(65535)).cast("long"), 16).bitwiseOR(off.bitwiseAND(F.lit(65535)).cast("long"))


def unpacked_place(place: Column) -> Column:
    """(seq_id, off) of a packed place."""
    return F.struct(F.shiftrightunsigned(place, 16).bitwiseAND(F.lit(65535)).alias("seq_id"), place.bitwiseAND(F.lit(65535)).cast("int").alias("off"))


def dna_of_key(key: Column) -> Column:
    """32 symbols of DNA that any engine derives alike from a key."""
    return F.translate(F.md5(key.cast("string")), "0123456789abcdef", "ACGT" * 4)


def mutated(sequence: Column, place: Column, by: Column) -> Column:
    """The sequence with the symbol at place (from 0) replaced by another of A, C, G, T: the by-th of the other three, from 0."""
    old = F.substr(sequence, place + 1, F.lit(1))
    others = F.regexp_replace(F.lit("ACGT"), old, F.lit(""))
    return F.concat(F.substr(sequence, F.lit(1), place), F.substr(others, by + 1, F.lit(1)), F.substr(sequence, place + 2, F.length(sequence)))


def folded(sequence: Column) -> Column:
    """Upper case with U read as T."""
    return F.translate(F.upper(sequence), "U", "T")


def dot(a: Column, b: Column) -> Column:
    """Inner product in double precision, summed from the first element on."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def normalised(vector: Column) -> Column:
    """x / (|x| + 1e-30); a zero vector stays zero."""
    size = F.sqrt(dot(vector, vector)) + F.lit(1e-30)
    return _bound(size, lambda s: F.transform(vector, lambda x: x.cast("double") / s))


def cosine(a: Column, b: Column) -> Column:
    return F.try_divide(dot(a, b), F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)))


def inner_product_distance(a: Column, b: Column) -> Column:
    return F.lit(1.0) - dot(a, b)


def contrastive_term(y: Column, d: Column, margin: float = 0.25) -> Column:
    """(1 - y) d^2 + y max(margin - d, 0)^2"""
    return (1 - y) * d * d + y * F.pow(F.greatest(F.lit(margin) - d, F.lit(0.0)), 2)


def common_prefix(a: Column, b: Column) -> Column:
    """Number of leading symbols that are equal."""
    n = F.least(F.length(a), F.length(b))
    differ = F.filter(F.sequence(F.lit(1), n), lambda i: F.substring(a, i, 1) != F.substring(b, i, 1))
    return F.when(n > 0, F.coalesce(F.try_element_at(differ, F.lit(1)) - 1, n)).otherwise(0)

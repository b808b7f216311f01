"""Queries on sequences by their type: validation, names of symbols, one-hot codes, and the spectrum of RNA."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kmerframe.functions import alphabets as A
from kmerframe.functions.sequences import symbols
from kmerframe.operators import reads as R
from kmerframe.operators.embedding import SpectrumEmbedder
from kmerframe.plans.reads import K, reads_once
from kmerframe.plans.registry import query
from kmerframe.plans.vectors import _GRAMS, spectrum_places
from kmerframe.runtime import fanned, table


def typed_reads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(seq_id, sequence, kind): the reads, each once."""
    reads = table(spark, sf_dir, "reads")
    one = F.min(F.struct("sequence", A.sequence_kind(F.col("seq_type")).alias("kind"))).alias("r")
    rows = reads.where("seq_id IS NOT NULL AND sequence IS NOT NULL").groupBy("seq_id").agg(one).select("seq_id", "r.sequence", "r.kind")
    return fanned(rows, reads, "seq_id")


TYPED = f"""typed AS (
  SELECT seq_id, r.s AS sequence, r.k AS kind FROM (
    SELECT seq_id, min(struct_pack(s := sequence, k := CASE WHEN lower(trim(seq_type)) IN ('{A.DNA}', '{A.RNA}', '{A.AMINO_ACID}') THEN lower(trim(seq_type)) ELSE '{A.UNINITIALISED}' END)) AS r
    FROM reads WHERE seq_id IS NOT NULL AND sequence IS NOT NULL GROUP BY seq_id))"""


def _known(kind: str, symbols_: str) -> str:
    return f"WHEN kind = '{kind}' THEN length(regexp_replace(upper(sequence), '[^{symbols_}]', '', 'g'))"


_KNOWN = f"CASE {_known(A.DNA, 'ACGTRYSWKMBDHVN.-')} {_known(A.RNA, 'ACGURYSWKMBDHVN.-')} {_known(A.AMINO_ACID, ''.join(A.AMINO_ACIDS))} END"


@query("typed_sequences", f"WITH {TYPED}, k AS (SELECT seq_id, kind, length(sequence) AS len, {_KNOWN} AS known FROM typed) SELECT *, known = len AS valid FROM k")
def typed_sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Type, length, symbols of the type's alphabet, and whether all symbols are; null where the type is not known."""
    rows = typed_reads(spark, sf_dir).select("seq_id", "kind", F.length("sequence").alias("len"), A.known_symbols(F.col("sequence"), F.col("kind")).alias("known"))
    return rows.withColumn("valid", F.col("known") == F.col("len"))


def _cases(values: dict[str, str]) -> str:
    return " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in values.items())


_TYPED_NAMES = " ".join(f"WHEN kind = '{kind}' THEN CASE symbol {_cases(names)} END" for kind, names in A.NAMES.items())


@query("typed_symbol_names", f"""
WITH {TYPED}, s AS (SELECT kind, unnest(string_split(sequence, '')) AS symbol FROM typed)
SELECT kind, symbol, CASE {_TYPED_NAMES} END AS name, CASE WHEN kind = '{A.AMINO_ACID}' THEN CASE symbol {_cases(A.AMINO_ACID_CODES)} END END AS code, count(*) AS n FROM s WHERE symbol <> '' GROUP BY ALL
""")
def typed_symbol_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    counted = typed_reads(spark, sf_dir).select("kind", F.explode(symbols(F.col("sequence"))).alias("symbol")).groupBy("kind", "symbol").agg(F.count("*").alias("n"))
    return counted.select("kind", "symbol", A.name_of(F.col("symbol"), F.col("kind")).alias("name"), A.code_of(F.col("symbol"), F.col("kind")).alias("code"), "n")


def _decoded(order: str) -> str:
    return f"regexp_replace(regexp_replace(sequence, '[^{order}.-]', '?', 'g'), '[.]', '-', 'g')"


@query("one_hot_by_type", f"""
WITH {TYPED}, d AS (SELECT seq_id, kind, CASE WHEN kind = '{A.RNA}' THEN {_decoded("ACGURYSWKMBDHVN")} ELSE {_decoded("ACGTRYSWKMBDHVN")} END AS decoded FROM typed WHERE kind <> '{A.AMINO_ACID}')
SELECT seq_id, kind, length(replace(decoded, '?', '')) AS known, decoded FROM d
""")
def one_hot_by_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole read through its one-hot places in the order of its type, and back."""
    rows = typed_reads(spark, sf_dir).where(F.col("kind") != A.AMINO_ACID)
    rows = rows.select("seq_id", "kind", A.typed_one_hot_positions(F.col("sequence"), F.col("kind")).alias("p"))
    return rows.select("seq_id", "kind", F.size(F.filter("p", lambda x: x >= 0)).alias("known"), A.placed_symbols(F.col("p"), F.col("kind")).alias("decoded"))


_COUNTS = ", ".join(f"len(list_filter(range(1, length(t)), lambda i: substr(t, i, 2) = '{g}'))" for g in _GRAMS)


@query("rna_spectrum", f"""
WITH {TYPED}, k AS (SELECT DISTINCT substr(sequence, i + 1, {K}) AS kmer FROM typed, LATERAL (SELECT unnest(range(0, length(sequence) - {K - 1})) AS i) WHERE kind = '{A.RNA}'),
c AS (SELECT kmer, [{_COUNTS}]::DOUBLE[] AS v FROM (SELECT kmer, translate(kmer, 'U', 'T') AS t FROM k))
SELECT kmer, i AS gram, round(v[i + 1] / sqrt(list_dot_product(v, v)), 4) AS value FROM c, range(16) r(i) WHERE v[i + 1] > 0
""")
def rna_spectrum(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Non-zero places of the 2-gram spectrum of each distinct k-mer of the reads of RNA."""
    kmers = R.windows(typed_reads(spark, sf_dir).where(F.col("kind") == A.RNA), K).select("kmer").distinct()
    return spectrum_places(SpectrumEmbedder(2)(kmers))


@query("kmer_representative_lookup", f"""
WITH {TYPED}, w AS (SELECT seq_id, i::INT AS off, substr(sequence, i + 1, {K}) AS kmer FROM typed, LATERAL (SELECT unnest(range(0, length(sequence) - {K - 1})) AS i)),
first AS (SELECT kmer, min(struct_pack(s := seq_id, o := off)) AS f FROM w GROUP BY kmer),
told AS (SELECT vec_id, min(kmer) AS kmer, min(struct_pack(s := repr.seq_id, o := repr.off)) AS r FROM kmer_embeddings WHERE vec_id IS NOT NULL AND kmer IS NOT NULL GROUP BY vec_id)
SELECT vec_id, coalesce(f.s, r.s) AS seq_id, coalesce(f.o, r.o) AS off, f IS NOT NULL AS found FROM told LEFT JOIN first USING (kmer)
""")
def kmer_representative_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The representative of each recorded k-mer: the first place of its text in the reads, or the place recorded with it."""
    first = R.representatives(R.windows(reads_once(spark, sf_dir), K))
    told = table(spark, sf_dir, "kmer_embeddings").where("vec_id IS NOT NULL AND kmer IS NOT NULL").groupBy("vec_id").agg(F.min("kmer").alias("kmer"), F.min(F.struct("repr.seq_id", "repr.off")).alias("r"))
    return R.represented(told.select("vec_id", "kmer", "r.seq_id", "r.off"), first).select("vec_id", "seq_id", "off", "found")

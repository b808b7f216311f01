"""Queries on records, reads and their k-mers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kmerframe.functions import sequences as S
from kmerframe.operators import reads as R
from kmerframe.operators.documents import shingles
from kmerframe.plans.registry import query
from kmerframe.plans.sql import ONCE
from kmerframe.runtime import ensure_checkpoint_dir, fanned, table
from kmerframe.sources.fasta import read_fasta, write_fasta

K = 16


def reads_once(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(seq_id, sequence) of the reads, each once."""
    reads = table(spark, sf_dir, "reads")
    return fanned(reads.where("seq_id IS NOT NULL AND sequence IS NOT NULL").groupBy("seq_id").agg(F.min("sequence").alias("sequence")), reads, "seq_id")


RECORDS = "recs AS (SELECT path, ordinal, arg_max(data, loaded_at) AS data, max(loaded_at) AS loaded_at FROM fasta_records GROUP BY path, ordinal)"


@query("read_dedup_instances", f"""
WITH {RECORDS}
SELECT data AS sequence, count(*) AS instances, min(struct_pack(p := path, o := ordinal)).p AS path, min(struct_pack(p := path, o := ordinal)).o AS ordinal
FROM recs WHERE data <> '' GROUP BY data
""")
def read_dedup_instances(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.deduplicated(R.distinct_records(table(spark, sf_dir, "fasta_records")))


@query("read_dense_ids", f"""
WITH {RECORDS}, uniq AS (SELECT data AS sequence, min(struct_pack(p := path, o := ordinal)) AS f FROM recs WHERE data <> '' GROUP BY data)
SELECT sequence, row_number() OVER (ORDER BY f.p, f.o) AS seq_id FROM uniq
""")
def read_dense_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.deduplicated(R.distinct_records(table(spark, sf_dir, "fasta_records")), dense=True).select("sequence", "seq_id")


@query("read_instances_checked", f"""
WITH {RECORDS}, uniq AS (SELECT data AS sequence, count(*) AS n FROM recs WHERE data <> '' GROUP BY data),
told AS (SELECT seq_id, min(sequence) AS sequence, max(instances) AS instances FROM reads WHERE sequence IS NOT NULL AND sequence <> '' GROUP BY seq_id)
SELECT seq_id, instances, n AS counted, coalesce(instances = n, false) AS agrees FROM told LEFT JOIN uniq USING (sequence)
""")
def read_instances_checked(spark: SparkSession, sf_dir: str) -> DataFrame:
    counted = R.deduplicated(R.distinct_records(table(spark, sf_dir, "fasta_records"))).select("sequence", F.col("instances").alias("counted"))
    told = table(spark, sf_dir, "reads").where("sequence <> ''").groupBy("seq_id").agg(F.min("sequence").alias("sequence"), F.max("instances").alias("instances"))
    return told.join(counted, "sequence", "left").select("seq_id", "instances", "counted", F.coalesce(F.col("instances") == F.col("counted"), F.lit(False)).alias("agrees"))


@query("kmer_representatives", f"""
WITH {ONCE}, w AS (SELECT seq_id, i::INT AS off, substr(sequence, i + 1, {K}) AS kmer FROM once, LATERAL (SELECT unnest(range(0, length(sequence) - {K - 1})) AS i))
SELECT kmer, min(struct_pack(s := seq_id, o := off)).s AS seq_id, min(struct_pack(s := seq_id, o := off)).o AS off, count(*) AS multiplicity FROM w GROUP BY kmer HAVING count(*) > 1
""")
def kmer_representatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """k-mers that stand in several places, with their first one."""
    return R.representatives(R.windows(reads_once(spark, sf_dir), K)).where("multiplicity > 1")


@query("kmer_representatives_whole", f"""
WITH {ONCE}, w AS (SELECT seq_id, i::INT AS off, substr(sequence, i + 1, {K}) AS kmer FROM once, LATERAL (SELECT unnest(range(0, length(sequence) - {K - 1})) AS i))
SELECT kmer, min(struct_pack(s := seq_id, o := off)).s AS seq_id, min(struct_pack(s := seq_id, o := off)).o AS off, count(*) AS multiplicity FROM w GROUP BY kmer
""")
def kmer_representatives_whole(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All k-mers with their first place, those of one place included; kmer_representatives gives repeated ones only."""
    return R.representatives(R.windows(reads_once(spark, sf_dir), K))


@query("kmer_text_at_place", f"""
WITH {ONCE}, v AS (SELECT vec_id, min(repr.seq_id) AS seq_id, min(repr.off) AS off FROM kmer_embeddings GROUP BY vec_id)
SELECT vec_id, v.seq_id, off, substr(sequence, off + 1, {K}) AS kmer FROM v LEFT JOIN once ON once.seq_id = v.seq_id
""")
def kmer_text_at_place(spark: SparkSession, sf_dir: str) -> DataFrame:
    places = table(spark, sf_dir, "kmer_embeddings").groupBy("vec_id").agg(F.min("repr.seq_id").alias("seq_id"), F.min("repr.off").alias("off"))
    return R.text_at(places, reads_once(spark, sf_dir), K).select("vec_id", "seq_id", "off", "kmer")


@query("one_hot_roundtrip", f"""
WITH {ONCE}
SELECT seq_id, length(regexp_replace(sequence, '[^ACGTRYSWKMBDHVN.-]', '', 'g')) AS known, length(sequence) * 16 AS cells,
  regexp_replace(regexp_replace(substr(sequence, 1, 64), '[^ACGTRYSWKMBDHVN.-]', '?', 'g'), '[.]', '-', 'g') AS decoded
FROM once WHERE sequence <> ''
""")
def one_hot_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Known symbols, cells, and what comes back from the code of the first window of 64."""
    reads = reads_once(spark, sf_dir).where("sequence <> ''").withColumn("p", S.one_hot_positions(F.col("sequence")))
    reads = reads.withColumn("code", S.one_hot(F.substring("sequence", 1, 64)))
    return reads.select("seq_id", F.size(F.filter("p", lambda x: x >= 0)).alias("known"), (F.size("p") * 16).alias("cells"), S.one_hot_decoded(F.col("code")).alias("decoded"))


@query("one_hot_roundtrip_whole", f"""
WITH {ONCE}
SELECT seq_id, length(regexp_replace(sequence, '[^ACGTRYSWKMBDHVN.-]', '', 'g')) AS known, length(sequence) * 16 AS cells,
  regexp_replace(regexp_replace(sequence, '[^ACGTRYSWKMBDHVN.-]', '?', 'g'), '[.]', '-', 'g') AS decoded
FROM once WHERE sequence <> ''
""")
def one_hot_roundtrip_whole(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Known symbols, cells, and what comes back from the code of the whole read; one_hot_roundtrip codes its first 64 symbols only."""
    reads = reads_once(spark, sf_dir).where("sequence <> ''").withColumn("p", S.one_hot_positions(F.col("sequence")))
    decoded = S.one_hot_decoded(S.one_hot(F.col("sequence")))
    return reads.select("seq_id", F.size(F.filter("p", lambda x: x >= 0)).alias("known"), (F.size("p") * 16).alias("cells"), decoded.alias("decoded"))


@query("one_hot_transposed", """
WITH k AS (SELECT DISTINCT kmer FROM kmer_embeddings WHERE kmer IS NOT NULL)
SELECT kmer, i AS symbol, string_agg(CASE WHEN substr(kmer, j + 1, 1) = substr('ACGT', i + 1, 1) THEN '1' ELSE '0' END, '' ORDER BY j) AS places FROM k, range(4) a(i), range(16) b(j) GROUP BY kmer, i
""")
def one_hot_transposed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each distinct k-mer of 16 symbols and each base, the places where it stands: rows of the transposed one-hot code."""
    kmers = table(spark, sf_dir, "kmer_embeddings").select("kmer").where("length(kmer) = 16").distinct().withColumn("code", S.one_hot(F.col("kmer")))
    turned = kmers.select("kmer", S.transposed(F.col("code"), 16, 16).alias("t"))
    return turned.select("kmer", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(3).cast("long"))).alias("symbol"), "t").select("kmer", "symbol", F.array_join(F.slice("t", (F.col("symbol") * 16 + 1).cast("int"), 16).cast("array<string>"), "").alias("places"))


@query("symbol_composition", f"""
WITH {ONCE}, s AS (SELECT unnest(string_split(sequence, '')) AS symbol FROM once)
SELECT symbol, count(*) AS n FROM s WHERE symbol <> '' GROUP BY symbol
""")
def symbol_composition(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reads_once(spark, sf_dir).select(F.explode(S.symbols(F.col("sequence"))).alias("symbol")).groupBy("symbol").agg(F.count("*").alias("n"))


_NAMES = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in S.NUCLEOTIDES.items())


@query("symbol_names", f"WITH {ONCE}, s AS (SELECT DISTINCT unnest(string_split(sequence, '')) AS symbol FROM once) SELECT symbol, CASE symbol {_NAMES} END AS name FROM s WHERE symbol <> ''")
def symbol_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    return symbol_composition(spark, sf_dir).select("symbol", S.symbol_name(F.col("symbol")).alias("name"))


@query("place_pack_unpack", """
SELECT l_orderkey AS seq_id, l_linenumber AS off, ((l_orderkey & 65535) << 16) | (l_linenumber & 65535) AS packed, l_orderkey & 65535 AS seq_back, l_linenumber & 65535 AS off_back FROM lineitem
""")
def place_pack_unpack(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("seq_id"), F.col("l_linenumber").alias("off")).withColumn("packed", S.packed_place(F.col("seq_id"), F.col("off")))
    back = S.unpacked_place(F.col("packed"))
    return rows.select("seq_id", "off", "packed", back["seq_id"].alias("seq_back"), back["off"].alias("off_back"))


@query("slice_phase_shift", f"""
WITH {ONCE}
SELECT seq_id, seq_id % 8 AS phase, substr(sequence, 21, 20) AS anchor, substr(sequence, 21 + (seq_id % 8)::INT, 20) AS shifted, reverse(substr(sequence, 21, 20)) AS backwards FROM once WHERE length(sequence) >= 60
""")
def slice_phase_shift(spark: SparkSession, sf_dir: str) -> DataFrame:
    reads = reads_once(spark, sf_dir).where(F.length("sequence") >= 60)
    phase = F.col("seq_id") % 8
    anchor = S.symbol_slice(F.col("sequence"), 20, 39)
    shifted = S.symbol_slice(F.col("sequence"), (20 + phase).cast("int"), (39 + phase).cast("int"))
    return reads.select("seq_id", phase.alias("phase"), anchor.alias("anchor"), shifted.alias("shifted"), F.reverse(anchor).alias("backwards"))


@query("snp_mutated", """
WITH k AS (SELECT vec_id, min(kmer) AS kmer FROM kmer_embeddings GROUP BY vec_id), m AS (SELECT *, (vec_id % 16)::INT AS place, (vec_id % 3)::INT AS by_ FROM k)
SELECT vec_id, substr(kmer, 1, place) || substr(replace('ACGT', substr(kmer, place + 1, 1), ''), by_ + 1, 1) || substr(kmer, place + 2) AS mutant FROM m
""")
def snp_mutated(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = table(spark, sf_dir, "kmer_embeddings").groupBy("vec_id").agg(F.min("kmer").alias("kmer"))
    return k.select("vec_id", S.mutated(F.col("kmer"), (F.col("vec_id") % 16).cast("int"), (F.col("vec_id") % 3).cast("int")).alias("mutant"))


@query("fasta_roundtrip", f"""
WITH {RECORDS.replace("arg_max(data, loaded_at) AS data", "arg_max(data, loaded_at) AS data, arg_max(coalesce(description, ''), loaded_at) AS description")}
SELECT path || '/' || ordinal AS name, trim(regexp_replace(description, '\\s+', ' ', 'g'), ' ') AS description, replace(data, chr(10), '') AS data FROM recs WHERE data <> ''
""")
def fasta_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records written as FASTA into the shared folder and read back."""
    return written_and_read(spark, R.distinct_records(table(spark, sf_dir, "fasta_records")).where("data <> ''"))


@query("fasta_roundtrip_whole", f"""
WITH {RECORDS.replace("arg_max(data, loaded_at) AS data", "arg_max(data, loaded_at) AS data, arg_max(coalesce(description, ''), loaded_at) AS description")}
SELECT path || '/' || ordinal AS name, trim(regexp_replace(description, '\\s+', ' ', 'g'), ' ') AS description, replace(coalesce(data, ''), chr(10), '') AS data FROM recs
""")
def fasta_roundtrip_whole(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All records written and read back, headers without data included; fasta_roundtrip leaves those out."""
    return written_and_read(spark, R.distinct_records(table(spark, sf_dir, "fasta_records")), last_empty=True)


def written_and_read(spark: SparkSession, rows: DataFrame, last_empty: bool = False) -> DataFrame:
    """(name, description, data) of records, by way of FASTA files."""
    ensure_checkpoint_dir(spark)
    rows = rows.select(
        F.concat_ws("/", "path", "ordinal").alias("name"), F.trim(F.regexp_replace(F.coalesce("description", F.lit("")), "\\s+", " ")).alias("description"), F.regexp_replace(F.coalesce("data", F.lit("")), "\n", "").alias("data")
    )
    folder = spark.sparkContext._jsc.sc().getCheckpointDir().get() + "/fasta-" + spark._jvm.java.util.UUID.randomUUID().toString()
    write_fasta(rows, folder)
    return read_fasta(spark, folder, last_empty=last_empty).select("name", "description", "data")


@query("document_shingles", """
WITH w AS (SELECT doc_id, lower(text) AS t FROM documents WHERE text IS NOT NULL),
s AS (SELECT unnest(string_split(t, '')) AS c, doc_id FROM w)
SELECT c AS symbol, count(*) AS n, count(DISTINCT doc_id) AS documents FROM s WHERE regexp_full_match(c, '[a-z0-9 ]') GROUP BY c
""")
def document_shingles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Letters, digits and blanks of all documents, with the number of their documents; counted per document first."""
    rows = table(spark, sf_dir, "documents").where("text IS NOT NULL").select("doc_id", F.explode(F.split(F.regexp_replace(F.lower("text"), "[^a-z0-9 ]", ""), "")).alias("symbol")).where("symbol <> ''")
    return rows.groupBy("doc_id", "symbol").agg(F.count("*").alias("k")).groupBy("symbol").agg(F.sum("k").alias("n"), F.count("*").alias("documents"))


@query("document_shingles_whole", """
WITH w AS (SELECT doc_id, lower(text) AS t FROM documents WHERE text IS NOT NULL),
s AS (SELECT doc_id, unnest(list_transform(range(1, length(t) - 3), lambda i: substr(t, i, 5))) AS shingle FROM w WHERE length(t) >= 5)
SELECT shingle, count(*) AS n, count(DISTINCT doc_id) AS documents FROM s GROUP BY shingle
""")
def document_shingles_whole(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All windows of 5 characters of the lower-cased documents, every symbol kept; document_shingles counts single symbols only."""
    return shingles(table(spark, sf_dir, "documents").select("doc_id", F.lower("text").alias("text")), 5)

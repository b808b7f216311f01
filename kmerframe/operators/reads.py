"""Reads from records: exact deduplication with multiplicities, k-mers, representatives."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Offsets are below this number.
_PLACES = 1 << 31


def distinct_records(records: DataFrame) -> DataFrame:
    """Records once per (path, ordinal): the one loaded last. A key that is null counts as a key of its own."""
    # combined before the shuffle, so a record that was loaded very often costs one row per task
    last = F.max(F.struct("loaded_at", "data", "name", "description")).alias("r")
    return records.groupBy("path", "ordinal").agg(last).select("path", "ordinal", "r.name", "r.description", "r.data", "r.loaded_at")


def deduplicated(records: DataFrame, dense: bool = False) -> DataFrame:
    """(sequence, instances, path, ordinal): each text once, exact and case-sensitive, with the number of its records and its
    first place. Null and empty data give no read. dense adds seq_id 1, 2, ... in order of first places; the numbers come from
    counts per partition, so no task sees all rows."""
    first = F.min(F.struct("path", "ordinal")).alias("first")
    reads = records.where("data <> ''").groupBy(F.col("data").alias("sequence")).agg(F.count("*").alias("instances"), first).select("sequence", "instances", "first.path", "first.ordinal")
    return numbered(reads, ["path", "ordinal"], "seq_id") if dense else reads


def numbered(df: DataFrame, by: list[str], name: str) -> DataFrame:
    """df with numbers 1, 2, ... in the order of `by`, which must be unique: ranges of rows are numbered side by side and shifted
    by the sizes of the ranges before them (one row per range)."""
    from kmerframe.runtime import cut, shuffle_width

    ranged = cut(df.repartitionByRange(shuffle_width(df.sparkSession), *by).sortWithinPartitions(*by).withColumn("_part", F.spark_partition_id()).withColumn("_in", F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))))
    sizes = ranged.groupBy("_part").agg(F.count("*").alias("_n"))
    before = sizes.select("_part", (F.sum("_n").over(Window.orderBy("_part")) - F.col("_n")).alias("_before"))
    return ranged.join(F.broadcast(before), "_part").withColumn(name, F.col("_before") + F.col("_in") + 1).drop("_part", "_in", "_before")


def windows(reads: DataFrame, k: int) -> DataFrame:
    """(seq_id, off, kmer) of all windows of k symbols. Places are exploded and texts cut from them, so that all of it is one
    generated loop. Where all symbols are one byte the bytes are cut: for the i-th symbol of a text, Spark goes through all before it."""
    starts = F.explode(F.sequence(F.lit(0), F.length("sequence") - k)).alias("off")
    plain = (F.octet_length("sequence") == F.length("sequence")).alias("plain")
    rows = reads.where(F.length("sequence") >= k).select("seq_id", "sequence", F.col("sequence").cast("binary").alias("raw"), plain)
    at, n = F.col("off") + 1, F.lit(k)
    kmer = F.when(F.col("plain"), F.substr("raw", at, n).cast("string")).otherwise(F.substr("sequence", at, n))
    return rows.select("*", starts).select("seq_id", "off", kmer.alias("kmer"))


def representatives(places: DataFrame) -> DataFrame:
    """(kmer, seq_id, off, multiplicity): each k-mer with its first place and its number of places.

    The place is one decimal number, which a hash aggregate can hold, where a struct would need a sort.
    """
    place = F.col("seq_id").cast("decimal(20,0)") * F.lit(_PLACES).cast("decimal(11,0)") + F.col("off").cast("decimal(11,0)")
    first = places.groupBy("kmer").agg(F.min(place).alias("first"), F.count("*").alias("multiplicity"))
    off = F.pmod("first", F.lit(_PLACES).cast("decimal(11,0)"))
    return first.withColumn("off", off.cast("int")).select("kmer", F.expr(f"cast((first - off) div {_PLACES} as long)").alias("seq_id"), "off", "multiplicity")


def represented(kmers: DataFrame, representatives: DataFrame) -> DataFrame:
    """kmers(kmer, seq_id, off, ...) with the place of the k-mer's representative in seq_id and off, and `found`. A k-mer without a
    representative stands for itself, with the place it has."""
    first = representatives.select("kmer", F.col("seq_id").alias("_seq_id"), F.col("off").alias("_off"))
    rows = kmers.join(first, "kmer", "left").withColumn("found", F.col("_seq_id").isNotNull())
    return rows.withColumn("seq_id", F.coalesce("_seq_id", "seq_id")).withColumn("off", F.coalesce("_off", "off")).drop("_seq_id", "_off")


def text_at(places: DataFrame, reads: DataFrame, k: int) -> DataFrame:
    """places(seq_id, off, ...) with kmer, the text found there; null where the read is unknown."""
    return places.join(reads.select("seq_id", "sequence"), "seq_id", "left").withColumn("kmer", F.substr("sequence", F.col("off") + 1, F.lit(k))).drop("sequence")

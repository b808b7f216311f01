"""Streams of reads: running k-mer counts, and counts per window of event time with late rows handled by a watermark."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kmerframe.functions.sequences import folded, kmers
from kmerframe.sources.fasta import register


def fasta_stream(spark: SparkSession, folder: str, mode: str = "FAILFAST") -> DataFrame:
    """New FASTA files of a folder as a stream of records."""
    register(spark)
    return spark.readStream.format("fasta").option("mode", mode).load(folder)


def kmer_counts(stream: DataFrame, sequence: str, k: int) -> DataFrame:
    """(kmer, n) over everything seen so far; for output mode update or complete. Works on a static table too."""
    return stream.select(F.explode(kmers(folded(F.col(sequence)), k)).alias("kmer")).groupBy("kmer").agg(F.count("*").alias("n"))


def records_by_time(stream: DataFrame, time: str, width: str, delay: str) -> DataFrame:
    """(start, records, symbols) per window of event time; rows later than delay are dropped once their window is closed."""
    return (
        stream.withWatermark(time, delay).groupBy(F.window(time, width).alias("w"))
        .agg(F.count("*").alias("records"), F.sum(F.length("data")).alias("symbols")).select(F.col("w.start").alias("start"), "records", "symbols")
    )


def first_seen(stream: DataFrame, key: list[str], time: str, delay: str) -> DataFrame:
    """Each key once within the watermark: repeated loads of a record are dropped, with bounded state."""
    return stream.withWatermark(time, delay).dropDuplicatesWithinWatermark(key)

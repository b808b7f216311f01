"""Embeddings and training pairs kept as Parquet, so that they are made once per model."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

#: Errors that tell that nothing has been written at a path yet.
_NOTHING_YET = ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA")


def _read(spark: SparkSession, path: str) -> DataFrame | None:
    """The table at path, or None if there is none; other errors are raised."""
    try:
        return spark.read.parquet(path)
    except AnalysisException as e:
        if e.getCondition() in _NOTHING_YET:
            return None
        raise


def save_embeddings(embeddings: DataFrame, path: str, model_id: str) -> None:
    """Add (kmer, embedding) under a model's name; a partition per model."""
    embeddings.select("kmer", "embedding", F.lit(model_id).alias("model_id")).write.mode("append").partitionBy("model_id").parquet(path)


def load_embeddings(spark: SparkSession, path: str, model_id: str) -> DataFrame | None:
    """(kmer, embedding) of a model, each k-mer once, or None if nothing is kept. Only the model's partition is read."""
    kept = _read(spark, path)
    if kept is None:
        return None
    return kept.where(F.col("model_id") == model_id).groupBy("kmer").agg(F.min("embedding").alias("embedding"))


def embedded_once(kmers: DataFrame, embed: Callable[[DataFrame], DataFrame], path: str, model_id: str) -> DataFrame:
    """(kmer, embedding) of all kmers; only those that are not kept yet are embedded, and kept."""
    kept = load_embeddings(kmers.sparkSession, path, model_id)
    wanted = kmers.select("kmer").distinct()
    new = wanted if kept is None else wanted.join(kept.select("kmer"), "kmer", "left_anti")
    made = embed(new)
    save_embeddings(made, path, model_id)
    kept = load_embeddings(kmers.sparkSession, path, model_id)
    if kept is None:  # nothing was kept, and there was nothing to embed
        return made
    return kept.join(wanted, "kmer", "left_semi")


def made_once(spark: SparkSession, path: str, make: Callable[[], DataFrame], again: bool = False) -> DataFrame:
    """The table at path; made and written first if it isn't there, or if asked to make it again."""
    kept = None if again else _read(spark, path)
    if kept is not None:
        return kept
    make().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)

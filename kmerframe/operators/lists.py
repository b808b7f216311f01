"""Approximate nearest neighbours by lists around centroids, for rows that are all queries.

Centroids are fitted on a bounded sample, one list per about LIST_ROWS rows. Every row belongs to the list of its nearest centroid and visits
its PROBES nearest lists, where it is compared exactly. A list of more than twice BLOCK_ROWS rows has centroids of its own, fitted on a
bounded sample of it, that split it into blocks of about BLOCK_ROWS rows; a row visits the BLOCK_PROBES nearest blocks of a list. So a
row is copied at most PROBES * BLOCK_PROBES times, however many rows there are, and no task holds a whole list.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kmerframe.runtime import cut

LIST_ROWS = 512
MAX_LISTS = 4096
PROBES = 14
BLOCK_ROWS = 2048
BLOCK_PROBES = 4
#: Sample rows for each centroid, and rounds of fitting.
SAMPLE_TIMES = 16
ROUNDS = 6
#: Queries that are compared at a time in a task.
STEP = 512


def near_centroids(x: np.ndarray, centroids: np.ndarray, many: int) -> np.ndarray:
    """Indices of the `many` nearest centroids of each row, nearest first."""
    many = min(many, len(centroids))
    out = np.empty((len(x), many), np.int32)
    for start in range(0, len(x), 4096):
        far = (centroids**2).sum(1) - 2 * (x[start : start + 4096] @ centroids.T)
        best = np.argpartition(far, many - 1, axis=1)[:, :many] if many < far.shape[1] else np.broadcast_to(np.arange(many), (len(far), many))
        out[start : start + 4096] = np.take_along_axis(best, np.take_along_axis(far, best, 1).argsort(1, kind="stable"), 1)
    return out


def fitted(x: np.ndarray, k: int, seed: int) -> np.ndarray:
    """k centroids of the rows by Lloyd's method, from rows drawn with the seed."""
    centroids = x[np.sort(np.random.default_rng(seed).choice(len(x), min(k, len(x)), replace=False))].copy()
    for _ in range(ROUNDS):
        own = near_centroids(x, centroids, 1)[:, 0]
        size = np.bincount(own, minlength=len(centroids))
        order, starts = own.argsort(kind="stable"), np.concatenate([[0], np.cumsum(size)])[:-1]
        filled = size > 0
        centroids[filled] = np.add.reduceat(x[order], starts[filled], axis=0) / size[filled, None]
    return centroids


def _unit(x: np.ndarray) -> np.ndarray:
    return x / (np.sqrt((x * x).sum(1, keepdims=True)) + 1e-30)


def _rows_of(column: pa.Array) -> np.ndarray:
    return _unit(column.flatten().to_numpy(zero_copy_only=False).astype(np.float32).reshape(len(column), -1))


def _sampled(rows: DataFrame, wanted: float, total) -> DataFrame:
    """About `wanted` rows, the same ones each time, given how many there are."""
    return rows.where(F.pmod(F.xxhash64(F.lit("sample"), "id"), F.lit(1_000_000)) < F.ceil(F.least(F.lit(1.0), F.lit(wanted) / total) * 1_000_000))


def list_neighbours(rows: DataFrame, k: int, seed: int = 11) -> DataFrame:
    """(query, neighbour, cosine, rank): about the k rows (id, embedding) of highest cosine for each row, itself excluded; ties go to the
    smaller id. The cosines given are exact. Vectors have one length and are not null. An empty table gives no rows.
    """
    rows = rows.select("id", "embedding")
    total = rows.count()
    lists = int(min(MAX_LISTS, max(1, total // LIST_ROWS)))
    context = rows.sparkSession.sparkContext

    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        x = _unit(np.stack(pdf.sort_values("id")["embedding"].to_numpy()).astype(np.float32))
        return pd.DataFrame({"model": [pickle.dumps(fitted(x, lists, seed))]})

    # at most MAX_LISTS * SAMPLE_TIMES rows in one task, and MAX_LISTS centroids on the driver
    sample = _sampled(rows, lists * SAMPLE_TIMES + 64, F.lit(max(1, total)))
    models = sample.withColumn("one", F.lit(0)).groupBy("one").applyInPandas(fit, "model binary").collect()
    if not models:
        models = rows.limit(1000).withColumn("one", F.lit(0)).groupBy("one").applyInPandas(fit, "model binary").collect()
    schema = "query long, neighbour long, cosine double, rank int"
    if not models:
        return rows.sparkSession.createDataFrame([], schema)
    held = context.broadcast(pickle.loads(models[0]["model"]))

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            near = near_centroids(_rows_of(batch.column(1)), held.value, PROBES)
            offsets = pa.array(np.arange(0, near.size + 1, near.shape[1], dtype=np.int32))
            yield pa.record_batch([*batch.columns, pa.ListArray.from_arrays(offsets, pa.array(near.ravel()))], names=["id", "embedding", "cells"])

    index = cut(rows.mapInArrow(assign, "id long, embedding array<float>, cells array<int>") if _is_float(rows) else rows.select("id", F.col("embedding").cast("array<float>")).mapInArrow(assign, "id long, embedding array<float>, cells array<int>"))
    own = index.select(F.col("cells")[0].alias("cell"), "id", "embedding")
    heavy = own.groupBy("cell").agg(F.count("*").alias("n")).where(f"n > {2 * BLOCK_ROWS}").withColumn("blocks", F.ceil(F.col("n") / BLOCK_ROWS).cast("int"))

    def split(pdf: pd.DataFrame) -> pd.DataFrame:
        x = _unit(np.stack(pdf.sort_values("id")["embedding"].to_numpy()).astype(np.float32))
        return pd.DataFrame({"cell": pdf["cell"].iloc[:1], "inner": [fitted(x, int(pdf["blocks"].iloc[0]), seed + 1).tobytes()]})

    inner = _sampled(own.join(F.broadcast(heavy), "cell"), 1.0, F.col("n") / (F.col("blocks") * SAMPLE_TIMES)).groupBy("cell").applyInPandas(split, "cell int, inner binary")
    inner = cut(inner)

    def block(batches: Iterator[pa.RecordBatch], many: int) -> Iterator[pa.RecordBatch]:
        """(cell, block, id, embedding) for the nearest blocks of each row in a list; block 0 where the list has no inner centroids."""
        for batch in batches:
            x = _rows_of(batch.column(2))
            at, blocks = [np.arange(len(x))], [np.zeros(len(x), np.int32)]
            models_ = batch.column(3)
            if models_.null_count < len(models_):
                cell = batch.column(0).to_numpy()
                split_rows = np.flatnonzero(~models_.is_null().to_numpy(zero_copy_only=False))
                at, blocks = [np.setdiff1d(np.arange(len(x)), split_rows)], [np.zeros(len(x) - len(split_rows), np.int32)]
                for c in np.unique(cell[split_rows]):
                    those = split_rows[cell[split_rows] == c]
                    centroids = np.frombuffer(models_[int(those[0])].as_py(), np.float32).reshape(-1, x.shape[1])
                    near = near_centroids(x[those], centroids, many)
                    at.append(np.repeat(those, near.shape[1]))
                    blocks.append(near.ravel())
            pick = pa.array(np.concatenate(at))
            yield pa.record_batch([batch.column(0).take(pick), pa.array(np.concatenate(blocks)), batch.column(1).take(pick), batch.column(2).take(pick)], names=["cell", "block", "id", "embedding"])

    placed = "cell int, block int, id long, embedding array<float>"
    members = own.join(inner, "cell", "left").select("cell", "id", "embedding", "inner").mapInArrow(lambda b: block(b, 1), placed)
    visits = index.select(F.explode("cells").alias("cell"), "id", "embedding").join(inner, "cell", "left").select("cell", "id", "embedding", "inner").mapInArrow(lambda b: block(b, BLOCK_PROBES), placed)

    def search(ms: pa.Table, qs: pa.Table) -> pa.Table:
        out = pa.schema([("query", pa.int64()), ("near", pa.list_(pa.struct([("far", pa.float64()), ("id", pa.int64())])))])
        if not ms.num_rows or not qs.num_rows:
            return out.empty_table()
        ids = ms.column("id").to_numpy()
        order = ids.argsort()
        ids, x = ids[order], _unit(_rows_of(ms.column("embedding").combine_chunks()).astype(np.float64))[order]
        q_ids, q = qs.column("query").to_numpy(), _unit(_rows_of(qs.column("qe").combine_chunks()).astype(np.float64))
        near_ids, near_far, sizes = [], [], []
        for start in range(0, len(q), STEP):
            far = -np.round(q[start : start + STEP] @ x.T, 12)
            far[ids[None, :] == q_ids[start : start + STEP, None]] = np.inf
            best = np.argsort(far, axis=1, kind="stable")[:, :k]
            far = np.take_along_axis(far, best, 1)
            ok = np.isfinite(far)
            near_ids.append(ids[best][ok])
            near_far.append(far[ok])
            sizes.append(ok.sum(1))
        ends = pa.array(np.concatenate([[0], np.cumsum(np.concatenate(sizes))]).astype(np.int32))
        near = pa.StructArray.from_arrays([pa.array(np.concatenate(near_far)), pa.array(np.concatenate(near_ids))], ["far", "id"])
        return pa.table([pa.array(q_ids), pa.ListArray.from_arrays(ends, near)], schema=out)

    left = visits.toDF("q_cell", "q_block", "query", "qe")
    found = members.groupBy("cell", "block").cogroup(left.groupBy("q_cell", "q_block")).applyInArrow(search, "query long, near array<struct<far: double, id: long>>")
    # at most PROBES * BLOCK_PROBES lists of k for each row
    best = found.groupBy("query").agg(F.slice(F.array_sort(F.flatten(F.collect_list("near"))), 1, k).alias("best"))
    return best.select("query", F.posexplode("best").alias("rank", "b")).select("query", F.col("b.id").alias("neighbour"), (-F.col("b.far")).alias("cosine"), (F.col("rank") + 1).cast("int").alias("rank"))


def _is_float(rows: DataFrame) -> bool:
    return rows.schema["embedding"].dataType.simpleString() == "array<float>"

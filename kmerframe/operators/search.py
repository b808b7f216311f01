"""Nearest neighbours: exact search of a stated query set against all rows, and candidates by locality-sensitive hashing."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kmerframe.runtime import shuffle_width

#: Rows of a block. Each block of queries meets each block of rows, so the rows are copied once per block of queries; within a task
#: the queries go in steps of ALL_STEP.
QUERY_BLOCK = 1 << 16
ROW_BLOCK = 1 << 16


def _matrix(column: pa.Array) -> np.ndarray:
    values = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)
    return values / (np.sqrt((values * values).sum(1, keepdims=True)) + 1e-30)


def _finite(x: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The rows that are comparable at all: those without NaN."""
    keep = np.isfinite(x).all(1)
    return x[keep], ids[keep]


def exact_neighbours(queries: DataFrame, rows: DataFrame, k: int, group: str | None = None, blocks: int | None = None) -> DataFrame:
    """(query, neighbour, cosine, rank): the k rows of highest cosine for each query, itself excluded; ties go to the smaller id.

    queries and rows are (id, embedding) and, with group, a column that must be equal. Vectors have one length; null ones are
    left out by the caller. Queries and rows are cut into blocks of a bounded size, and each block of queries meets each block of
    rows once; what leaves a task is k rows per query, merged by a window.
    """
    spark = rows.sparkSession
    group = group or "_group"
    if group == "_group":
        queries, rows = queries.withColumn(group, F.lit(0)), rows.withColumn(group, F.lit(0))
    chunks, parts = _chunks(queries, QUERY_BLOCK), max(blocks or shuffle_width(spark), _chunks(rows, ROW_BLOCK))
    own = lambda n: F.pmod(F.xxhash64("id"), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = queries.select(F.col(group).alias("qg"), own(chunks).alias("qchunk"), every(parts).alias("qpart"), F.col("id").alias("query"), F.col("embedding").alias("qe"))
    right = rows.select(F.col(group).alias("g"), every(chunks).alias("chunk"), own(parts).alias("part"), "id", "embedding")

    def compare(qs: pa.Table, rs: pa.Table) -> pa.Table:
        out = pa.schema([("query", pa.int64()), ("neighbour", pa.int64()), ("cosine", pa.float64())])
        if not qs.num_rows or not rs.num_rows:
            return out.empty_table()
        a, q_ids = _finite(_matrix(qs.column("qe").combine_chunks()), qs.column("query").to_numpy())
        b, r_ids = _finite(_matrix(rs.column("embedding").combine_chunks()), rs.column("id").to_numpy())
        if not len(a) or not len(b):
            return out.empty_table()
        order = r_ids.argsort()
        row, found, cosine = _best(a, q_ids, b[order], r_ids[order], k)
        return pa.table([q_ids[row], found, cosine], schema=out)

    found = right.groupBy("g", "chunk", "part").cogroup(left.groupBy("qg", "qchunk", "qpart")).applyInArrow(lambda r_, q_: compare(q_, r_), "query long, neighbour long, cosine double")
    ranked = found.withColumn("rank", F.row_number().over(Window.partitionBy("query").orderBy(F.desc("cosine"), "neighbour")))
    return ranked.where(F.col("rank") <= k)


def _chunks(df: DataFrame, size: int) -> int:
    return max(1, -(-df.count() // size))


def hashed_candidates(rows: DataFrame, tables: int = 8, bits: int = 12, seed: int = 5, dim: int = 64) -> DataFrame:
    """(a, b), a < b: pairs of rows (id, embedding) whose vectors fall on the same side of `bits` random hyperplanes in one of
    `tables` tables. Approximate: more tables find more pairs, more bits give fewer false ones; choose bits so that 2^bits
    is about the number of rows. Equal vectors share all buckets, so call it on distinct vectors."""
    rng = np.random.default_rng(seed)
    planes = rng.standard_normal((dim, tables * bits)).astype(np.float32)
    weights = (np.int64(1) << np.arange(bits, dtype=np.int64))[None, None, :]

    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = _matrix(batch.column(1)).astype(np.float32)
            key = (((x @ planes) > 0).reshape(len(x), tables, bits) * weights).sum(2) + (np.arange(tables, dtype=np.int64) << bits)
            yield pa.record_batch([pa.array(np.repeat(batch.column(0).to_numpy(), tables)), pa.array(key.ravel())], names=["id", "bucket"])

    hashed = rows.select("id", "embedding").mapInArrow(keys, "id long, bucket long")
    return hashed.select("bucket", F.col("id").alias("a")).join(hashed.select("bucket", F.col("id").alias("b")), "bucket").where("a < b").select("a", "b").distinct()


#: Rows of a block where all rows are queries, and rows of a step within it.
ALL_BLOCK = 1 << 16
ALL_STEP = 256
#: Rows whose k-th best is a first bound for the whole block.
ALL_FIRST = 4096
#: Single precision decides only what is farther than this from the k-th best; the rest is compared in double precision.
UNSURE = 1e-5


def _classes(x: np.ndarray, most: int) -> np.ndarray:
    """Rows (in order) that are among the first `most` of the rows equal to them."""
    own = np.unique(np.ascontiguousarray(x).view(f"V{x.dtype.itemsize * x.shape[1]}").ravel(), return_inverse=True)[1].ravel()
    order = np.argsort(own, kind="stable")
    sizes = np.bincount(own)
    place = np.empty(len(own), np.int64)
    place[order] = np.arange(len(own)) - np.repeat(sizes.cumsum() - sizes, sizes)
    return np.flatnonzero(place < most)


def _best(a: np.ndarray, a_ids: np.ndarray, b: np.ndarray, b_ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row of a, id, cosine): for each row of a at least its k nearest of b, by cosine to 12 places, then by id. b is in order of ids.

    Of rows of b equal to the last bit only the k + 1 smallest ids can be among the k nearest."""
    keep = _classes(b, k + 1)
    b, b_ids = b[keep], b_ids[keep]
    a32, b32 = a.astype(np.float32), b.astype(np.float32).T.copy()
    out = []
    for start in range(0, len(a), ALL_STEP):
        near = a32[start : start + ALL_STEP] @ b32
        # one more than k, as a row may be its own nearest; first a bound from some columns, then from all that reach it
        some = near[:, :ALL_FIRST]
        least = np.partition(some, some.shape[1] - k - 1, axis=1)[:, some.shape[1] - k - 1] if some.shape[1] > k + 1 else np.full(len(near), -np.inf, np.float32)
        row, at = np.nonzero(near >= least[:, None] - np.float32(UNSURE))
        value = near[row, at]
        order = np.lexsort((-value, row))
        sizes = np.bincount(row, minlength=len(near))
        last = sizes.cumsum() - sizes + np.minimum(sizes, k + 1) - 1
        sure = value >= value[order[last]][row] - np.float32(UNSURE)
        row, at = row[sure], at[sure]
        for r, c in zip(np.array_split(row, len(row) // (1 << 18) + 1), np.array_split(at, len(row) // (1 << 18) + 1)):
            other = a_ids[start + r] != b_ids[c]
            r, c = start + r[other], c[other]
            out.append((r, c, np.round(np.einsum("ij,ij->i", a[r], b[c]), 12)))
    r, c, cosine = (np.concatenate(x) for x in zip(*out))
    order = np.lexsort((c, -cosine, r))
    r, c, cosine = r[order], c[order], cosine[order]
    sizes = np.bincount(r, minlength=len(a))
    first = np.arange(len(r)) - np.repeat(sizes.cumsum() - sizes, sizes) < k
    return r[first], b_ids[c[first]], cosine[first]


def all_neighbours(rows: DataFrame, block: int = ALL_BLOCK) -> DataFrame:
    """(query, neighbour, cosine, rank): for every row (id, grp, k, embedding) the k rows of its group of highest cosine, itself
    excluded; ties go to the smaller id. k is one number per group. Exact: the work grows with the square of a group's rows.

    A group is cut into blocks of about `block` rows and each block meets each other one once, so rows are copied once per
    block of their group; what leaves a task is k rows per query, merged by a window.
    """
    counts = rows.groupBy("grp").agg(F.ceil(F.count("*") / F.lit(block)).cast("int").alias("blocks"))
    cut_up = rows.join(counts, "grp").withColumn("own", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))
    meet = cut_up.select("grp", "own", "k", "id", "embedding", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"))
    left = meet.select(F.col("grp").alias("qg"), F.col("own").alias("qi"), F.col("other").alias("qj"), "k", F.col("id").alias("query"), F.col("embedding").alias("qe"))
    right = meet.select("grp", F.col("other").alias("i"), F.col("own").alias("j"), "id", "embedding")

    def compare(rs: pa.Table, qs: pa.Table) -> pa.Table:
        out = pa.schema([("query", pa.int64()), ("k", pa.int32()), ("neighbour", pa.int64()), ("cosine", pa.float64())])
        if not qs.num_rows or not rs.num_rows:
            return out.empty_table()
        k, ids = qs.column("k")[0].as_py(), qs.column("query").to_numpy()
        r_ids = rs.column("id").to_numpy()
        order = r_ids.argsort()
        a, b = _matrix(qs.column("qe").combine_chunks()), _matrix(rs.column("embedding").combine_chunks())[order]
        row, found, cosine = _best(a, ids, b, r_ids[order], k)
        return pa.table([ids[row], np.full(len(row), k, np.int32), found, cosine], schema=out)

    found = right.groupBy("grp", "i", "j").cogroup(left.groupBy("qg", "qi", "qj")).applyInArrow(compare, "query long, k int, neighbour long, cosine double")
    ranked = found.withColumn("rank", F.row_number().over(Window.partitionBy("query").orderBy(F.desc("cosine"), "neighbour")))
    return ranked.where("rank <= k").select("query", "neighbour", "cosine", "rank")

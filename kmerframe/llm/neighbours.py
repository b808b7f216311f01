"""Problem 1: the k most similar vectors of every vector, by an inverted file with product-quantised residuals.

Fit, on a bounded sample: coarse centroids by k-means (one list per about CELL_ROWS vectors) and, of the residuals, a
codebook of 256 entries for each of M sub-vectors. Index, over all rows: each vector goes to its nearest
centroid's list as the codes of its residual, with the vector itself for the rerank. Search, for all rows: each vector
visits its PROBES nearest lists. There its inner products with the codebooks form asymmetric distance tables, sums
of table entries rank the list, and the best few are compared exactly in double precision. The exact cosines of
the lists visited are merged per vector.

Skew. Vectors that are equal to the last bit form a class, of which one is indexed; a class, however large, adds its k + 1
smallest ids only, since ties go to the smaller id. A list of more than twice BLOCK_ROWS vectors has centroids of its own, fitted on a bounded
sample of it, that cut it into blocks of about BLOCK_ROWS, which different tasks search; a query visits the BLOCK_PROBES nearest blocks
of such a list. So a query is copied at most PROBES * BLOCK_PROBES times, however long the lists grow. The queries of a block are
cut into chunks too. The models and the lists' sizes (bounded by the number of centroids) are all that reaches the driver.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kmerframe.runtime import cut, fanned, shuffle_width

DIM = 64
#: Rows per configuration, at most about, that the centroids and codebooks are fitted on: so many, or SAMPLE_TIMES for each list.
SAMPLE_ROWS = 20_000
SAMPLE_TIMES = 16
CELL_ROWS = 256
MAX_CELLS = 4096
SUBS = 16
CODES = 256
PROBES = 4
ROUNDS = 8
BLOCK_ROWS = 2048
BLOCK_PROBES = 4
QUERY_ROWS = 8192
#: How many of a block's best by table sums are compared exactly: this many times k, and at least SHORT_LEAST. Larger lists
#: have more blocks, so the share that is compared does not shrink as the data grow.
SHORT_TIMES = 16
SHORT_LEAST = 192
#: Of them, those beyond the k best in single precision that are compared in double precision too.
SURE = 24


def _nearest(x: np.ndarray, centroids: np.ndarray, many: int = 1) -> np.ndarray:
    """Indices of the nearest centroids by Euclidean distance, nearest first."""
    far = (centroids**2).sum(1) - 2 * (x @ centroids.T)
    if many == 1:
        return far.argmin(1)[:, None]
    many = min(many, len(centroids))
    best = np.argpartition(far, many - 1, axis=1)[:, :many]
    return np.take_along_axis(best, np.take_along_axis(far, best, 1).argsort(1), 1)


def k_means(x: np.ndarray, k: int, seed: int) -> np.ndarray:
    rng = np.random.default_rng(seed)
    centroids = x[np.sort(rng.choice(len(x), min(k, len(x)), replace=False))].copy()
    for _ in range(ROUNDS):
        own = np.concatenate([_nearest(x[i : i + 4096], centroids)[:, 0] for i in range(0, len(x), 4096)])
        size = np.bincount(own, minlength=len(centroids))
        order = own.argsort(kind="stable")
        starts = np.concatenate([[0], np.cumsum(size)])[:-1]
        filled = size > 0
        centroids[filled] = np.add.reduceat(x[order], starts[filled], axis=0) / size[filled, None]
    return centroids


def _fit(rows: pd.DataFrame) -> pd.DataFrame:
    x = np.stack(rows["v"].map(lambda b: np.frombuffer(b, np.float32)).to_numpy())
    x = _unit(x)[np.argsort(rows["vec_id"].to_numpy(), kind="stable")].astype(np.float32)
    cells = int(np.clip(rows["total"].iloc[0] // CELL_ROWS, 1, min(MAX_CELLS, max(1, len(x) // 16))))
    coarse = k_means(x, cells, 1)
    rest = x - coarse[_nearest(x, coarse)[:, 0]]
    width = DIM // SUBS
    books = [k_means(rest[:, m * width : (m + 1) * width], CODES, 2 + m) for m in range(SUBS)]
    return pd.DataFrame({"config_id": rows["config_id"].iloc[:1], "model": [pickle.dumps((coarse, books))]})


def _unit(x: np.ndarray) -> np.ndarray:
    x = x.astype(np.float64)
    return x / np.sqrt((x * x).sum(1))[:, None]


def _vectors(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.float32).reshape(-1, DIM)


def _fixed(rows: np.ndarray) -> pa.Array:
    return pa.array([r.tobytes() for r in rows], pa.binary())


def _as_bytes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        flat = batch.column(3).flatten().to_numpy(zero_copy_only=False).astype(np.float32).reshape(-1, DIM)
        yield pa.record_batch([*batch.columns[:3], _fixed(flat)], names=["vec_id", "config_id", "k", "v"])


def usable(vectors: DataFrame, configs: DataFrame) -> DataFrame:
    """(vec_id, config_id, k, v): usable vectors once each, with k of their configuration, v as bytes of 64 floats.

    Usable: 64 values, none null or infinite or NaN, not all zero. A vec_id with several usable rows counts with
    its earliest embedded_at (then the smallest embedding). Null ids, and configurations that are unknown or whose
    knn_top_k is null or below 1, are left out; of repeated configurations the largest k counts.
    """
    good = (
        F.col("vec_id").isNotNull() & F.col("config_id").isNotNull() & (F.size("embedding") == DIM)
        & F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("embedding", lambda x: x != 0)
    )
    one = F.min(F.struct(F.col("embedded_at").isNull().alias("n"), F.col("embedded_at").alias("t"), F.col("config_id").alias("c"), F.col("embedding").alias("e")))
    rows = vectors.where(good).groupBy("vec_id").agg(one.alias("r")).select("vec_id", F.col("r.c").alias("config_id"), F.col("r.e").alias("embedding"))
    k = configs.where("config_id IS NOT NULL AND knn_top_k > 0").groupBy("config_id").agg(F.max("knn_top_k").alias("k"))
    return rows.join(k, "config_id").select("vec_id", "config_id", "k", "embedding").mapInArrow(_as_bytes, "vec_id long, config_id int, k int, v binary")


def _assigned(batches: Iterator[pa.RecordBatch], models: dict) -> Iterator[pa.RecordBatch]:
    """Each vector with the list it belongs to, its codes there, and the lists it visits."""
    for whole in batches:
        for start in range(0, whole.num_rows, 4096):
            batch = whole.slice(start, 4096)
            x = _unit(_vectors(batch.column(3))).astype(np.float32)
            config = batch.column(1).to_numpy()
            cells = np.full((len(x), PROBES), -1, np.int32)
            codes = np.zeros((len(x), SUBS), np.uint8)
            for c in np.unique(config):
                coarse, books = models[int(c)]
                at = np.flatnonzero(config == c)
                near = _nearest(x[at], coarse, PROBES)
                cells[at, : near.shape[1]] = near
                rest = x[at] - coarse[near[:, 0]]
                for m, book in enumerate(books):
                    width = DIM // SUBS
                    codes[at, m] = _nearest(rest[:, m * width : (m + 1) * width], book)[:, 0]
            lists = pa.ListArray.from_arrays(pa.array(np.arange(0, cells.size + 1, PROBES, dtype=np.int32)), pa.array(cells.ravel()))
            yield pa.record_batch([*batch.columns, _fixed(codes), lists], names=["vec_id", "config_id", "k", "v", "codes", "cells"])


def _split(rows: pd.DataFrame) -> pd.DataFrame:
    x = _unit(np.frombuffer(b"".join(rows.sort_values("vec_id")["v"]), np.float32).reshape(-1, DIM)).astype(np.float32)
    return pd.DataFrame({"config_id": rows["config_id"].iloc[:1], "cell": rows["cell"].iloc[:1], "inner": [k_means(x, int(rows["blocks"].iloc[0]), 99).tobytes()]})


def _in_blocks(batches: Iterator[pa.RecordBatch], many: int) -> Iterator[pa.RecordBatch]:
    """Rows (config_id, cell, v, inner, ...) with `block` in the place of inner, once for each of the nearest blocks of their list; block 0
    where the list has no centroids of its own."""
    for batch in batches:
        inner, x = batch.column(3), _unit(_vectors(batch.column(2))).astype(np.float32)
        whole = inner.is_null().to_numpy(zero_copy_only=False)
        at, block = [np.flatnonzero(whole)], [np.zeros(int(whole.sum()), np.int32)]
        place = batch.column(0).to_numpy().astype(np.int64) << 32 | batch.column(1).to_numpy()
        for c in np.unique(place[~whole]):
            those = np.flatnonzero((place == c) & ~whole)
            near = _nearest(x[those], np.frombuffer(inner[int(those[0])].as_py(), np.float32).reshape(-1, DIM), many)
            at.append(np.repeat(those, near.shape[1]))
            block.append(near.ravel().astype(np.int32))
        pick = pa.array(np.concatenate(at))
        names = [*batch.schema.names[:3], "block", *batch.schema.names[4:]]
        yield pa.record_batch([*(c.take(pick) for c in batch.columns[:3]), pa.array(np.concatenate(block)), *(c.take(pick) for c in batch.columns[4:])], names=names)


def _search(key: tuple, members: pd.DataFrame, queries: pd.DataFrame, models: dict) -> pd.DataFrame:
    """The k best of one block of a list for the queries that visit it."""
    empty = pd.DataFrame({"q": pd.Series(dtype="int64"), "ids": pd.Series(dtype=object), "far": pd.Series(dtype=object)})
    if not len(members) or not len(queries):
        return empty
    coarse, books = models[int(key[0])]
    centroid = coarse[int(key[1])]
    ids = members["vec_id"].to_numpy()
    order = ids.argsort()
    ids = ids[order]
    exact = _unit(np.frombuffer(b"".join(members["v"]), np.float32).reshape(-1, DIM))[order]
    single = exact.astype(np.float32)
    codes = np.frombuffer(b"".join(members["codes"]), np.uint8).reshape(-1, SUBS)[order]
    k = int(queries["k"].iloc[0])
    short = min(len(ids), max(SHORT_LEAST, SHORT_TIMES * k))
    q_ids, out_ids, out_far = queries["q"].to_numpy(), [], []
    q_all = np.frombuffer(b"".join(queries["qv"]), np.float32).reshape(-1, DIM)
    width = DIM // SUBS
    step = max(1, 1_000_000 // max(len(ids), short * DIM))
    for start in range(0, len(q_all), step):
        unit = _unit(q_all[start : start + step])
        q = unit.astype(np.float32)
        if short < len(ids):
            score = np.zeros((len(q), len(ids)), np.float32)
            for m, book in enumerate(books):
                score += (q[:, m * width : (m + 1) * width] @ book.T).take(codes[:, m], axis=1)
            chosen = np.argpartition(score, len(ids) - short, axis=1)[:, len(ids) - short :]
            # single precision decides only what is far from the k best, the rest is compared in double precision
            near = np.matmul(single[chosen], q[:, :, None])[:, :, 0]
            last = min(short, k + SURE)
            chosen = np.sort(np.take_along_axis(chosen, np.argpartition(near, short - last, axis=1)[:, short - last :], 1), axis=1)
            far = -np.matmul(exact[chosen], unit[:, :, None])[:, :, 0]
        else:
            chosen = np.broadcast_to(np.arange(len(ids)), (len(q), len(ids)))
            far = -(unit @ exact.T)
        far = np.where(ids[chosen] == q_ids[start : start + step, None], np.inf, far)
        best = np.argsort(far, axis=1, kind="stable")[:, :k]  # members are in order of ids, so ties go to the smaller
        out_ids.extend(ids[np.take_along_axis(chosen, best, 1)])
        out_far.extend(np.take_along_axis(far, best, 1))
    return pd.DataFrame({"q": q_ids, "ids": out_ids, "far": out_far})


def nearest(vectors: DataFrame, configs: DataFrame) -> DataFrame:
    """(vec_id, neighbour, rank) with the k = knn_top_k nearest other usable vectors of the same configuration.

    See `usable` for what counts. A vector with fewer than k others has as many neighbours as there are. Equal cosines
    go to the smaller neighbour. Empty tables give no rows; extra columns are ignored. A cosine is approximated only in
    which vectors are compared at all; those reported are exact.
    """
    spark = vectors.sparkSession
    rows = cut(fanned(usable(vectors, configs), vectors, "vec_id"))
    # classes of equal vectors: all their members but the first are joined back at the end
    mark = rows.select("config_id", "k", "vec_id", F.xxhash64("v").alias("h1"), F.hash("v").alias("h2"))
    classes = mark.groupBy("config_id", "h1", "h2").agg(F.min("vec_id").alias("rep"), F.count("*").alias("n")).where("n > 1")
    copies = cut(mark.join(classes, ["config_id", "h1", "h2"]).select("vec_id", "rep", "k", "n"))
    single = rows.join(copies.where("vec_id <> rep").select("vec_id"), "vec_id", "left_anti")
    totals = single.groupBy("config_id").agg(F.count("*").alias("total"))
    share = F.pmod(F.xxhash64("vec_id"), F.lit(1_000_000)) < F.ceil(F.lit(1_000_000.0) * F.greatest(F.lit(SAMPLE_ROWS), F.least(F.lit(MAX_CELLS), F.col("total") / CELL_ROWS) * SAMPLE_TIMES) / F.col("total"))
    sample = single.join(totals, "config_id").where(share)
    models = {x["config_id"]: pickle.loads(x["model"]) for x in sample.groupBy("config_id").applyInPandas(_fit, "config_id int, model binary").collect()}
    held = spark.sparkContext.broadcast(models)
    index = cut(single.mapInArrow(lambda b: _assigned(b, held.value), "vec_id long, config_id int, k int, v binary, codes binary, cells array<int>"))

    visits = index.select("config_id", F.explode("cells").alias("cell")).groupBy("config_id", "cell").agg(F.count("*").alias("queries"))
    own = index.groupBy("config_id", F.col("cells")[0].alias("cell")).agg(F.count("*").alias("members"))
    blocks = F.when(F.col("members") > 2 * BLOCK_ROWS, F.ceil(F.col("members") / BLOCK_ROWS)).otherwise(1)
    # of a list's blocks a query visits some
    each = F.col("queries") * F.least(F.lit(BLOCK_PROBES), F.col("blocks")) / F.col("blocks")
    sizes = own.join(visits, ["config_id", "cell"]).withColumn("blocks", blocks.cast("int")).select("config_id", "cell", "members", "blocks", F.ceil(each / QUERY_ROWS).cast("int").alias("chunks"))
    sizes = F.broadcast(cut(sizes))  # a row per centroid, at most MAX_CELLS for a configuration
    long = index.withColumn("cell", F.col("cells")[0]).join(sizes.where("blocks > 1"), ["config_id", "cell"])
    part = F.pmod(F.xxhash64(F.lit("inner"), "vec_id"), F.lit(1_000_000)) < F.ceil(F.lit(1_000_000.0) * SAMPLE_TIMES * F.col("blocks") / F.col("members"))
    inner = cut(long.where(part).select("config_id", "cell", "blocks", "vec_id", "v").groupBy("config_id", "cell").applyInPandas(_split, "config_id int, cell int, inner binary"))
    spread = lambda column, n: F.pmod(F.xxhash64(column), n).cast("int")
    any_long = not inner.isEmpty()

    def in_blocks(rows: DataFrame, many: int, *rest: str) -> DataFrame:
        """rows with `block`; without long lists all are in block 0, and no Python is needed."""
        if not any_long:
            return rows.select("config_id", "cell", "v", F.lit(0).alias("block"), *rest)
        rows = rows.join(inner, ["config_id", "cell"], "left").select("config_id", "cell", "v", "inner", *rest)
        kinds = {f.name: f.dataType.simpleString() for f in rows.schema.fields}
        return rows.mapInArrow(lambda b: _in_blocks(b, many), ", ".join(f"{c} {'int' if c == 'block' else kinds[c]}" for c in ("config_id", "cell", "v", "block", *rest)))

    at_home = index.withColumn("cell", F.col("cells")[0]).join(sizes, ["config_id", "cell"])
    members = in_blocks(at_home, 1, "chunks", "vec_id", "codes").select("config_id", "cell", "block", F.explode(F.expr("sequence(0, chunks - 1)")).alias("chunk"), "vec_id", "v", "codes")
    visiting = index.select("config_id", "k", "vec_id", "v", F.explode("cells").alias("cell")).join(sizes, ["config_id", "cell"])
    queries = in_blocks(visiting, BLOCK_PROBES, "chunks", "k", "vec_id").select("config_id", "cell", "block", spread("vec_id", F.col("chunks")).alias("chunk"), "k", "vec_id", "v")
    queries = queries.toDF("q_config", "q_cell", "q_block", "q_chunk", "k", "q", "qv")
    found = members.groupBy("config_id", "cell", "block", "chunk").cogroup(queries.groupBy("q_config", "q_cell", "q_block", "q_chunk")).applyInPandas(
        lambda at, m, q: _search(at, m, q, held.value), "q long, ids array<long>, far array<double>"
    )
    ks = index.select("vec_id", "k").toDF("vec_id", "k")
    best = (
        found.groupBy("q").agg(F.array_sort(F.flatten(F.collect_list(F.arrays_zip("far", "ids")))).alias("best"))
        .join(ks, F.col("q") == F.col("vec_id"))
        .select("vec_id", "k", F.expr("slice(filter(best, x -> x.far < double('inf')), 1, k)").alias("best"))
    )
    if copies.isEmpty():
        return best.select("vec_id", F.posexplode("best").alias("rank", "b")).select("vec_id", F.col("b.ids").alias("neighbour"), (F.col("rank") + 1).alias("rank"))
    return _with_copies(best, copies, shuffle_width(spark))


def _with_copies(best: DataFrame, copies: DataFrame, salts: int) -> DataFrame:
    """Put the copies back: each stands beside its representative, and each gets its own neighbours."""
    from pyspark.sql import Window

    # the k + 1 smallest ids of each class, in two steps so that no task holds a class
    order = Window.partitionBy("rep", "salt").orderBy("vec_id")
    few = copies.withColumn("salt", F.pmod(F.xxhash64("vec_id"), F.lit(64 * salts))).withColumn("i", F.row_number().over(order)).where("i <= k + 1")
    few = few.withColumn("i", F.row_number().over(Window.partitionBy("rep").orderBy("vec_id"))).where("i <= k + 1").select("rep", F.col("vec_id").alias("member"))
    few = cut(few)
    lists = few.groupBy("rep").agg(F.sort_array(F.collect_list("member")).alias("members"))
    # neighbours of representatives, expanded
    near = best.select(F.col("vec_id").alias("from"), "k", F.explode("best").alias("b")).select("from", "k", F.col("b.far").alias("far"), F.col("b.ids").alias("to"))
    near = near.join(lists, F.col("to") == F.col("rep"), "left").select("from", "k", "far", F.explode(F.coalesce("members", F.array("to"))).alias("to"))
    # each member asks with its representative's list, and with its own class at a cosine of one
    asks = copies.select(F.col("rep"), "vec_id", "k")
    others = near.join(asks.where("vec_id <> rep").select("rep", F.col("vec_id").alias("other")), F.col("from") == F.col("rep")).select(F.col("other").alias("from"), "k", "far", "to")
    inside = asks.join(lists, "rep").select(F.col("vec_id").alias("from"), "k", F.lit(-float("inf")).alias("far"), F.explode("members").alias("to"))
    every = near.unionByName(others).unionByName(inside).where("from <> to")
    ranked = every.withColumn("rank", F.row_number().over(Window.partitionBy("from").orderBy("far", "to"))).where("rank <= k")
    return ranked.select(F.col("from").alias("vec_id"), F.col("to").alias("neighbour"), "rank")


def nearest_pairs(vectors: DataFrame, configs: DataFrame) -> DataFrame:
    """(vec_lo, vec_hi): pairs of which one is among the k nearest of the other, each once."""
    return nearest(vectors, configs).select(F.least("vec_id", "neighbour").alias("vec_lo"), F.greatest("vec_id", "neighbour").alias("vec_hi")).distinct()

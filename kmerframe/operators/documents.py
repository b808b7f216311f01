"""Shingles of documents: windows of symbols, with their occurrences and documents."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kmerframe.runtime import bounded, spread

#: Bytes of text that are counted together in a task, at most about; a document is never cut.
COUNTED_BYTES = 2_000_000


def _utf8(points: np.ndarray, width: int) -> pa.Array:
    """Strings of `width` code points each, laid end to end in points."""
    sizes = 1 + (points >= 0x80).astype(np.int64) + (points >= 0x800) + (points >= 0x10000)
    ends = np.concatenate([[0], sizes.reshape(-1, width).sum(1).cumsum()]).astype(np.int64)
    raw = points.astype("<u4").tobytes().decode("utf-32-le", "surrogatepass").encode("utf-8", "surrogatepass")
    return pa.LargeStringArray.from_buffers(len(ends) - 1, pa.py_buffer(ends.tobytes()), pa.py_buffer(raw)).cast(pa.string())


def _counted(texts: list[str], width: int) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """Shingles of the texts, the number of their places and of the texts that hold them."""
    points = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
    sizes = np.array([len(x) for x in texts], np.int64)
    ends = sizes.cumsum()
    own = np.repeat(np.arange(len(texts)), sizes)
    at = np.flatnonzero(np.arange(len(points)) + width <= np.repeat(ends, sizes))
    if not len(at):
        return pa.array([], pa.string()), np.zeros(0, np.int64), np.zeros(0, np.int64)
    known, codes = np.unique(points, return_inverse=True)
    bits = max(1, int(len(known) - 1).bit_length())
    if bits * width <= 62:  # exact: a shingle is one number
        keys = np.zeros(len(at), np.int64)
        for i in range(width):
            keys = keys << bits | codes[at + i]
    else:  # very many different symbols: shingles are compared as rows of symbols
        rows = np.ascontiguousarray(np.stack([codes[at + i] for i in range(width)], 1).astype(">u4"))
        keys = np.unique(rows.view(f"V{4 * width}").ravel(), return_inverse=True)[1].ravel()
    order = np.argsort(keys, kind="stable")  # places of a shingle stay in the order of their texts
    keys, at, own = keys[order], at[order], own[at[order]]
    new = np.concatenate([[True], keys[1:] != keys[:-1]])
    first = np.flatnonzero(new)
    documents = np.add.reduceat((new | np.concatenate([[True], own[1:] != own[:-1]])).astype(np.int64), first)
    return _utf8(points[at[first][:, None] + np.arange(width)].ravel(), width), np.diff(np.append(first, len(keys))), documents


def shingles(documents: DataFrame, width: int = 5) -> DataFrame:
    """(shingle, n, documents): all windows of `width` characters of (doc_id, text), with their places and their documents.

    Every character counts as it stands. A document is one row; it is counted where it is read, together with
    others of the same task, so that what is shuffled is a row per shingle and bundle of documents. Shorter texts have no window.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in bounded(batches, 0, COUNTED_BYTES):
            found, n, held = _counted(batch.column(0).to_pylist(), width)
            yield pa.record_batch([found, pa.array(n, pa.int64()), pa.array(held, pa.int64())], names=["shingle", "n", "documents"])

    rows = spread(documents.where("text IS NOT NULL").select("text"))
    return rows.mapInArrow(count, "shingle string, n long, documents long").groupBy("shingle").agg(F.sum("n").alias("n"), F.sum("documents").alias("documents"))

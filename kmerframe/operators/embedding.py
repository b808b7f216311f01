"""Embedding of k-mers: a spectrum that needs no model, or a network in an ONNX file."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import product
from typing import Protocol

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kmerframe.runtime import bounded, over_all_cores


class Embedder(Protocol):
    """Anything that turns (kmer) into (kmer, embedding); give it each k-mer once."""

    def __call__(self, distinct_kmers: DataFrame) -> DataFrame: ...


#: Counts that are held at once, so that memory has a bound whatever q is.
COUNTS = 1 << 20
_CODE = np.full(256, -1, np.int64)
for _i, _c in enumerate("ACGT"):
    _CODE[ord(_c)] = _i
_CODE[ord("U")] = _CODE[ord("T")]


def spectra(texts: pa.Array, q: int) -> np.ndarray:
    """(n, 4^q) counts of the q-grams over A, C, G, T in each text; U reads as T, grams with another symbol don't count, and a null text
    counts as empty. In UTF-8 no byte of a longer symbol is a letter, so bytes are looked at."""
    lengths = pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    ends = lengths.cumsum()
    raw = np.frombuffer("".join(x for x in texts.to_pylist() if x).encode(), np.uint8)
    code = _CODE[raw]
    n = max(0, len(raw) - q + 1)
    gram, known = np.zeros(n, np.int64), np.ones(n, bool)
    for i in range(q):
        here = code[i : i + n]
        gram = 4 * gram + here
        known &= here >= 0
    row = np.repeat(np.arange(len(texts)), lengths)[:n]
    known &= np.arange(n) + q <= ends[row] if n else known
    return np.bincount(row[known] * 4**q + gram[known], minlength=len(texts) * 4**q).reshape(len(texts), 4**q)


class SpectrumEmbedder:
    """Counts of all q-grams over A, C, G, T, as a unit vector of 4^q values; U reads as T. Deterministic; not a trained network."""

    def __init__(self, q: int = 2):
        self.q = q
        self.grams = ["".join(x) for x in product("ACGT", repeat=q)]

    def __call__(self, distinct_kmers: DataFrame) -> DataFrame:
        q, step = self.q, max(1, COUNTS // 4**self.q)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for whole in bounded(batches, 0):
                for start in range(0, whole.num_rows, step):
                    kmer = whole.column(0).slice(start, step)
                    counts = spectra(kmer, q)
                    size = np.sqrt((counts * counts).sum(1, keepdims=True).astype(np.float64)) + 1e-30
                    flat = pa.array((counts / size).astype(np.float32).ravel())
                    offsets = pa.array(np.arange(0, len(flat) + 1, 4**q, dtype=np.int32))
                    yield pa.record_batch([kmer, pa.ListArray.from_arrays(offsets, flat)], names=["kmer", "embedding"])

        return over_all_cores(distinct_kmers.select("kmer"), "kmer").mapInArrow(run, "kmer string, embedding array<float>")


class OnnxEmbedder:
    """A network with one input (batch, k, 16) of one-hot rows and one output of vectors, which come out as unit vectors. `order` is
    that of the type of the sequences (functions.alphabets.ORDERS).

    One session with one thread for each Python worker, made when its first batch comes.
    """

    def __init__(self, path: str, order: str = "ACGTRYSWKMBDHVN", gaps: str = ".-"):
        self.path, self.order, self.gaps = path, order, gaps

    def __call__(self, distinct_kmers: DataFrame) -> DataFrame:
        path, order, gaps = self.path, self.order, self.gaps

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            import onnxruntime

            options = onnxruntime.SessionOptions()
            options.intra_op_num_threads = 1
            session = onnxruntime.InferenceSession(path, options, providers=["CPUExecutionProvider"])
            name = session.get_inputs()[0].name
            for batch in batches:
                vectors = session.run(None, {name: one_hot_rows(batch.column(0).to_pylist(), order, gaps)})[0].reshape(batch.num_rows, -1)
                unit = vectors / (np.linalg.norm(vectors, axis=1, keepdims=True) + 1e-30)
                flat = pa.array(unit.astype(np.float32).ravel())
                offsets = pa.array(np.arange(0, flat.__len__() + 1, unit.shape[1] or 1, dtype=np.int32))
                yield pa.record_batch([batch.column(0), pa.ListArray.from_arrays(offsets, flat)], names=["kmer", "embedding"])

        return distinct_kmers.select("kmer").mapInArrow(run, "kmer string, embedding array<float>")


class CnnEmbedder:
    """Three convolutions of kernel 3, each with ReLU and a maximum over 2, then two dense layers, with seeded weights that are not trained.

    The weights follow from the seed, so every Python worker makes the same ones for itself. Unit vectors come out.
    """

    def __init__(self, k: int = 64, seed: int = 3, filters: tuple[int, ...] = (32, 64, 128), hidden: int = 8192, dim: int = 512, order: str = "ACGTRYSWKMBDHVN", gaps: str = ".-"):
        self.k, self.seed, self.filters, self.hidden, self.dim, self.order, self.gaps = k, seed, filters, hidden, dim, order, gaps

    def weights(self) -> list[np.ndarray]:
        rng, width, length, out = np.random.default_rng(self.seed), 16, self.k, []
        for filters in self.filters:
            out.append(rng.standard_normal((3 * width, filters)).astype(np.float32) * np.float32((2 / (3 * width)) ** 0.5))
            width, length = filters, (length - 2) // 2
        if length < 1:
            raise ValueError(f"k-mers of {self.k} symbols are too short for {len(self.filters)} convolutions")
        for a, b in ((width * length, self.hidden), (self.hidden, self.dim)):
            out.append(rng.standard_normal((a, b)).astype(np.float32) * np.float32((2 / a) ** 0.5))
        return out

    def __call__(self, distinct_kmers: DataFrame) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            weights = None
            for whole in batches:
                weights = weights or self.weights()
                for start in range(0, whole.num_rows, 256):
                    batch = whole.slice(start, 256)
                    unit = forward(one_hot_rows(batch.column(0).to_pylist(), self.order, self.gaps), weights)
                    offsets = pa.array(np.arange(0, unit.size + 1, unit.shape[1], dtype=np.int32))
                    yield pa.record_batch([batch.column(0), pa.ListArray.from_arrays(offsets, pa.array(unit.ravel()))], names=["kmer", "embedding"])

        rows = over_all_cores(distinct_kmers.select("kmer"), "kmer").where(F.length("kmer") == self.k)
        return rows.mapInArrow(run, "kmer string, embedding array<float>")


def forward(x: np.ndarray, weights: list[np.ndarray]) -> np.ndarray:
    """Unit vectors of one-hot rows (n, k, 16): all but the last two weights are convolutions of kernel 3."""
    for w in weights[:-2]:
        x = np.maximum(np.concatenate([x[:, :-2], x[:, 1:-1], x[:, 2:]], axis=2) @ w, 0)
        x = x[:, : x.shape[1] // 2 * 2].reshape(len(x), -1, 2, x.shape[2]).max(2)
    x = np.maximum(x.reshape(len(x), -1) @ weights[-2], 0) @ weights[-1]
    return (x / (np.linalg.norm(x, axis=1, keepdims=True) + 1e-30)).astype(np.float32)


def one_hot_rows(texts: list[str], order: str, gaps: str) -> np.ndarray:
    """(n, k, 16) one-hot rows of k-mers of one length; unknown and lower-case symbols give zero rows."""
    place = np.full(256, 16, np.uint8)
    for i, c in enumerate(order):
        place[ord(c)] = i
    for c in gaps:
        place[ord(c)] = 15
    eye = np.vstack([np.eye(16, dtype=np.float32), np.zeros(16, np.float32)])
    return eye[place[np.frombuffer("".join(texts).encode("latin-1", "replace"), np.uint8)]].reshape(len(texts), -1, 16)

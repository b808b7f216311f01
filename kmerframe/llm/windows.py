"""Vectorised windows over folded sequences, for use on the Arrow batches inside Spark tasks.

Folded means upper case with U read as T. A window is w consecutive symbols, all of A, C, G, T;
it is packed with two bits a symbol, A=0, C=1, G=2, T=3, the first symbol in the highest bits.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SYMBOLS = b"ACGT"
BAD = 4

CODE = np.full(256, BAD, np.uint8)
for _code, _symbol in enumerate(SYMBOLS):
    CODE[_symbol] = CODE[ord(chr(_symbol).lower())] = _code
CODE[ord("U")] = CODE[ord("u")] = CODE[ord("T")]


@dataclass
class Symbols:
    """The symbols of a batch laid end to end; row r holds codes[starts[r]:starts[r + 1]]."""

    codes: np.ndarray
    starts: np.ndarray

    def windows(self, w: int) -> tuple[np.ndarray, np.ndarray]:
        """Places of all windows of w in the batch and their packed codes (w of at most 31)."""
        at = self.places(w)
        return at, packed(self.codes, w)[at] if len(at) else np.zeros(0, np.int64)

    def places(self, w: int) -> np.ndarray:
        """Places in the batch where a window of w begins, none of it outside its row."""
        n = len(self.codes) - w + 1
        if n <= 0:
            return np.zeros(0, np.int64)
        bad = np.zeros(len(self.codes) + 1, np.int32)
        np.cumsum(self.codes == BAD, out=bad[1:])
        good = bad[w:] == bad[:n]
        # rows that end at or before a place; a window that lies in one row has no end within
        ends = np.cumsum(np.bincount(self.starts[1:-1], minlength=len(self.codes) + 1)[: len(self.codes)].astype(np.int32), dtype=np.int32)
        good &= ends[w - 1 :] == ends[:n]
        return np.flatnonzero(good)

    def rows(self, at: np.ndarray) -> np.ndarray:
        """The row of each place."""
        return np.searchsorted(self.starts, at, side="right") - 1


def symbols(column: pa.Array) -> Symbols:
    """The symbols of a string column; null reads as empty. One place per character, also outside ASCII."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column, "").cast(pa.string())
    if len(column) and pc.all(pc.string_is_ascii(column)).as_py():  # bytes are characters
        starts = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
        raw = column.buffers()[2]
        held = np.frombuffer(raw, np.uint8)[starts[0] : starts[-1]] if raw is not None else np.zeros(0, np.uint8)
        return Symbols(CODE[held], starts - starts[0])
    texts = [x.encode("latin-1", "replace") for x in column.to_pylist()]
    starts = np.concatenate([[0], np.cumsum([len(x) for x in texts], dtype=np.int64)]).astype(np.int64)
    return Symbols(CODE[np.frombuffer(b"".join(texts), np.uint8)], starts)


def packed(codes: np.ndarray, w: int) -> np.ndarray:
    """Packed codes of the w symbols from each place on, by doubling; bad symbols count as A."""
    part, have = (codes & 3).astype(np.int64), 1
    whole, done = None, 0
    while True:
        if w & have:
            tail = part[done:] if done else part
            if whole is None:
                whole = tail
            else:
                n = min(len(whole), len(tail))
                whole = (whole[:n] << (2 * have)) | tail[:n]
            done += have
        if done == w:
            return whole
        n = len(part) - have
        if n <= 0:
            return np.zeros(0, np.int64)
        part, have = (part[:n] << (2 * have)) | part[have : have + n], have * 2


def unpacked(codes: np.ndarray, w: int) -> pa.Array:
    """The text of packed windows."""
    if not len(codes):
        return pa.array([], pa.string())
    shifts = np.arange(2 * (w - 1), -1, -2, dtype=np.int64)
    letters = np.frombuffer(SYMBOLS, np.uint8)[(codes[:, None] >> shifts) & 3]
    offsets = np.arange(0, (len(codes) + 1) * w, w, dtype=np.int32)
    return pa.StringArray.from_buffers(len(codes), pa.py_buffer(offsets.tobytes()), pa.py_buffer(np.ascontiguousarray(letters).tobytes()))


def mixed(x: np.ndarray, seed: int = 0) -> np.ndarray:
    """A 64-bit finaliser (xor-shift and multiply) over integer tokens, as uint64."""
    x = x.astype(np.uint64) + np.uint64((seed * 0x9E3779B97F4A7C15 + 0x632BE59BD9B4E019) % 2**64)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))

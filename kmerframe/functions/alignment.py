"""Smith-Waterman local alignment of many pairs at once, for the Arrow batches inside Spark tasks.

Gaps cost `opened` for their first symbol and `extended` for each further one; scores are never below 0.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from kmerframe.runtime import over_all_cores

#: Order of the symbols in the matrix below; other symbols count as N, U as T.
MATRIX_SYMBOLS = "ACGTRYSWKMBDHVN"
#: The public nucleotide matrix NUC.4.4. Fixed values.
NUC44 = np.array(
    [
        [5, -4, -4, -4, 1, -4, -4, 1, -4, 1, -4, -1, -1, -1, -2],
        [-4, 5, -4, -4, -4, 1, 1, -4, -4, 1, -1, -4, -1, -1, -2],
        [-4, -4, 5, -4, 1, -4, 1, -4, 1, -4, -1, -1, -4, -1, -2],
        [-4, -4, -4, 5, -4, 1, -4, 1, 1, -4, -1, -1, -1, -4, -2],
        [1, -4, 1, -4, -1, -4, -2, -2, -2, -2, -3, -1, -3, -1, -1],
        [-4, 1, -4, 1, -4, -1, -2, -2, -2, -2, -1, -3, -1, -3, -1],
        [-4, 1, 1, -4, -2, -2, -1, -4, -2, -2, -1, -3, -3, -1, -1],
        [1, -4, -4, 1, -2, -2, -4, -1, -2, -2, -3, -1, -1, -3, -1],
        [-4, -4, 1, 1, -2, -2, -2, -2, -1, -4, -1, -1, -3, -3, -1],
        [1, 1, -4, -4, -2, -2, -2, -2, -4, -1, -3, -3, -1, -1, -1],
        [-4, -1, -1, -1, -3, -1, -1, -3, -1, -3, -1, -2, -2, -2, -1],
        [-1, -4, -1, -1, -1, -3, -3, -1, -1, -3, -2, -1, -2, -2, -1],
        [-1, -1, -4, -1, -3, -1, -3, -1, -3, -1, -2, -2, -1, -2, -1],
        [-1, -1, -1, -4, -1, -3, -1, -3, -3, -1, -2, -2, -2, -1, -1],
        [-2, -2, -2, -2, -1, -1, -1, -1, -1, -1, -1, -1, -1, -1, -1],
    ],
    np.int32,
)
_INDEX = np.full(256, len(MATRIX_SYMBOLS) - 1, np.uint8)
for _i, _c in enumerate(MATRIX_SYMBOLS):
    _INDEX[ord(_c)] = _INDEX[ord(_c.lower())] = _i
_INDEX[ord("U")] = _INDEX[ord("u")] = MATRIX_SYMBOLS.index("T")
#: A symbol that matches nothing, for padding.
_PAD = len(MATRIX_SYMBOLS)


def simple_matrix(match: int, mismatch: int, n: int = 0) -> np.ndarray:
    """match on the diagonal, mismatch elsewhere, n against N."""
    m = np.full((len(MATRIX_SYMBOLS),) * 2, mismatch, np.int32)
    np.fill_diagonal(m, match)
    m[-1, :] = m[:, -1] = n
    return m


def _padded(texts: list[str], width: int) -> np.ndarray:
    out = np.full((len(texts), width), _PAD, np.uint8)
    for row, text in enumerate(texts):
        raw = np.frombuffer(text.encode("latin-1", "replace"), np.uint8)
        out[row, : len(raw)] = _INDEX[raw]
    return out


def scores(a: list[str], b: list[str], matrix: np.ndarray = NUC44, opened: int = 3, extended: int = 1) -> np.ndarray:
    """Best local score of each pair. One step per symbol of a, over all pairs and all of b at once."""
    if not a:
        return np.zeros(0, np.int64)
    n, m = max(map(len, a)), max(map(len, b))
    if not n or not m:
        return np.zeros(len(a), np.int64)
    bad = -(1 << 20)
    table = np.full((len(MATRIX_SYMBOLS) + 1,) * 2, bad, np.int32)
    table[:-1, :-1] = matrix
    x, y = _padded(a, n), _padded(b, m)
    ramp = np.arange(m, dtype=np.int32) * extended
    above = np.zeros((len(a), m + 1), np.int32)
    vertical = np.full((len(a), m), bad, np.int32)
    best = np.zeros(len(a), np.int32)
    for i in range(n):
        t = np.maximum(np.maximum(above[:, :-1] + table[x[:, i][:, None], y], vertical), 0)
        # a gap along b that ends at j: the best start l < j, less opened and extended for each further symbol
        reach = np.maximum.accumulate(t + ramp, axis=1)
        h = t.copy()
        h[:, 1:] = np.maximum(h[:, 1:], reach[:, :-1] - ramp[1:] - (opened - extended))
        vertical = np.maximum(vertical - extended, h - opened)
        above[:, 1:] = h
        np.maximum(best, np.where(x[:, i] == _PAD, 0, h.max(1)), out=best)
    return best.astype(np.int64)


def traced(a: str, b: str, matrix: np.ndarray = NUC44, opened: int = 3, extended: int = 1) -> list[tuple[int, int]]:
    """The aligned places (i, j) of one best local alignment, gaps left out."""
    n, m = len(a), len(b)
    x, y = _padded([a], max(n, 1))[0], _padded([b], max(m, 1))[0]
    h, e, f = (np.zeros((n + 1, m + 1), np.int64) for _ in range(3))
    e[:], f[:] = -(1 << 20), -(1 << 20)
    for i in range(1, n + 1):
        for j in range(1, m + 1):
            e[i, j] = max(e[i - 1, j] - extended, h[i - 1, j] - opened)
            f[i, j] = max(f[i, j - 1] - extended, h[i, j - 1] - opened)
            h[i, j] = max(0, h[i - 1, j - 1] + matrix[x[i - 1], y[j - 1]], e[i, j], f[i, j])
    i, j = (int(v) for v in np.unravel_index(h.argmax(), h.shape))
    path: list[tuple[int, int]] = []
    state = h
    while i > 0 and j > 0:
        if state is h:
            if h[i, j] == 0:
                break
            if h[i, j] == h[i - 1, j - 1] + matrix[x[i - 1], y[j - 1]]:
                i, j = i - 1, j - 1
                path.append((i, j))
            else:
                state = e if h[i, j] == e[i, j] else f
        elif state is e:
            state = h if e[i, j] == h[i - 1, j] - opened else e
            i -= 1
        else:
            state = h if f[i, j] == h[i, j - 1] - opened else f
            j -= 1
    return path[::-1]


def concordance(a: str, b: str, k: int) -> float:
    """Equal symbols at the aligned places of a best alignment, per k."""
    return sum(a[i] == b[j] for i, j in traced(a, b)) / k


def concordances(a: list[str], b: list[str], k: int, matrix: np.ndarray = NUC44, opened: int = 3, extended: int = 1) -> np.ndarray:
    """concordance of each pair. Directions are kept as one byte a cell and all pairs of a block are traced together."""
    out = np.zeros(len(a))
    order = sorted(range(len(a)), key=lambda i: (len(a[i]), len(b[i])))
    start = 0
    while start < len(order):
        stop, n, m = start, 1, 1
        while stop < len(order) and max(n, len(a[order[stop]])) * max(m, len(b[order[stop]])) * (stop - start + 1) <= BLOCK_CELLS:
            n, m = max(n, len(a[order[stop]])), max(m, len(b[order[stop]]))
            stop += 1
        stop = max(stop, start + 1)
        part = order[start:stop]
        out[part] = _equal_places([a[i] for i in part], [b[i] for i in part], matrix, opened, extended) / k
        start = stop
    return out


_LIVE, _DIAGONAL, _DOWN, _DOWN_OPENED, _ALONG_OPENED = 1, 2, 4, 8, 16


def _equal_places(a: list[str], b: list[str], matrix: np.ndarray, opened: int, extended: int) -> np.ndarray:
    """Equal symbols at the aligned places of a best alignment of each pair, the first one in the order of traced."""
    n, m = max(map(len, a)), max(map(len, b))
    if not n or not m:
        return np.zeros(len(a), np.int64)
    bad = -(1 << 20)
    table = np.full((len(MATRIX_SYMBOLS) + 1,) * 2, bad, np.int32)
    table[:-1, :-1] = matrix
    x, y = _padded(a, n), _padded(b, m)
    ramp = np.arange(m, dtype=np.int32) * extended
    above = np.zeros((len(a), m + 1), np.int32)
    down = np.full((len(a), m), bad, np.int32)
    codes = np.zeros((len(a), n, m), np.uint8)
    best, at_i, at_j = (np.zeros(len(a), np.int64) for _ in range(3))
    for i in range(n):
        diagonal = above[:, :-1] + table[x[:, i][:, None], y]
        t = np.maximum(np.maximum(diagonal, down), 0)
        along = np.full_like(t, bad)
        along[:, 1:] = np.maximum.accumulate(t + ramp, axis=1)[:, :-1] - ramp[1:] - (opened - extended)
        h = np.maximum(t, along)
        codes[:, i] = _LIVE * (h > 0) | _DIAGONAL * (h == diagonal) | _DOWN * (h == down) | _DOWN_OPENED * (down == above[:, 1:] - opened)
        codes[:, i, 1:] |= (_ALONG_OPENED * (along[:, 1:] == h[:, :-1] - opened)).astype(np.uint8)
        top = np.where(x[:, i] == _PAD, 0, h.max(1))
        better = top > best
        best, at_i, at_j = np.where(better, top, best), np.where(better, i + 1, at_i), np.where(better, h.argmax(1) + 1, at_j)
        down = np.maximum(down - extended, h - opened)
        above[:, 1:] = h
    one = lambda texts, width: np.stack([np.pad(np.frombuffer(t.encode("utf-32-le"), np.uint32), (0, width - len(t))) for t in texts])
    ra, rb = one(a, n), one(b, m)
    equal, state = np.zeros(len(a), np.int64), np.zeros(len(a), np.int8)
    live = np.flatnonzero(best > 0)
    while len(live):
        i, j, s = at_i[live], at_j[live], state[live]
        code = codes[live, i - 1, j - 1]
        stop = (s == 0) & (code & _LIVE == 0)
        diagonal = (s == 0) & ~stop & (code & _DIAGONAL > 0)
        equal[live] += diagonal & (ra[live, i - 1] == rb[live, j - 1])
        state[live] = np.where(s == 0, np.where(diagonal | stop, 0, np.where(code & _DOWN > 0, 1, 2)), np.where(code & np.where(s == 1, _DOWN_OPENED, _ALONG_OPENED) > 0, 0, s))
        at_i[live], at_j[live] = i - (diagonal | (s == 1)), j - (diagonal | (s == 2))
        live = live[~stop & (at_i[live] > 0) & (at_j[live] > 0)]
    return equal


#: Cells of a block of pairs in one step, so that memory has a bound whatever the lengths.
BLOCK_CELLS = 2_000_000


def _scored(batches: Iterator[pa.RecordBatch], matrix: np.ndarray, opened: int, extended: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        a, b = (["" if x is None else x for x in batch.column(i).to_pylist()] for i in (0, 1))
        order = sorted(range(len(a)), key=lambda i: (len(a[i]), len(b[i])))  # pairs of one length need no padding
        out = np.zeros(len(a), np.int64)
        start = 0
        while start < len(order):
            stop, width = start, 0
            while stop < len(order) and max(width, len(b[order[stop]]), 1) * (stop - start + 1) <= max(BLOCK_CELLS, len(b[order[stop]])):
                width = max(width, len(b[order[stop]]))
                stop += 1
            stop = max(stop, start + 1)
            part = order[start:stop]
            out[part] = scores([a[i] for i in part], [b[i] for i in part], matrix, opened, extended)
            start = stop
        yield pa.record_batch([*batch.columns, pa.array(out)], names=[*batch.schema.names, "score"])


def with_scores(pairs: DataFrame, a: str, b: str, matrix: np.ndarray = NUC44, opened: int = 3, extended: int = 1) -> DataFrame:
    """pairs with a column score, the best local alignment of the texts in a and b; a null text counts as empty (0).

    Send only ids and the two texts, and make pairs distinct before: a Python stage is a fence for the optimiser.
    """
    rest = [c for c in pairs.columns if c not in (a, b)]
    rows = over_all_cores(pairs.select(a, b, *rest), *(rest or [a, b]))
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields)
    return rows.mapInArrow(lambda x: _scored(x, matrix, opened, extended), fields + ", score long")

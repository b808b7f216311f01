"""Problem 5: stretches of a read that stand verbatim in another record.

1. Compact windows. Tokens are the windows of TOKEN symbols; a span of `width` symbols holds width - TOKEN + 1 of
   them. For each hash function the tokens of a read form a Cartesian tree with the smallest hash on top: every
   node that is wide enough gives one compact window, the set of all spans whose smallest token is that node.
   Equal spans have equal smallest tokens under every hash function, so spans that share nothing with another
   record drop out where the token of their compact window is in one record only.
2. Interval join. A span can be shared only if it lies in surviving compact windows of every hash function; the
   intervals of the functions are joined per record and place, and cut with each other.
3. Verification. Equal spans have their smallest token in common, so spans are compared within its compact window: a
   window goes to the task of its token as one row, with the text of all its spans, and is cut into spans there. Spans are packed
   whole (two bits a symbol, 64 symbols in two numbers, so equal numbers are equal text); those that two records have
   are shared, and come out as intervals. No pairs are made, however many records share a span.

Hot groups. Whether two records share a token is told by its smallest and largest record, which are combined before the
shuffle. Tokens of more than HEAVY compact windows are not gathered by token: their spans are shuffled one by one, by their own text, and
scanned in that order; of a text the scan keeps only the places of its first record, until a second one comes. A span that
several records of a batch hold is known to be shared before the shuffle: its places go on as intervals of their
record, and of the span one row alone is sent to tell other batches. So a span in a third of all records costs a row per batch.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kmerframe.llm.reads import once
from kmerframe.llm.windows import mixed, packed, symbols
from kmerframe.runtime import bounded, cut, shuffle_width

WIDTH = 64
TOKEN = 24
HASHES = 2
BIN = 1024
#: A token of more compact windows than this is not gathered in one task; at most so many rows of a token are held.
HEAVY = 4096

_COMPACT = pa.schema([("rec", pa.int64()), ("f", pa.int32()), ("token", pa.int64()), ("a", pa.int32()), ("b", pa.int32())])
#: A place of a text that only its record has in the batch, a text that several records have, an interval of shared places, and the
#: spans of a compact window. The key is the packed text, or the token and NO_TEXT.
PLACE, WITNESS, INTERVAL, WINDOW = 0, 1, 2, 3
NO_TEXT = -1
_PLACES = pa.schema([("k1", pa.int64()), ("k2", pa.int64()), ("kind", pa.int8()), ("rec", pa.int64()), ("a", pa.int32()), ("b", pa.int32()), ("text", pa.binary())])
_INTERVALS = pa.schema([("rec", pa.int64()), ("a", pa.int32()), ("b", pa.int32())])


def compact_windows(key: np.ndarray, low: np.ndarray, high: np.ndarray, span: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(l, c, r) of all nodes of at least `span` tokens of the Cartesian trees over key[low[i]..high[i]].

    All trees are built at once, level by level: the smallest of each interval is its node, what lies left and right
    of it are the intervals of the next level. key is unique; intervals are disjoint and in order.
    """
    key = np.append(key, np.uint64(np.iinfo(np.uint64).max))
    bits = np.uint64(len(key).bit_length())
    key = ((key >> bits) << bits) | np.arange(len(key), dtype=np.uint64)
    found = []
    keep = high - low + 1 >= span
    low, high = low[keep], high[keep]
    while len(low):
        least = np.minimum.reduceat(key, np.stack([low, high + 1], 1).ravel())[::2]
        at = (least & ((np.uint64(1) << bits) - np.uint64(1))).astype(np.int64)
        found.append((low, at, high))
        low, high = np.stack([low, at + 1], 1).ravel(), np.stack([at - 1, high], 1).ravel()
        keep = high - low + 1 >= span
        low, high = low[keep], high[keep]
    if not found:
        return (np.zeros(0, np.int64),) * 3
    return tuple(np.concatenate(x) for x in zip(*found, strict=True))


def _compact(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[pa.RecordBatch]:
    span = width - TOKEN + 1
    for batch in bounded(batches, 1):
        s = symbols(batch.column(1))
        at, token = s.windows(TOKEN)
        if not len(at):
            continue
        breaks = np.flatnonzero(np.diff(at) != 1)
        low, high = np.concatenate([[0], breaks + 1]), np.append(breaks, len(at) - 1)
        rec = batch.column(0).to_numpy()
        for f in range(HASHES):
            left, c, right = compact_windows(mixed(token, f), low, high, span)
            row = s.rows(at[c])
            offset = s.starts[row]
            yield pa.record_batch(
                [
                    pa.array(rec[row]), pa.array(np.full(len(c), f, np.int32)), pa.array(token[c]),
                    pa.array((at[np.maximum(left, c - span + 1)] - offset).astype(np.int32)),
                    pa.array((at[np.minimum(c, right - span + 1)] - offset).astype(np.int32)),
                ],
                schema=_COMPACT,
            )


def _in_two(k1: np.ndarray, k2: np.ndarray, rec: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which places hold a text that places of another record hold too, and one place of each such text."""
    order = np.lexsort((k2, k1))
    first = np.flatnonzero(np.concatenate([[True], (np.diff(k1[order]) != 0) | (np.diff(k2[order]) != 0)]))
    several = np.minimum.reduceat(rec[order], first) != np.maximum.reduceat(rec[order], first)
    shared = np.empty(len(k1), bool)
    shared[order] = np.repeat(several, np.diff(np.append(first, len(k1))))
    return shared, order[first[several]]


def _stretches(shared: np.ndarray, row: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and last index of each run of shared places that follow each other in one row; rows and starts are in order."""
    here = np.flatnonzero(shared)
    if not len(here):
        return here, here
    breaks = np.flatnonzero((np.diff(row[here]) != 0) | (np.diff(start[here]) != 1))
    return here[np.concatenate([[0], breaks + 1])], here[np.append(breaks, len(here) - 1)]


def _runs_of(begin: np.ndarray, size: np.ndarray) -> np.ndarray:
    """begin[0], begin[0] + 1, ... size[0] numbers, then begin[1], ..."""
    return np.repeat(begin - (np.cumsum(size) - size), size) + np.arange(size.sum())


def _packed_spans(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[pa.RecordBatch]:
    half = width // 2
    for batch in bounded(batches, 1):
        s = symbols(batch.column(1))
        spans = batch.column(2)
        inner = spans.flatten()
        row = np.repeat(np.arange(batch.num_rows), np.diff(spans.offsets.to_numpy()))
        a, b, token = (inner.field(i).to_numpy() for i in range(3))
        heavy = inner.field(3).to_numpy(zero_copy_only=False)
        recs = batch.column(0).to_numpy()
        if not heavy.all():
            r, a_, b_ = row[~heavy], a[~heavy], b[~heavy]
            size = (b_ - a_ + width).astype(np.int64)
            text = s.codes[_runs_of(s.starts[r] + a_, size)]
            ends = np.concatenate([[0], np.cumsum(size)]).astype(np.int32)
            texts = pa.Array.from_buffers(pa.binary(), len(r), [None, pa.py_buffer(ends.tobytes()), pa.py_buffer(text.tobytes())])
            none = np.full(len(r), NO_TEXT, np.int64)
            yield pa.record_batch([pa.array(token[~heavy]), pa.array(none), pa.array(np.full(len(r), WINDOW, np.int8)), pa.array(recs[r]), pa.array(a_), pa.array(b_), texts], schema=_PLACES)
        if not heavy.any():
            continue
        r, a_, b_ = row[heavy], a[heavy], b[heavy]
        at = np.unique(_runs_of(s.starts[r] + a_, (b_ - a_ + 1).astype(np.int64)))
        halves = packed(s.codes, half)
        r, k1, k2 = s.rows(at), halves[at], halves[at + width - half]
        rec, start = recs[r], (at - s.starts[r]).astype(np.int32)
        shared, told = _in_two(k1, k2, rec)
        low, high = _stretches(shared, r, start)
        alone = np.flatnonzero(~shared)
        pick = np.concatenate([alone, told, low])
        kind = np.repeat(np.array([PLACE, WITNESS, INTERVAL], np.int8), [len(alone), len(told), len(low)])
        end = np.concatenate([start[alone], start[told], start[high]])
        yield pa.record_batch([pa.array(k1[pick]), pa.array(k2[pick]), pa.array(kind), pa.array(rec[pick]), pa.array(start[pick]), pa.array(end), pa.nulls(len(pick), pa.binary())], schema=_PLACES)


def _of_windows(rows: pa.Table, width: int) -> pa.RecordBatch:
    """The intervals of shared spans of compact windows; all rows of a token are there."""
    half = width // 2
    text = rows.column("text").combine_chunks()
    begin = np.frombuffer(text.buffers()[1], np.int32)[text.offset : text.offset + len(text) + 1].astype(np.int64)
    codes = np.frombuffer(text.buffers()[2], np.uint8)[begin[0] : begin[-1]]
    begin -= begin[0]
    many = np.diff(begin) - width + 1
    at = _runs_of(begin[:-1], many)
    row = np.repeat(np.arange(len(many)), many)
    halves = packed(codes, half)
    rec = rows.column("rec").to_numpy()[row]
    start = rows.column("a").to_numpy()[row] + (at - begin[row])
    shared, _ = _in_two(halves[at], halves[at + width - half], rec)
    low, high = _stretches(shared, row, start)
    return pa.record_batch([pa.array(rec[low]), pa.array(start[low].astype(np.int32)), pa.array(start[high].astype(np.int32))], schema=_INTERVALS)


def _verified(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[pa.RecordBatch]:
    """The intervals (rec, a, b) of shared places, from rows in order of their key. Windows of a token are held until the next token comes."""
    held: pa.Table | None = None

    def others() -> Iterator[pa.RecordBatch]:
        nonlocal held
        for batch in batches:
            kind = batch.column(2).to_numpy()
            of_window = kind == WINDOW
            if of_window.any():
                rows = pa.Table.from_batches([batch.filter(pa.array(of_window))])
                rows = rows if held is None else pa.concat_tables([held, rows])
                token = rows.column("k1").to_numpy()
                last = int(np.searchsorted(token, token[-1]))
                if last:
                    ready.append(_of_windows(rows.slice(0, last), width))
                held = rows.slice(last)
            yield batch.filter(pa.array(~of_window)).select(list(range(6))) if of_window.any() else batch.select(list(range(6)))

    ready: list[pa.RecordBatch] = []
    for out in _shared(others()):
        yield from ready
        ready.clear()
        yield out
    yield from ready
    if held is not None:
        yield _of_windows(held, width)


def _shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The intervals (rec, a, b) of shared places, from rows in order of text. A text may go on over many batches: what is held of it
    is its key if it is known to be shared, else the places of its one record."""
    held: list[np.ndarray] | None = None
    known: tuple[int, int] | None = None
    for batch in batches:
        if not batch.num_rows:
            continue
        columns = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
        if held is not None:
            columns = [np.concatenate(x) for x in zip(held, columns, strict=True)]
        k1, k2, kind, rec, a, b = columns
        first = np.flatnonzero(np.concatenate([[True], (np.diff(k1) != 0) | (np.diff(k2) != 0)]))
        ours = kind != INTERVAL
        low = np.minimum.reduceat(np.where(ours, rec, np.iinfo(np.int64).max), first)
        high = np.maximum.reduceat(np.where(ours, rec, np.iinfo(np.int64).min), first)
        several = (low < high) | np.maximum.reduceat(kind == WITNESS, first)
        if known == (k1[0], k2[0]):
            several[0] = True
        sizes = np.diff(np.append(first, len(k1)))
        out = (kind == INTERVAL) | ((kind == PLACE) & np.repeat(several, sizes))
        yield pa.record_batch([pa.array(rec[out]), pa.array(a[out]), pa.array(b[out])], schema=_INTERVALS)
        known = (k1[-1], k2[-1]) if several[-1] else None
        rest = (np.arange(len(k1)) >= first[-1]) & (kind == PLACE)
        held = None if several[-1] or not rest.any() else [c[rest] for c in columns]


def _binned(df: DataFrame, a: str, b: str, *more: str) -> DataFrame:
    return df.select("rec", F.col("a").alias(a), F.col("b").alias(b), *more, F.explode(F.expr(f"sequence(a div {BIN}, b div {BIN})")).alias("bin"))


def shared_stretches(reads: DataFrame, refs: DataFrame, width: int = WIDTH, heavy: int = HEAVY) -> DataFrame:
    """(seq_id, off, len): the longest unbroken stretches of shared symbols of each read.

    A symbol is shared if it lies in a window of `width` (even, at most 64) that also occurs in another read or in
    a sequence of refs; repeats within one read alone don't count. Offsets count from 0 in the stored sequence.
    Repeated reads count once; null and empty sequences, and windows with other symbols than A, C, G, T give nothing.
    Ids may be any 63-bit numbers. Extra columns are ignored. heavy: see HEAVY; it changes the way of the rows only.
    """
    records = (
        once(reads).select(F.shiftleft("seq_id", 1).alias("rec"), F.col("sequence").alias("s"))
        .unionByName(once(refs, "ref_id").select(F.shiftleft("ref_id", 1).bitwiseOR(F.lit(1)).alias("rec"), F.col("sequence").alias("s")))
    )
    compact = cut(records.mapInArrow(lambda x: _compact(x, width), "rec long, f int, token long, a int, b int"))
    tokens = compact.groupBy("f", "token").agg(F.min("rec").alias("lo"), F.max("rec").alias("hi"), F.count("*").alias("n")).where("lo < hi")
    alive = compact.join(tokens.select("f", "token", (F.col("n") > heavy).alias("heavy")), ["f", "token"])
    spans = alive.where("f = 0").select("rec", "a", "b", "token", "heavy")
    for f in range(1, HASHES):
        spans = (
            _binned(spans, "a", "b", "token", "heavy").join(_binned(alive.where(f"f = {f}"), "c", "d"), ["rec", "bin"])
            .where(f"a <= d AND c <= b AND greatest(a, c) div {BIN} = bin")
            .select("rec", F.greatest("a", "c").alias("a"), F.least("b", "d").alias("b"), "token", "heavy")
        )
    spans = cut(spans.groupBy("rec").agg(F.collect_list(F.struct("a", "b", "token", "heavy")).alias("spans")))
    places = records.join(spans, "rec").select("rec", "s", "spans").mapInArrow(lambda x: _packed_spans(x, width), "k1 long, k2 long, kind byte, rec long, a int, b int, text binary")
    sorted_places = places.repartition(max(shuffle_width(reads.sparkSession), reads.sparkSession.sparkContext.defaultParallelism), "k1", "k2").sortWithinPartitions("k1", "k2")
    hits = sorted_places.mapInArrow(lambda x: _verified(x, width), "rec long, a int, b int").where("rec & 1 = 0")
    by_place = Window.partitionBy("rec").orderBy("a", "b")
    runs = (
        hits.withColumn("new", F.when(F.col("a") - F.max("b").over(by_place.rowsBetween(Window.unboundedPreceding, -1)) <= width, 0).otherwise(1))
        .withColumn("run", F.sum("new").over(by_place))
    )
    return runs.groupBy("rec", "run").agg(F.min("a").alias("off"), F.max("b").alias("end")).select(
        F.shiftright("rec", 1).alias("seq_id"), F.col("off").cast("int").alias("off"), (F.col("end") + width - F.col("off")).cast("int").alias("len")
    )


def shared_share(reads: DataFrame, refs: DataFrame, width: int = WIDTH) -> DataFrame:
    """(seq_id, length, shared): of each read, its symbols and how many of them are shared (see shared_stretches); 0 for none. One row for
    each seq_id with a sequence, the empty one included."""
    stretches = shared_stretches(reads, refs, width).groupBy("seq_id").agg(F.sum("len").alias("shared"))
    lengths = once(reads).select("seq_id", F.length("sequence").cast("long").alias("length"))
    return lengths.join(stretches, "seq_id", "left").select("seq_id", "length", F.coalesce("shared", F.lit(0)).alias("shared"))

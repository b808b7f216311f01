"""Problem 4: how often every term occurs and in how many records.

Terms are windows of the folded sequence. Each task sorts its (term, record) pairs in bounded runs
and scans them run-length into partial counts; the runs are range-partitioned by (width, term), sorted by
Spark's external sort, and scanned once more. A record lies wholly in one run, so partial numbers
of records add up; a term reaches the shuffle at most once per run, however common it is.

The bounds of the ranges are quantiles of the terms of a bounded sample of the records, so that frequent prefixes have many
ranges and no task gets more than its share. The sample decides only which task counts a term. Partition i holds the i-th range,
so the counts come out in order.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kmerframe.llm.reads import once
from kmerframe.llm.windows import mixed, symbols, unpacked
from kmerframe.runtime import bounded, shuffle_width

#: Records, at most about, that the bounds of the ranges are taken from.
SAMPLE_READS = 5_000
RARE_READS = 1
COMMON_PER = 20  # common: found in at least one of so many reads (5 %)
RUN_SYMBOLS = 2_000_000

#: Bits of the sieve that holds the recorded terms; its size is the same for any number of them.
SIEVE_BITS = 25

COUNTS = pa.schema([("w", pa.int32()), ("part", pa.int32()), ("term", pa.int64()), ("occurrences", pa.int64()), ("records", pa.int64())])


def _sieve_places(term: np.ndarray) -> np.ndarray:
    return (mixed(term, 21) >> np.uint64(64 - SIEVE_BITS)).astype(np.int64)


def _sieve_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        place = _sieve_places(batch.column(0).to_numpy())
        yield pa.record_batch([pa.array((place >> 6).astype(np.int32)), pa.array(np.int64(1) << (place & 63))], names=["word", "bits"])


def sieve_of(terms: DataFrame) -> np.ndarray:
    """A bit per hash value of the packed terms of a one-column table. 4 MB at most reach the driver, however many terms."""
    words = terms.mapInArrow(_sieve_rows, "word int, bits long").groupBy("word").agg(F.bit_or("bits").alias("bits")).toArrow()
    sieve = np.zeros(1 << (SIEVE_BITS - 6), np.int64)
    sieve[words.column("word").to_numpy()] = words.column("bits").to_numpy()
    return sieve


class Ranges:
    """Which partition a term belongs to: bounds(w) are the first terms of all partitions of w but its first one."""

    def __init__(self, bounds: dict[int, np.ndarray]):
        self.bounds, self.first, at = bounds, {}, 0
        for w in sorted(bounds):
            self.first[w] = at
            at += len(bounds[w]) + 1
        self.parts = max(1, at)

    def of(self, w: int, term: np.ndarray) -> np.ndarray:
        return (self.first[w] + np.searchsorted(self.bounds[w], term, side="right")).astype(np.int32)


def ranges_of(reads: DataFrame, widths: tuple[int, ...], sieves: dict[int, np.ndarray], parts: int) -> Ranges:
    """About `parts` ranges of about equal size. The driver sees `parts` quantiles for each width; an empty sample gives a range per width."""
    usable = reads.where(F.col("seq_id").isNotNull() & F.col("sequence").isNotNull())
    share = F.pmod(F.xxhash64("seq_id"), F.lit(1_000_000)) < F.lit(int(min(1.0, SAMPLE_READS / max(1, reads.count())) * 1_000_000))
    whole = Ranges({w: np.zeros(0, np.int64) for w in widths})
    sample = usable.where(share).select("sequence").mapInArrow(lambda b: _runs(b, widths, sieves, whole), _COUNTS)
    steps = [(i + 1) / parts for i in range(parts - 1)] or [0.5]
    told = {x["w"]: x for x in sample.groupBy("w").agg(F.count("*").alias("n"), F.percentile_approx("term", F.array(*map(F.lit, steps)), F.lit(20 * parts)).alias("q")).collect()}
    total = sum(x["n"] for x in told.values())
    bounds = {}
    for w in widths:
        own = max(1, round(parts * told[w]["n"] / total)) if w in told and total else 1
        quantiles = np.array(told[w]["q"], np.int64) if w in told else np.zeros(0, np.int64)
        at = np.unique((np.arange(1, own) * len(quantiles) // own).astype(np.int64)) if len(quantiles) else np.zeros(0, np.int64)
        bounds[w] = np.unique(quantiles[at])
    return Ranges(bounds)


_COUNTS = "w int, part int, term long, occurrences long, records long"


def _runs(batches: Iterator[pa.RecordBatch], widths: tuple[int, ...], sieves: dict[int, np.ndarray], ranges: Ranges) -> Iterator[pa.RecordBatch]:
    for batch in bounded(batches, 0, RUN_SYMBOLS):
        s = symbols(batch.column(0))
        bits = max(1, batch.num_rows.bit_length())
        for w in widths:
            at, term = s.windows(w)
            if w in sieves:
                place = _sieve_places(term)
                keep = (sieves[w][place >> 6] >> (place & 63)) & 1 == 1
                at, term = at[keep], term[keep]
            if not len(at):
                continue
            if 2 * w + bits < 63:  # one number holds term and record
                pair = (term << bits) | s.rows(at)
                pair.sort()
                new = np.concatenate([[True], pair[1:] != pair[:-1]])
                term = pair >> bits
            else:
                record = s.rows(at)
                order = np.lexsort((record, term))
                term, record = term[order], record[order]
                new = np.concatenate([[True], (term[1:] != term[:-1]) | (record[1:] != record[:-1])])
            first = np.flatnonzero(np.concatenate([[True], term[1:] != term[:-1]]))
            head = term[first]
            yield pa.record_batch(
                [
                    pa.array(np.full(len(head), w, np.int32)),
                    pa.array(ranges.of(w, head)),
                    pa.array(head),
                    pa.array(np.diff(np.append(first, len(term)))),
                    pa.array(np.add.reduceat(new.astype(np.int64), first)),
                ],
                schema=COUNTS,
            )


def _merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sum sorted partial counts by (w, term), with the extremes of the weights recorded for the term.

    The last run of a batch is carried into the next one, so a run may be longer than a batch.
    """
    out = pa.schema([("w", pa.int32()), ("term", pa.int64()), ("occurrences", pa.int64()), ("records", pa.int64()), ("low", pa.int64()), ("high", pa.int64())])
    carried: tuple | None = None
    top = np.iinfo(np.int64)

    def columns(batch: pa.RecordBatch) -> tuple:
        get = lambda name: batch.column(batch.schema.get_field_index(name))
        weight = get("weight")
        return (
            get("w").to_numpy(zero_copy_only=False), get("term").to_numpy(zero_copy_only=False),
            get("occurrences").to_numpy(zero_copy_only=False), get("records").to_numpy(zero_copy_only=False),
            weight.fill_null(top.max).to_numpy(zero_copy_only=False), weight.fill_null(top.min).to_numpy(zero_copy_only=False),
        )

    def batch_of(parts: tuple) -> pa.RecordBatch:
        return pa.record_batch([pa.array(x, t) for x, t in zip(parts, out.types, strict=True)], schema=out)

    for batch in batches:
        if not batch.num_rows:
            continue
        parts = columns(batch)
        if carried is not None:
            parts = tuple(np.concatenate([a, b]) for a, b in zip(carried, parts, strict=True))
        w, term, occurrences, records, low, high = parts
        first = np.flatnonzero(np.concatenate([[True], (term[1:] != term[:-1]) | (w[1:] != w[:-1])]))
        whole = (w[first], term[first], np.add.reduceat(occurrences, first), np.add.reduceat(records, first), np.minimum.reduceat(low, first), np.maximum.reduceat(high, first))
        carried = tuple(x[-1:] for x in whole)
        if len(first) > 1:
            yield batch_of(tuple(x[:-1] for x in whole))
    if carried is not None:
        yield batch_of(carried)


def term_counts(reads: DataFrame, widths: tuple[int, ...], recorded: DataFrame | None = None, sieves: dict[int, np.ndarray] | None = None) -> DataFrame:
    """(w, term, occurrences, records, low, high) of every window of each width in reads(seq_id, sequence), in order of w and term.

    term is packed. recorded(w, term, weight) adds terms with a recorded weight; low and high are the
    smallest and largest weight of a term, the extremes of int64 in reverse where it has none. A width with a
    sieve counts only terms that pass it: those it was made of, with their exact counts, and some others. An empty
    table gives no rows. Any other columns of reads are ignored.
    """
    context = reads.sparkSession.sparkContext
    ranges = ranges_of(reads, widths, sieves or {}, shuffle_width(reads.sparkSession))
    held = context.broadcast((sieves or {}, ranges))  # a sieve and a bound per partition: fixed size
    partial = once(reads).select("sequence").mapInArrow(lambda b: _runs(b, widths, *held.value), _COUNTS).withColumn("weight", F.lit(None).cast("long"))
    if recorded is not None:

        def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                w, term = batch.column(0).to_numpy(), batch.column(1).to_numpy()
                part = np.zeros(len(w), np.int32)
                for width in np.unique(w):
                    part[w == width] = held.value[1].of(int(width), term[w == width])
                none = pa.array(np.zeros(len(w), np.int64))
                yield pa.record_batch([batch.column(0), pa.array(part), batch.column(1), none, none, batch.column(2)], names=["w", "part", "term", "occurrences", "records", "weight"])

        partial = partial.unionByName(recorded.select("w", "term", "weight").mapInArrow(placed, f"{_COUNTS}, weight long"))
    return (
        partial.repartitionById(ranges.parts, F.col("part"))
        .sortWithinPartitions("w", "term")
        .mapInArrow(lambda b: _merged(b), "w int, term long, occurrences long, records long, low long, high long")
    )


def counted_terms(reads: DataFrame, width: int = 10) -> DataFrame:
    """(term, occurrences, records): how often each window of `width` occurs in all reads, and in how many of them, in folded form and
    in order of the terms within and over partitions. Repeated reads count once; see term_counts."""
    return term_counts(reads, (width,)).select("w", "term", "occurrences", "records").mapInArrow(_count_texts, "term string, occurrences long, records long")


def _count_texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        if batch.num_rows:
            yield pa.record_batch([unpacked(batch.column(1).to_numpy(), batch.column(0)[0].as_py()), *batch.columns[2:]], names=["term", "occurrences", "records"])


def _texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        w, term = batch.column(0).to_numpy(), batch.column(1).to_numpy()
        for width in np.unique(w):
            keep = w == width
            yield pa.record_batch([unpacked(term[keep], int(width)), batch.column(2).filter(pa.array(keep))], names=["term", "mark"])


def _packed_column(kmer, width: int):
    """A text of A, C, G, T as its packed number, by reading it in base 4."""
    return F.conv(F.translate(kmer, "ACGT", "0123"), 4, 10).cast("long")


def marked_terms(reads: DataFrame, embeddings: DataFrame, width: int = 10, kmer_width: int = 16) -> DataFrame:
    """(term, mark): rare and common windows of `width`, and k-mers whose recorded weight is wrong.

    rare: found in one read; common: in at least 5 % of the reads and in more than one. miscounted: a row of
    embeddings has a weight that is not null and differs from the number of occurrences in all reads. A kmer
    that cannot occur as a window (wrong length, other symbols) occurs 0 times. Null kmers are left out.
    Each (term, mark) comes once, also from repeated rows. Empty tables give no rows.
    """
    kmers = embeddings.where(F.col("kmer").isNotNull() & F.col("weight").isNotNull()).select(
        F.translate(F.upper("kmer"), "U", "T").alias("kmer"), F.col("weight").cast("long").alias("weight")
    ).distinct()
    window = F.col("kmer").rlike(f"^[ACGT]{{{kmer_width}}}\\z")
    recorded = kmers.where(window).select(
        F.lit(kmer_width).alias("w"), _packed_column(F.col("kmer"), kmer_width).alias("term"), "weight",
    )
    counts = term_counts(reads, (width, kmer_width), recorded, {kmer_width: sieve_of(recorded.select("term"))})
    total = reads.where(F.col("seq_id").isNotNull() & F.col("sequence").isNotNull()).agg(F.count_distinct("seq_id").alias("total"))
    wrong = (F.col("low") <= F.col("high")) & ((F.col("low") != F.col("occurrences")) | (F.col("high") != F.col("occurrences")))
    mark = (
        F.when((F.col("w") == kmer_width) & wrong, "miscounted")
        .when((F.col("w") == width) & (F.col("records") == RARE_READS), "rare")
        .when((F.col("w") == width) & (F.col("records") > 1) & (F.col("records") * COMMON_PER >= F.col("total")), "common")
    )
    marks = counts.crossJoin(F.broadcast(total)).select("w", "term", mark.alias("mark")).where("mark is not null")  # total: one row
    impossible = kmers.where(~window & (F.col("weight") != 0)).select(F.col("kmer").alias("term"), F.lit("miscounted").alias("mark")).distinct()
    return marks.mapInArrow(_texts, "term string, mark string").unionByName(impossible)

"""Problem 6: encoding of whole texts with a public tokenizer.

A text that is longer than `long_chars` characters, or has a run of `run_chars` without white space, is cut in half again and
again, into pieces of at most `piece_chars`. The pieces are spread over the cluster and encoded in parallel, and neighbours are
joined pairwise, level by level of the tree; a round of the job (one shuffle by text and place) joins LEVELS levels, so a task holds
at most 2^LEVELS pieces of a text, however long it is. Around each join a growing window of the text is encoded anew, until its
tokens agree with the left side at one token boundary and with the right side at another; outside the window both sides are right
already. Pieces carry their ids only: ids give back their text. All other texts are encoded as they are, where they are read.

Why the window may stop where it does:
* The splitting pattern reads from left to right, never looks back, and its matches depend on what follows
  by one symbol at most beyond the end of a split (two for the endings such as 're). So splits of the left
  piece that end well before the join are splits of the joined text, and from the first split boundary that
  the window shares with the right piece on, both go on alike.
* Inside one long split the merges are context-free beyond neighbouring tokens: a token sequence is the
  encoding of its text if each pair of neighbours is the encoding of the pair's text. A window whose first
  and last tokens equal the tokens that stood there leaves every pair at its rims as it was.
"""

from __future__ import annotations

import base64
import functools
import itertools
import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kmerframe.runtime import cut, shuffle_width, spread

DEFAULT_VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: The pattern that splits text before merging, as published with the vocabulary.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
LONG_CHARS = 4096
RUN_CHARS = 512
PIECE_CHARS = 2048
#: Levels of the tree that one shuffle joins.
LEVELS = 3
#: Splits kept away from a join: the last ones of the left side may change with what follows.
UNSURE_SPLITS = 2


@functools.lru_cache(maxsize=2)
def encoding(path: str):
    """The tokenizer of a file of ranks, one per Python worker. Strings of special tokens are ordinary text."""
    import tiktoken

    with open(path, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in (x.split() for x in lines if x.strip())}
    return tiktoken.Encoding("ranks", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


@functools.lru_cache(maxsize=1)
def _splitter():
    import regex

    return regex.compile(PATTERN)


def _ids(enc, text: str) -> np.ndarray:
    """The ids of a text; the buffer form, where the library has it, spares a Python integer per token."""
    if not text:
        return np.zeros(0, np.int32)
    buffered = getattr(getattr(enc, "_core_bpe", None), "encode_to_tiktoken_buffer", None)
    return np.frombuffer(buffered(text, set()), np.uint32).astype(np.int32) if buffered else np.array(enc.encode_ordinary(text), np.int32)


def _list_array(parts: list[np.ndarray]) -> pa.Array:
    offsets = np.concatenate([[0], np.cumsum([len(x) for x in parts], dtype=np.int64)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(parts) if parts else np.zeros(0, np.int32), pa.int32()))


def joined(left: tuple[str, np.ndarray], right: tuple[str, np.ndarray], enc, reach: int = 64) -> tuple[str, np.ndarray]:
    """The encoding of left + right from the encodings of both, by a growing window around the join.

    The window begins at a token boundary of the left text and ends at one of the right text, `reach` tokens
    away from the join at first and twice as many each time. If it grows over both texts whole, the result is the
    plain encoding, so the answer is the same for every input.
    """
    (a, x), (b, y) = left, right
    if not a or not b:
        return a + b, x if a else y
    while True:
        n, m = min(reach, len(x)), min(reach, len(y))
        # a token boundary may fall inside a character; take only boundaries between characters
        head, n = _tail_text(enc, x, n, a)
        tail, m = _head_text(enc, y, m, b)
        whole_left, whole_right = n == len(x), m == len(y)
        window = _ids(enc, head + tail)
        if (whole_left or _agree_left(window, x[len(x) - n :], head, enc)) and (whole_right or _agree_right(window, y[:m], head + tail, tail, enc)):
            return a + b, np.concatenate([x[: len(x) - n], window, y[m:]])
        if whole_left and whole_right:
            return a + b, window
        reach *= 2


def _tail_text(enc, ids: np.ndarray, n: int, text: str) -> tuple[str, int]:
    while n < len(ids):
        raw = enc.decode_bytes(ids[len(ids) - n :].tolist())
        if raw[0] & 0xC0 != 0x80:
            return raw.decode("utf-8"), n
        n += 1
    return text, len(ids)


def _head_text(enc, ids: np.ndarray, n: int, text: str) -> tuple[str, int]:
    while n < len(ids):
        after = enc.decode_single_token_bytes(int(ids[n]))
        if after[0] & 0xC0 != 0x80:
            return enc.decode_bytes(ids[:n].tolist()).decode("utf-8"), n
        n += 1
    return text, len(ids)


def _agree_left(window: np.ndarray, tail: np.ndarray, head: str, enc) -> bool:
    """The window begins with tokens of the left side, and what it starts with is settled: either a whole split
    lies between its start and the unsure last ones, or both run on inside one split with the same tokens."""
    same = _common(window, tail)
    if not same:
        return False
    splits = [m.end() for m in _splitter().finditer(head)]
    if len(splits) > UNSURE_SPLITS + 1:
        sure = splits[0]
        return len(enc.decode_bytes(window[:same].tolist())) >= len(head[:sure].encode())
    return len(splits) == 1 and same >= 2


def _agree_right(window: np.ndarray, head: np.ndarray, text: str, tail: str, enc) -> bool:
    """The window ends with tokens of the right side, and a split boundary of the window lies where the right side
    has one too, with the same tokens from there on; or both end inside one split with the same tokens."""
    same = _common(window[::-1], head[::-1])
    if not same:
        return False
    kept = len(enc.decode_bytes(window[len(window) - same :].tolist()))
    cut = len(text) - len(tail)
    ours = [m.start() - cut for m in _splitter().finditer(text)]
    theirs = {m.start() for m in _splitter().finditer(tail)}
    shared = [s for s in ours if s > 0 and s in theirs]
    if len(shared) > UNSURE_SPLITS:
        return kept >= len(tail[shared[0] :].encode())
    return len(theirs) == 1 and same >= 2


def _common(a: np.ndarray, b: np.ndarray) -> int:
    n = min(len(a), len(b))
    differ = np.flatnonzero(a[:n] != b[:n])
    return int(differ[0]) if len(differ) else n


def tree(pieces: list[tuple[str, np.ndarray]], enc) -> np.ndarray:
    """Join neighbouring pieces pairwise until one is left."""
    while len(pieces) > 1:
        pieces = [joined(pieces[i], pieces[i + 1], enc) if i + 1 < len(pieces) else pieces[i] for i in range(0, len(pieces), 2)]
    return pieces[0][1] if pieces else np.zeros(0, np.int32)


def _encode_plain(batches: Iterator[pa.RecordBatch], path: str) -> Iterator[pa.RecordBatch]:
    enc = encoding(path)
    for batch in batches:
        texts = batch.column(1)
        yield pa.record_batch([batch.column(0), _list_array([_ids(enc, x) if x else np.zeros(0, np.int32) for x in texts.to_pylist()])], names=["doc_id", "ids"])


#: A piece of a text: where the text was read (task and row there), its doc_id, the place of the piece, and of how many.
_PIECE = "task int, row long, doc_id long, piece int, pieces int"


def _cut_texts(batches: Iterator[pa.RecordBatch], piece_chars: int) -> Iterator[pa.RecordBatch]:
    """The texts in halves of halves. A piece takes at most piece_chars, a batch about a million characters."""
    task, row = TaskContext.get().partitionId(), 0
    names = ["task", "row", "doc_id", "piece", "pieces", "text"]
    out, held = [], 0
    for batch in batches:
        for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            pieces = 1 << max(1, math.ceil(math.log2(len(text) / piece_chars)))
            step = -(-len(text) // pieces)
            pieces = -(-len(text) // step)
            for i in range(pieces):
                out.append((task, row, doc_id, i, pieces, text[i * step : (i + 1) * step]))
                held += step
                if held > 1_000_000:
                    yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out, strict=True), _CUT_TYPES, strict=True)], names=names)
                    out, held = [], 0
            row += 1
    if out:
        yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out, strict=True), _CUT_TYPES, strict=True)], names=names)


_CUT_TYPES = [pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.string()]


def _encode_pieces(batches: Iterator[pa.RecordBatch], path: str) -> Iterator[pa.RecordBatch]:
    enc = encoding(path)
    for batch in batches:
        yield pa.record_batch([*batch.columns[:5], _list_array([_ids(enc, x) for x in batch.column(5).to_pylist()])], names=[*batch.schema.names[:5], "ids"])


def _join_pieces(batches: Iterator[pa.RecordBatch], path: str) -> Iterator[pa.RecordBatch]:
    enc = encoding(path)
    for batch in batches:
        groups = batch.column(5)
        inner = groups.flatten().field("ids")
        ids, at = inner.flatten().to_numpy(zero_copy_only=False), inner.offsets.to_numpy() - (inner.offsets[0].as_py() if len(inner) else 0)
        ends = groups.offsets.to_numpy() - groups.offsets[0].as_py()
        pieces = [ids[a:b] for a, b in itertools.pairwise(at)]
        pieces = [(enc.decode_bytes(x.tolist()).decode(), x) for x in pieces]
        done = [tree(pieces[a:b], enc) for a, b in itertools.pairwise(ends)]
        yield pa.record_batch([*batch.columns[:5], _list_array(done)], names=[*batch.schema.names[:5], "ids"])


def _is_long(long_chars: int, run_chars: int):
    size = F.coalesce(F.length("text"), F.lit(0))
    return (size > long_chars) | ((size >= run_chars) & F.coalesce(F.col("text").rlike(rf"\S{{{run_chars}}}"), F.lit(False)))


def encoded_by_tree(documents: DataFrame, vocabulary: str = DEFAULT_VOCABULARY, piece_chars: int = PIECE_CHARS) -> DataFrame:
    """(doc_id, ids) of documents(doc_id, text), whose texts have at least two characters, by tree concatenation."""
    width = shuffle_width(documents.sparkSession)
    # written once: the names of the texts, task and row, stand from here on whatever executors are lost
    texts = cut(documents.mapInArrow(lambda b: _cut_texts(b, piece_chars), f"{_PIECE}, text string"))
    most = texts.agg(F.max("pieces")).first()[0] or 1
    work = texts.repartition(width, "task", "row", "piece").mapInArrow(lambda b: _encode_pieces(b, vocabulary), f"{_PIECE}, ids array<int>")
    done = []
    while most > 1:
        fan = 1 << LEVELS
        parts = work.groupBy("task", "row", "doc_id", F.expr(f"piece div {fan}").cast("int").alias("piece"), F.ceil(F.col("pieces") / fan).cast("int").alias("pieces"))
        parts = parts.agg(F.sort_array(F.collect_list(F.struct(F.col("piece").alias("at"), "ids"))).alias("group"))  # 2^LEVELS pieces at most
        work = parts.mapInArrow(lambda b: _join_pieces(b, vocabulary), f"{_PIECE}, ids array<int>")
        most = -(-most // fan)
        if most > 1:
            work = cut(work)
            done.append(work.where("pieces = 1"))
            work = work.where("pieces > 1")
    return reduce(DataFrame.unionByName, [*done, work]).select("doc_id", "ids")


def encoded(documents: DataFrame, vocabulary: str = DEFAULT_VOCABULARY, long_chars: int = LONG_CHARS, run_chars: int = RUN_CHARS, piece_chars: int = PIECE_CHARS) -> DataFrame:
    """(doc_id, ids): the ids of each whole text, without special tokens, the text taken as it is.

    One row for each row of documents, also for repeated ones and for a null doc_id. The list is empty for an
    empty and for a null text; a blank text has the ids of its white space. Other columns are ignored, whatever
    their names. Each of the two ways reads the table for itself: writing the ids of all texts between, so as to read
    once, would cost several times what reading a text costs.
    """
    rows = documents.select("doc_id", "text")
    long = _is_long(long_chars, run_chars)
    short = spread(rows.where(~long)).mapInArrow(lambda b: _encode_plain(b, vocabulary), "doc_id long, ids array<int>")
    return short.unionByName(encoded_by_tree(rows.where(long), vocabulary, piece_chars))


def _count_tokens(batches: Iterator[pa.RecordBatch], path: str) -> Iterator[pa.RecordBatch]:
    enc = encoding(path)
    for batch in batches:
        texts = batch.column(batch.num_columns - 1)
        sizes = [len(_ids(enc, x)) if x else 0 for x in texts.to_pylist()]
        yield pa.record_batch([*batch.columns[:-1], pa.array(sizes, pa.int64())], names=[*batch.schema.names[:-1], "tokens"])


def sized(documents: DataFrame, keep: list[str], vocabulary: str = DEFAULT_VOCABULARY) -> DataFrame:
    """The columns `keep` of documents and tokens, the number of ids of each whole text (0 for empty and null)."""
    rows = documents.select(*keep, "text")
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[:-1]) + ", tokens long"
    return spread(rows).mapInArrow(lambda b: _count_tokens(b, vocabulary), schema)

"""FASTA as a Spark data source: spark.read.format("fasta").load(path), df.write.format("fasta").save(path).

Records: a line `>name description`, then data lines, joined without line ends. The name ends at the first space, tab or end of
line; one separator is taken away and the rest of the line is the description, as it stands. Data keep their case, `\\r` and all
symbols; `>` within a line is data, blank lines add nothing. Lines with `;` are comments up to the next header: they end the
record before them, and data right behind them are malformed. Data before any header form a record without a name. A header
without data gives an empty record, but not at the end of the file unless the option lastEmpty is true. A last line without a line end counts like any other.

Files are read in parallel, large ones in splits: a split takes the records whose header begins in it, and reads on to the
end of its last record. `ordinal` is the byte at which a record begins, so it grows along the file, is the same however the file
is split, and needs no count of the records before it. Mode FAILFAST (default) raises on malformed lines, PERMISSIVE skips them.
"""

from __future__ import annotations

import glob
import os
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, DataSourceStreamReader, InputPartition, WriterCommitMessage

SCHEMA = "path string, ordinal long, name string, description string, data string"
SPLIT_BYTES = 64 << 20
#: Symbols of a batch of records, at most about, and records.
BATCH_SYMBOLS, BATCH_RECORDS = 1_000_000, 8192
_ARROW = pa.schema([("path", pa.string()), ("ordinal", pa.int64()), ("name", pa.string()), ("description", pa.string()), ("data", pa.string())])
_SPACE = b" \t"


@dataclass
class Split(InputPartition):
    path: str
    start: int
    end: int


def _mounted(path: str) -> str:
    """A path without the scheme of mounted files; other file systems are refused, as Python can't open them."""
    path = path.removeprefix("file://").removeprefix("file:")
    if "://" in path:
        raise ValueError(f"FASTA is read and written on mounted file systems only: {path}")
    return path


def files_of(path: str) -> list[str]:
    """The files of a path, a folder or a pattern; hidden ones and those with a leading underscore are left out."""
    path = _mounted(path)
    found = sorted(p for x in glob.glob(path) for p in (glob.glob(f"{glob.escape(x)}/**", recursive=True) if os.path.isdir(x) else [x]))
    return [p for p in found if os.path.isfile(p) and not os.path.basename(p).startswith((".", "_"))]


def _text(raw: bytes) -> str:
    return raw.decode("utf-8", "replace")


def records(path: str, start: int = 0, end: int | None = None, permissive: bool = False, last_empty: bool = False) -> Iterator[tuple[str, int, str, str, str]]:
    """The records that begin in bytes start..end of a file."""
    with open(path, "rb") as lines:
        if start:
            lines.seek(start - 1)
            lines.readline()  # the rest of a line that begins before the split
        at = lines.tell()
        name = description = b""
        data: list[bytes] | None = None
        begun, comment, blank_start = at, False, at == 0
        for line in lines:
            here, at = at, at + len(line)
            body = line[:-1] if line.endswith(b"\n") else line
            if body.startswith((b">", b";")):
                if data is not None:
                    yield path, begun, _text(name), _text(description), _text(b"".join(data))
                    data = None
                if body.startswith(b";"):
                    comment = True
                    if end is not None and here >= end:
                        return
                    continue
                if end is not None and here >= end:
                    return
                comment, begun, data = False, here, []
                cut = min((i for i in (body.find(s) for s in (b" ", b"\t")) if i >= 0), default=len(body))
                name, description = body[1:cut], body[cut + 1 :]
            elif data is None:
                if start and not comment:
                    continue  # data of a record that began in an earlier split
                if comment or not body:
                    if not permissive and (comment or (blank_start and here == 0)):
                        raise ValueError(f"{path}: malformed line at byte {here}")
                    continue
                if here == 0 or not start:
                    begun, name, description, data = here, b"", b"", [body]
            elif body:
                data.append(body)
        if data or (last_empty and data is not None):
            joined = b"".join(data)
            if joined or last_empty:
                yield path, begun, _text(name), _text(description), _text(joined)


def batches(rows: Iterator[tuple[str, int, str, str, str]]) -> Iterator[pa.RecordBatch]:
    """Records as Arrow batches of a bounded size."""
    held: list[tuple] = []
    symbols = 0
    for row in rows:
        held.append(row)
        symbols += len(row[4])
        if symbols >= BATCH_SYMBOLS or len(held) >= BATCH_RECORDS:
            yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*held, strict=True), _ARROW.types, strict=True)], schema=_ARROW)
            held, symbols = [], 0
    if held:
        yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*held, strict=True), _ARROW.types, strict=True)], schema=_ARROW)


class _Reader(DataSourceReader):
    def __init__(self, options: dict):
        self.path, self.permissive = options["path"], options.get("mode", "FAILFAST").upper() == "PERMISSIVE"
        self.last_empty = options.get("lastempty", options.get("lastEmpty", "false")).lower() == "true"
        self.split = int(options.get("splitbytes", options.get("splitBytes", SPLIT_BYTES)))

    def partitions(self) -> list[Split]:
        return self.splits(files_of(self.path))

    def splits(self, files: list[str]) -> list[Split]:
        return [Split(p, s, min(size, s + self.split)) for p in files for size in [os.path.getsize(p)] for s in range(0, size, self.split)] or [Split("", 0, 0)]

    def read(self, partition: Split) -> Iterator[pa.RecordBatch]:
        if partition.path:
            yield from batches(records(partition.path, partition.start, partition.end, self.permissive, self.last_empty))


class _Stream(DataSourceStreamReader):
    """A folder as a stream: each batch takes the files that came, by time of change and name, after those of the last one.

    The driver lists names only; files are read in splits by the executors. A file must come whole, as by a rename.
    """

    def __init__(self, options: dict):
        self.reader = _Reader(options)

    def _known(self) -> list[tuple[int, str]]:
        return sorted((os.stat(p).st_mtime_ns, p) for p in files_of(self.reader.path))

    def initialOffset(self) -> dict:
        return {"time": "0", "path": ""}

    def latestOffset(self) -> dict:
        time, path = max(self._known(), default=(0, ""))
        return {"time": str(time), "path": path}

    def partitions(self, start: dict, end: dict) -> list[Split]:
        low, high = (int(start["time"]), start["path"]), (int(end["time"]), end["path"])
        return self.reader.splits([p for t, p in self._known() if low < (t, p) <= high])

    def read(self, partition: Split) -> Iterator[pa.RecordBatch]:
        return self.reader.read(partition)

    def commit(self, end: dict) -> None:
        pass


@dataclass
class _Written(WriterCommitMessage):
    temporary: str
    final: str


class _Writer(DataSourceArrowWriter):
    """Writes name, description and data; each task a file of its own, which gets its name when the job commits."""

    def __init__(self, options: dict, columns: list[str], overwrite: bool):
        self.folder = _mounted(options["path"])
        self.width = int(options.get("linewidth", options.get("lineWidth", 70)))
        self.columns, self.overwrite = columns, overwrite
        missing = {"name", "data"} - set(columns)
        if missing:
            raise ValueError(f"a FASTA table needs the columns {sorted(missing)}")
        os.makedirs(self.folder, exist_ok=True)
        self.before = files_of(self.folder) if overwrite else []

    def write(self, iterator: Iterator[pa.RecordBatch]) -> _Written:
        final = os.path.join(self.folder, f"part-{uuid.uuid4().hex}.fasta")
        temporary = os.path.join(self.folder, f"_{uuid.uuid4().hex}")
        with open(temporary, "wb") as out:
            for batch in iterator:
                column = lambda name: batch.column(self.columns.index(name)).to_pylist() if name in self.columns else [None] * batch.num_rows  # noqa: B023, E731
                for name, description, data in zip(column("name"), column("description"), column("data"), strict=True):
                    out.write(_record(name, description, data, self.width))
        return _Written(temporary, final)

    def commit(self, messages: list) -> None:
        for m in messages:
            if m is not None:
                os.replace(m.temporary, m.final)
        for p in self.before:
            os.remove(p)

    def abort(self, messages: list) -> None:
        for m in messages:
            if m is not None and os.path.exists(m.temporary):
                os.remove(m.temporary)


def _record(name: str | None, description: str | None, data: str | None, width: int) -> bytes:
    """One record; line ends inside the fields would break the format and are refused."""
    for x in (name, description, data):
        if x and "\n" in x:
            raise ValueError("a line end inside a field can't be written as FASTA")
    if name and any(c in name for c in " \t"):
        raise ValueError(f"a name with white space can't be written as FASTA: {name!r}")
    data = data or ""
    lines = [data[i : i + width] for i in range(0, len(data), width)] if width > 0 else [data]
    if any(x.startswith((">", ";")) for x in lines):
        lines = [data]
        if data.startswith((">", ";")):
            raise ValueError("data that begin with > or ; can't be written as FASTA")
    head = f">{name or ''}" + (f" {description}" if description else "")
    return ("\n".join([head, *[x for x in lines if x]]) + "\n").encode()


class FastaDataSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "fasta"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> _Reader:
        return _Reader(dict(self.options))

    def streamReader(self, schema) -> _Stream:
        return _Stream(dict(self.options))

    def writer(self, schema, overwrite: bool) -> _Writer:
        return _Writer(dict(self.options), schema.fieldNames(), overwrite)


def register(spark: SparkSession) -> None:
    """Make format("fasta") known to a session."""
    spark.dataSource.register(FastaDataSource)


def read_fasta(spark: SparkSession, path: str, mode: str = "FAILFAST", split_bytes: int = SPLIT_BYTES, last_empty: bool = False) -> DataFrame:
    """(path, ordinal, name, description, data) of all records; last_empty: also of a header without data at the end of a file."""
    register(spark)
    return spark.read.format("fasta").option("mode", mode).option("lastEmpty", str(last_empty).lower()).option("splitBytes", split_bytes).load(path)


def count_fasta(spark: SparkSession, path: str, mode: str = "FAILFAST") -> int:
    """Number of records, the last one included."""
    return read_fasta(spark, path, mode).count()


def write_fasta(df: DataFrame, path: str, line_width: int = 70, mode: str = "append") -> None:
    """Write (name, description, data) as FASTA files, one per partition."""
    register(df.sparkSession)
    df.write.format("fasta").option("lineWidth", line_width).mode(mode).save(path)

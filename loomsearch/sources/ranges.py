"""Lines of files by byte ranges: a data source for tables and streams.

A file is cut into ranges of bytes; a range has the lines whose ends are in it,
so many tasks read one large file and nothing is read twice but the start of a
line that a range begins in the middle of. Reading can begin at an offset for
each file, which is how files that have grown are read from where they ended. As
a stream, the offset is the number of bytes seen of each file; a line whose end
is not there yet comes with the bytes that end it, and a file that has become
shorter begins anew, after a row that says so.
"""

from __future__ import annotations

import io
import json
import uuid
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

from ..storage import ship
from .parse import LONGEST_LINE

#: Bytes of a range, and of what is read at a time.
RANGE, CHUNK = 64 << 20, 4 << 20
#: The ``source_offset`` of the row that a stream gives before a file that begins anew.
ANEW = -1
SCHEMA = "source_path string, source_offset long, line binary"
# Stores that pyarrow opens by their addresses; those of all others are read whole, by Spark.
SCHEMES = ("file", "hdfs", "s3", "s3a", "gs", "abfs", "abfss")

_ARROW = pa.schema([("source_path", pa.string()), ("source_offset", pa.int64()), ("line", pa.binary())])


def by_ranges(path: str) -> bool:
    """Whether ranges of a path can be read here."""
    return path.startswith("/") or path.split(":", 1)[0] in SCHEMES


def store_of(path: str) -> tuple[pafs.FileSystem, str]:
    if path.startswith(("/", "file:")):
        return pafs.LocalFileSystem(), "/" + path.removeprefix("file:").lstrip("/")
    return pafs.FileSystem.from_uri(path.replace("s3a:", "s3:", 1))


def put(store: pafs.FileSystem, path: str, chunks: Iterable[bytes]) -> None:
    """Writes a file beside its place and moves it there, so a reader, or a task that is run twice, never meets a part of it."""
    folder, name = path.rsplit("/", 1)
    draft = f"{folder}/_draft-{uuid.uuid4().hex}"
    with store.open_output_stream(draft) as out:
        for chunk in chunks:
            out.write(chunk)
    if not isinstance(store, pafs.LocalFileSystem) and store.get_file_info(path).is_file:
        store.delete_file(path)
    store.move(draft, path)


@dataclass
class Range(InputPartition):
    """Parts of files: (path, where its reading may begin, start, end)."""

    parts: list[tuple[str, int, int, int]]


def cut(files: list[tuple[str, int, int]], most: int) -> list[Range]:
    """Ranges for files (path, begin, end): large files are cut, small ones share a range."""
    out, held = [], 0
    for path, begin, end in files:
        for start in range(begin, end, most):
            stop = min(start + most, end)
            if not out or held + stop - start > most:
                out.append(Range([]))
                held = 0
            out[-1].parts.append((path, begin, start, stop))
            held += stop - start
    return out


def lines_in(file, begin: int, start: int, end: int) -> Iterator[tuple[int, bytes | None]]:
    """(offset, line) of the lines whose ends are in ``start .. end``, of which none begins before ``begin``; no line for those that are too long."""
    at, held, long, first = start, b"", False, None
    while at < end:
        file.seek(at)
        chunk = file.read(min(CHUNK, end - at))
        if not chunk:
            return
        pos = 0
        while (stop := chunk.find(b"\n", pos)) >= 0:
            if first is None:  # the first end: now it pays to look for where its line begins
                head, long_head = _before(file, begin, start)
                first, held, long = start - len(head), head + held, long or long_head
            line = held + chunk[pos:stop]
            yield first, None if long or len(line) > LONGEST_LINE else line
            pos = stop + 1
            first, held, long = at + pos, b"", False
        rest = chunk[pos:]
        long = long or len(held) + len(rest) > LONGEST_LINE
        held = b"" if long else held + rest
        at += len(chunk)


def _before(file, begin: int, start: int) -> tuple[bytes, bool]:
    """What a line has before ``start``, or nothing and that it is too long."""
    found, at = b"", start
    while at > begin:
        step = min(1 << 16, at - begin)
        file.seek(at - step)
        chunk = file.read(step)
        cut_at = chunk.rfind(b"\n")
        found = chunk[cut_at + 1 :] + found
        if cut_at >= 0:
            break
        if len(found) > LONGEST_LINE:
            return b"", True
        at -= step
    return found, False


def _batches(parts: list[tuple[str, int, int, int]]) -> Iterator[pa.RecordBatch]:
    rows, size = [], 0
    for path, begin, start, end in parts:
        if start == ANEW:
            rows.append((path, ANEW, None))
            continue
        store, at = store_of(path)
        with store.open_input_file(at) as file:
            for offset, line in lines_in(file, begin, start, end):
                rows.append((path, offset, line))
                size += len(line or b"")
                if size > CHUNK or len(rows) >= 10_000:
                    yield _batch(rows)
                    rows, size = [], 0
    if rows:
        yield _batch(rows)


def lines_of(path: str, data: bytes) -> Iterator[pa.RecordBatch]:
    """The same rows of a file that is in memory."""
    rows = list(lines_in(io.BytesIO(data), 0, 0, len(data)))
    for k in range(0, len(rows), 1000):
        yield _batch([(path, *r) for r in rows[k : k + 1000]])


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), _ARROW)], schema=_ARROW)


class _Reader(DataSourceReader):
    def __init__(self, options: dict):
        self.files, self.most = json.loads(options.get("files", "[]")), int(options.get("rangebytes", RANGE))

    def partitions(self) -> list[Range]:
        return cut([tuple(f) for f in self.files], self.most) or [Range([])]

    def read(self, partition: Range) -> Iterator[pa.RecordBatch]:
        return _batches(partition.parts)


class _StreamReader(DataSourceStreamReader):
    def __init__(self, options: dict):
        self.folder, self.suffix, self.most = options["path"], options.get("suffix", ""), int(options.get("rangebytes", RANGE))

    def initialOffset(self) -> dict:  # noqa: N802
        return {}

    def latestOffset(self) -> dict:  # noqa: N802
        store, at = store_of(self.folder)
        found = store.get_file_info(pafs.FileSelector(at, recursive=True, allow_not_found=True))
        lead = self.folder.split(":", 1)[0] + ":" if ":" in self.folder else ""
        return {lead + f.path: f.size for f in sorted(found, key=lambda f: f.path) if f.is_file and f.path.endswith(self.suffix)}

    def partitions(self, start: dict, end: dict) -> list[Range]:
        files = [(path, 0 if start.get(path, 0) > size else start.get(path, 0), size) for path, size in end.items()]
        anew = [(path, 0, ANEW, 0) for path, size in end.items() if start.get(path, 0) > size]
        # A range may look back for the start of a line that an earlier batch has seen the beginning of.
        ranges = [Range([(p, 0, a, b) for p, _, a, b in r.parts]) for r in cut([f for f in files if f[1] < f[2]], self.most)]
        return ([Range(anew)] if anew else []) + ranges

    def read(self, partition: Range) -> Iterator[pa.RecordBatch]:
        return _batches(partition.parts)

    def commit(self, end: dict) -> None:
        pass


class LineRanges(DataSource):
    """Format ``line_ranges``. Tables: option ``files``, JSON of [path, begin, end]. Streams: option ``path``, a folder, and ``suffix``. Both: ``rangeBytes``."""

    @classmethod
    def name(cls) -> str:
        return "line_ranges"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return _Reader({k.lower(): v for k, v in self.options.items()})

    def streamReader(self, schema) -> DataSourceStreamReader:  # noqa: N802
        return _StreamReader({k.lower(): v for k, v in self.options.items()})


def register(spark: SparkSession) -> None:
    ship(spark)
    spark.dataSource.register(LineRanges)


def read_lines(spark: SparkSession, files: list[tuple[str, int, int]], range_bytes: int = RANGE) -> DataFrame:
    """``source_path, source_offset, line`` of whole lines of files (path, first byte, size); a line that is too long is null."""
    register(spark)
    return spark.read.format("line_ranges").options(files=json.dumps(files), rangeBytes=range_bytes).load()


def stream_lines(spark: SparkSession, folder: str, suffix: str = ".jsonl", range_bytes: int = RANGE) -> DataFrame:
    """The same as a stream of all files below a folder; before what a file gives that begins anew there is a row at offset ``ANEW``."""
    register(spark)
    return spark.readStream.format("line_ranges").options(path=folder, suffix=suffix, rangeBytes=range_bytes).load()

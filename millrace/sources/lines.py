"""Lines of text files as a data source, ``spark.read.format("millrace_lines")`` and ``spark.readStream``.

Every line of every file in ``path`` is one row: file (its name), offset (the byte where it begins, which gives the order of
lines), value, too_large and reason. LF, CR and CRLF end a line; a last one needs no end, and an empty rest is none. A line of
more than ``limit`` UTF-16 units has a null value, too_large and the reason requestTooLarge, and one that isn't UTF-8 has a null value and
the reason notUtf8; neither stops the others. What a task holds is bounded by the limit and ``chunk``, however long a line is.

Files are split into ranges of ``split`` bytes; a line belongs to the range that its first byte lies in. ``path`` is a folder on any
store that pyarrow's file systems read, the same for all executors. Folders in it, empty files and names that begin with a dot or a low
line are passed over.

As a stream, files are taken in the order of their names, all that are there in one batch. They are moved in whole, with names behind
those that were there, and stay: a file that comes or goes among those already read is an error, not a silent loss.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

from millrace.sources.records import MAX_REQUEST
from millrace.sources.tables import ship_package

NAME = "millrace_lines"
SCHEMA = "file string, offset long, value string, too_large boolean, reason string"
ARROW = pa.schema([("file", pa.string()), ("offset", pa.int64()), ("value", pa.string()), ("too_large", pa.bool_()), ("reason", pa.string())])
END = re.compile(rb"\r\n|\r|\n")
BATCH = 1000


@dataclass
class Piece(InputPartition):
    """The bytes of a file from begin up to end."""

    file: str
    size: int
    begin: int
    end: int


def lines_of(read: Callable[[int, int], bytes], size: int, begin: int, end: int, most: int, chunk: int) -> Iterator[tuple[int, bytes | None]]:
    """The place and bytes of each line that begins from begin up to end; null bytes for one of more than ``most``."""
    at, start, skipping = max(begin - 1, 0), begin, begin > 0
    held: list[bytes] = []
    length, after_cr = 0, False
    while at < size:
        data = read(at, chunk)
        if not data:
            break
        i = 0
        if after_cr:
            i, after_cr = int(data[:1] == b"\n"), False
            start = at + i
            if start >= end:
                return
        while True:
            m = END.search(data, i)
            stop = m.start() if m else len(data)
            if not skipping:
                length += stop - i
                if length <= most:
                    held.append(data[i:stop])
                else:
                    held = []
            if not m:
                break
            if not skipping:
                yield start, b"".join(held) if length <= most else None
            held, length, skipping, i = [], 0, False, m.end()
            start = at + i
            if m.group() == b"\r" and i == len(data):
                after_cr = True
                break
            if start >= end:
                return
        at += len(data)
        if at >= end and (skipping or after_cr):
            return  # the next line begins beyond the range
        if at >= end and length > most:
            yield start, None
            return
    if not skipping and start < min(size, end):
        yield start, b"".join(held) if length <= most else None


def units(text: str) -> int:
    """UTF-16 units."""
    return len(text) + sum(c > "\uffff" for c in text)


class Folder:
    """Files of a folder and their lines, as the options say."""

    def __init__(self, options: dict):
        if not options.get("path"):
            raise ValueError("the source needs a path")
        self.path = options["path"]
        self.limit, self.chunk = int(options.get("limit", MAX_REQUEST)), int(options.get("chunk", 1 << 20))
        self.split = int(options.get("split", 128 << 20))
        if min(self.limit, self.chunk, self.split) < 1:
            raise ValueError("limit, chunk and split are positive")

    def place(self) -> tuple[fs.FileSystem, str]:
        """The file system, and the folder in it."""
        return fs.FileSystem.from_uri(self.path) if ":" in self.path else (fs.LocalFileSystem(), self.path)

    def files(self) -> list[tuple[str, int]]:
        """Names and sizes in the order of names."""
        system, folder = self.place()
        found = system.get_file_info(fs.FileSelector(folder, allow_not_found=False))
        return sorted((f.base_name, f.size) for f in found if f.type == fs.FileType.File and f.size and f.base_name[0] not in "._")

    def pieces(self, files: list[tuple[str, int]]) -> list[Piece]:
        """The ranges of files."""
        return [Piece(name, size, b, min(b + self.split, size)) for name, size in files for b in range(0, size, self.split)]

    def read(self, part: Piece) -> Iterator[pa.RecordBatch]:
        """The rows of a range."""
        system, folder = self.place()
        rows: list[tuple] = []
        weight = 0
        with system.open_input_file(f"{folder.rstrip('/')}/{part.file}") as f:
            for offset, raw in lines_of(lambda at, n: f.read_at(min(n, part.size - at), at), part.size, part.begin, part.end, 3 * self.limit, self.chunk):
                try:
                    text, reason = (raw.decode(), None) if raw is not None else (None, "requestTooLarge")
                except UnicodeDecodeError:
                    text, reason = None, "notUtf8"
                if text is not None and units(text) > self.limit:
                    text, reason = None, "requestTooLarge"
                rows.append((part.file, offset, text, reason == "requestTooLarge", reason))
                weight += len(raw or b"")
                if len(rows) >= BATCH or weight > self.chunk:
                    yield batch(rows)
                    rows, weight = [], 0
        if rows:
            yield batch(rows)


def batch(rows: list[tuple]) -> pa.RecordBatch:
    """Rows as an Arrow batch."""
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), ARROW, strict=True)], schema=ARROW)


class LineReader(DataSourceReader):
    """All lines of a folder."""

    def __init__(self, folder: Folder):
        self.folder = folder

    def partitions(self) -> list[Piece]:
        """One task for each range; a folder without lines has one empty range."""
        return self.folder.pieces(self.folder.files()) or [Piece("", 0, 0, 0)]

    def read(self, partition: Piece) -> Iterator[pa.RecordBatch]:
        """The rows of a range."""
        return self.folder.read(partition) if partition.size else iter(())


class LineStream(DataSourceStreamReader):
    """Files in the order of their names; an offset is the last name and how many files there are up to it."""

    def __init__(self, folder: Folder):
        self.folder = folder

    def initialOffset(self) -> dict:  # noqa: N802  Spark's name
        """Before all files."""
        return {"after": "", "files": 0}

    def behind(self, start: dict) -> list[tuple[str, int]]:
        """The files behind an offset; those up to it must still be the same number."""
        files = self.folder.files()
        known = sum(name <= start["after"] for name, _ in files)
        if known != start["files"]:
            raise ValueError(f"{start['files']} files up to {start['after']!r} were read, and there are {known} now")
        return [f for f in files if f[0] > start["after"]]

    def latestOffset(self) -> dict:  # noqa: N802
        """The last of all files."""
        files = self.folder.files()
        return {"after": files[-1][0], "files": len(files)} if files else self.initialOffset()

    def partitions(self, start: dict, end: dict) -> list[Piece]:
        """The ranges of the files behind start, up to end."""
        new = [f for f in self.behind(start) if f[0] <= end["after"]]
        if len(new) + start["files"] != end["files"]:
            raise ValueError(f"{end['files']} files up to {end['after']!r} were listed, and there are {len(new) + start['files']} now")
        return self.folder.pieces(new)

    def read(self, partition: Piece) -> Iterator[pa.RecordBatch]:
        """The rows of a range."""
        return self.folder.read(partition)

    def commit(self, end: dict) -> None:
        """Files stay; nothing is to be done."""


class LineSource(DataSource):
    """The data source."""

    @classmethod
    def name(cls) -> str:
        """What ``format`` takes."""
        return NAME

    def schema(self) -> str:
        """The columns of a line."""
        return SCHEMA

    def reader(self, schema) -> LineReader:
        """All lines."""
        return LineReader(Folder(dict(self.options)))

    def streamReader(self, schema) -> LineStream:  # noqa: N802
        """Lines of the files that come."""
        return LineStream(Folder(dict(self.options)))


def register(spark: SparkSession) -> str:
    """Make the source known to a session, and its package to the executors; the name for ``format``."""
    ship_package(spark)
    spark.dataSource.register(LineSource)
    return NAME

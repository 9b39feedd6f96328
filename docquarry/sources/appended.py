"""Lines of growing text files by byte offset, as a Python data source.

The offset is the number of bytes of each file that were handed out.  A stream hands out whole
lines only: what follows a file's last line end waits until the line is finished.  A file that
got shorter than its offset, has gone, or no longer has a line end before the offset fails the read,
as an append-only log is never rewritten.  Long stretches are cut into splits that tasks read at once;
a line belongs to the split that it begins in.

Files are opened by ``pyarrow.fs``, so paths may be local ones or URIs that it knows; in a cluster
the folder has to be one that driver and executors share.  Names that start with ``_`` or ``.`` are skipped.
"""

from __future__ import annotations

import json
import posixpath
import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

FORMAT = "appended_lines"
SCHEMA = "file string, offset bigint, value string"
SPLIT_BYTES = 64 << 20
_CHUNK = 1 << 20
# Lines and bytes of one Arrow batch.
_BATCH_LINES, _BATCH_BYTES = 4096, 4 << 20
_ARROW = pa.schema([("file", pa.string()), ("offset", pa.int64()), ("value", pa.string())])


class AppendOnlyError(ValueError):
    """A file was cut, replaced or removed."""


@dataclass
class Split(InputPartition):
    """Lines that begin in ``start`` to ``stop``; ``first`` and ``end`` are line borders around it."""

    file: str
    first: int
    start: int
    stop: int
    end: int


def open_store(path: str) -> tuple[fs.FileSystem, str]:
    # Hadoop writes file:/x for file:///x.
    return fs.FileSystem.from_uri(re.sub(r"^(\w+):/(?!/)", r"\1:///", path) if ":" in path else posixpath.abspath(path))


def file_sizes(store: fs.FileSystem, root: str) -> dict[str, int]:
    """Bytes of each file, by its path below ``root``; ``root`` may be one file, and need not exist yet."""
    info = store.get_file_info(root)
    if info.type == fs.FileType.File:
        return {"": info.size}
    if info.type == fs.FileType.NotFound:
        return {}
    found = {}
    for entry in store.get_file_info(fs.FileSelector(root, recursive=True)):
        name = posixpath.relpath(entry.path, root)
        if entry.type == fs.FileType.File and not any(part[0] in "_." for part in name.split("/")):
            found[name] = entry.size
    return found


def whole_lines(handle: pa.NativeFile, size: int) -> int:
    """Bytes up to and with the last line end."""
    stop = size
    while stop > 0:
        start = max(0, stop - _CHUNK)
        handle.seek(start)
        at = handle.read(stop - start).rfind(b"\n")
        if at >= 0:
            return start + at + 1
        stop = start
    return 0


def read_lines(handle: pa.NativeFile, split: Split) -> Iterator[tuple[int, bytes]]:
    """(offset, line) of the lines that begin in the split, without their line ends."""
    at = split.start
    if at > split.first:
        # The line that holds the byte before is another split's.
        at -= 1
    handle.seek(at)
    rest, skip = b"", split.start > split.first
    while at < split.stop or rest:
        more = handle.read(min(_CHUNK, split.end - at - len(rest))) if at + len(rest) < split.end else b""
        if not more:
            if rest and not skip and at < split.stop:
                yield at, rest
            return
        lines = (rest + more).split(b"\n")
        rest = lines.pop()
        for line in lines:
            if not skip:
                if at >= split.stop:
                    return
                yield at, line
            skip = False
            at += len(line) + 1
        if at >= split.stop and not skip:
            return


class _Files:
    """What both readers share."""

    def __init__(self, options: dict):
        if "path" not in options:
            raise ValueError("appended_lines needs a path")
        self.path = options["path"]
        self.split_bytes = int(options.get("splitbytes", options.get("splitBytes", SPLIT_BYTES)))
        starting = options.get("startingoffsets", options.get("startingOffsets"))
        self.starting: dict[str, int] = json.loads(starting) if starting else {}

    def full(self, root: str, name: str) -> str:
        return posixpath.join(root, name) if name else root

    def splits(self, start: dict, end: dict) -> list[Split]:
        store, root = open_store(self.path)
        found = []
        for name in sorted(start.keys() - end.keys()):
            raise AppendOnlyError(f"{self.full(root, name)} is gone; {start[name]} bytes of it were read")
        for name, stop in sorted(end.items()):
            first = start.get(name, 0)
            if stop < first:
                raise AppendOnlyError(f"{self.full(root, name)} is shorter than the {first} bytes that were read of it")
            if stop == first:
                continue
            if first:
                with store.open_input_file(self.full(root, name)) as handle:
                    handle.seek(first - 1)
                    if handle.read(1) != b"\n":
                        raise AppendOnlyError(f"{self.full(root, name)} has no line end before byte {first}; it was rewritten")
            found += [Split(name, first, a, min(a + self.split_bytes, stop), stop) for a in range(first, stop, self.split_bytes)]
        return found

    def read(self, split: Split) -> Iterator[pa.RecordBatch]:
        store, root = open_store(self.path)
        path = self.full(root, split.file)
        offsets, values, size = [], [], 0

        def batch() -> pa.RecordBatch:
            return pa.RecordBatch.from_pydict({"file": [path] * len(values), "offset": offsets, "value": values}, _ARROW)

        with store.open_input_file(path) as handle:
            for offset, line in read_lines(handle, split):
                offsets.append(offset)
                try:
                    values.append(line.removesuffix(b"\r").decode())
                except UnicodeDecodeError:
                    values.append(None)
                size += len(line)
                if len(values) >= _BATCH_LINES or size >= _BATCH_BYTES:
                    yield batch()
                    offsets, values, size = [], [], 0
        if values:
            yield batch()


class _StreamReader(_Files, DataSourceStreamReader):
    def __init__(self, options: dict):
        super().__init__(options)
        self.ends: dict[str, tuple[int, int]] = {}

    def initialOffset(self) -> dict:
        return self.starting

    def latestOffset(self) -> dict:
        store, root = open_store(self.path)
        ends = {}
        for name, size in file_sizes(store, root).items():
            known = self.ends.get(name)
            if known is None or known[0] != size:
                with store.open_input_file(self.full(root, name)) as handle:
                    known = size, whole_lines(handle, size)
            ends[name] = known
        self.ends = ends
        return {name: end for name, (_, end) in sorted(ends.items())}

    def partitions(self, start: dict, end: dict) -> list[Split]:
        return self.splits(start, end)


class _BatchReader(_Files, DataSourceReader):
    def partitions(self) -> list[Split]:
        store, root = open_store(self.path)
        return self.splits(self.starting, file_sizes(store, root)) or [Split("", 0, 0, 0, 0)]

    def read(self, split: Split) -> Iterator[pa.RecordBatch]:
        return super().read(split) if split.end else iter(())


class AppendedLines(DataSource):
    """Options: ``path``; ``startingOffsets``, a JSON object of bytes by file; ``splitBytes``."""

    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return _BatchReader(self.options)

    def streamReader(self, schema) -> DataSourceStreamReader:
        return _StreamReader(self.options)


def _options(reader, path: str, starting: dict[str, int] | None, split_bytes: int):
    options = {"path": path, "splitBytes": str(split_bytes), "startingOffsets": json.dumps(starting or {})}
    return reader.format(FORMAT).options(**options)


def stream_lines(
    spark: SparkSession, path: str, *, starting: dict[str, int] | None = None, split_bytes: int = SPLIT_BYTES
) -> DataFrame:
    """(file, offset, value) of the whole lines appended since the last checkpoint; NULL for a line that is not UTF-8."""
    spark.dataSource.register(AppendedLines)
    return _options(spark.readStream, path, starting, split_bytes).load()


def lines_since(
    spark: SparkSession, path: str, starting: dict[str, int] | None = None, *, split_bytes: int = SPLIT_BYTES
) -> DataFrame:
    """The same once, from recorded offsets to the present end, an unfinished last line included."""
    spark.dataSource.register(AppendedLines)
    return _options(spark.read, path, starting, split_bytes).load()


def current_offsets(path: str) -> dict[str, int]:
    """Bytes of each file now, to record at the start of a run."""
    return file_sizes(*open_store(path))

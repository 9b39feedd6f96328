"""Elements of JSON array files, read one at a time, as a Python data source.

A task reads its file in pieces and hands out the text of each element, so that a file may be much larger
than a task's memory; only one element has to fit.  A file has to hold one list with at least one element.
Files are opened as in :mod:`docquarry.sources.appended`.
"""

from __future__ import annotations

import codecs
import json
import posixpath
import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from docquarry.sources.appended import file_sizes, open_store

FORMAT = "json_array_elements"
SCHEMA = "file string, ordinal int, value string"
_PIECE = 1 << 20
# Elements and characters of one Arrow batch.
_BATCH_ROWS, _BATCH_CHARS = 1024, 4 << 20
_ARROW = pa.schema([("file", pa.string()), ("ordinal", pa.int32()), ("value", pa.string())])
_AFTER = {*" \t\r\n,]"}
_SPACE = re.compile(r"[ \t\r\n]*")


class JsonArrayError(ValueError):
    """A file that is not one list with elements."""


@dataclass
class File(InputPartition):
    name: str


class _Text:
    """The part of a file that has been read and not handed out."""

    def __init__(self, handle: pa.NativeFile, piece: int):
        self.handle, self.piece = handle, piece
        self.decoder = codecs.getincrementaldecoder("utf-8-sig")()
        self.text, self.at, self.ended = "", 0, False

    def more(self) -> bool:
        """Reads on, at least as much again as is held, so that a long element is not parsed too often."""
        if self.ended:
            return False
        data = self.handle.read(max(self.piece, len(self.text) - self.at))
        self.ended = not data
        self.text = self.text[self.at :] + self.decoder.decode(data, final=self.ended)
        self.at = 0
        return True

    def next_char(self) -> str:
        """The next character that is not white space, without taking it; empty at the end."""
        while True:
            self.at = _SPACE.match(self.text, self.at).end()
            if self.at < len(self.text):
                return self.text[self.at]
            if not self.more():
                return ""


def elements(handle: pa.NativeFile, name: str, piece: int = _PIECE) -> Iterator[str]:
    """The JSON text of each element."""
    source, decoder, count = _Text(handle, piece), json.JSONDecoder(), 0
    if source.next_char() != "[":
        raise JsonArrayError(f"{name} does not hold a list")
    source.at += 1
    while True:
        char = source.next_char()
        if char == "]" and count == 0:
            raise JsonArrayError(f"{name} holds an empty list")
        while True:
            try:
                end = decoder.raw_decode(source.text, source.at)[1]
                # What follows tells that a number is complete: "1." may go on.
                if source.text[end : end + 1] in _AFTER or source.ended or len(source.text) > end + 16:
                    break
            except json.JSONDecodeError as error:
                # Only a string, or what stands at the end of what was read, may be unfinished.
                cut = error.msg.startswith("Unterminated string") or error.pos > len(source.text) - 16
                if source.ended or not cut:
                    raise JsonArrayError(f"Element {count} of {name}: {error.msg}") from None
            source.more()
        yield source.text[source.at : end]
        count += 1
        source.at = end
        char = source.next_char()
        if char not in (",", "]"):
            raise JsonArrayError(f"{name}: no comma or end of the list after element {count - 1}")
        source.at += 1
        if char == "]":
            if source.next_char():
                raise JsonArrayError(f"{name} goes on after its list")
            return


class _Reader(DataSourceReader):
    def __init__(self, options: dict):
        self.path = options["path"]

    def partitions(self) -> list[File]:
        found = [File(name) for name in sorted(file_sizes(*open_store(self.path)))]
        if not found:
            raise JsonArrayError(f"there is no file at {self.path}")
        return found

    def read(self, partition: File) -> Iterator[pa.RecordBatch]:
        store, root = open_store(self.path)
        path = posixpath.join(root, partition.name) if partition.name else root
        first, values, size = 0, [], 0

        def batch() -> pa.RecordBatch:
            ordinals = list(range(first, first + len(values)))
            return pa.RecordBatch.from_pydict({"file": [path] * len(values), "ordinal": ordinals, "value": values}, _ARROW)

        with store.open_input_file(path) as handle:
            for value in elements(handle, path):
                values.append(value)
                size += len(value)
                if len(values) >= _BATCH_ROWS or size >= _BATCH_CHARS:
                    yield batch()
                    first, values, size = first + len(values), [], 0
        if values:
            yield batch()


class JsonArrayElements(DataSource):
    """Option: ``path``, a file or a folder of files."""

    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options)


def read_elements(spark: SparkSession, path: str) -> DataFrame:
    """(file, ordinal, value): the text of every element of the array files at ``path``."""
    spark.dataSource.register(JsonArrayElements)
    return spark.read.format(FORMAT).option("path", path).load()

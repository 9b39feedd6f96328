"""Overlapping character windows that end on a space or newline."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docquarry.functions import ordered, text
from docquarry.params import ChunkParams
from docquarry.session import written

_CHUNKS = "array<struct<start:int,stop:int,text:string>>"
_ARROW_CHUNKS = pa.list_(pa.struct([("start", pa.int32()), ("stop", pa.int32()), ("text", pa.string())]))
# Texts of a batch whose windows are Python objects at once.
SLICE_ROWS = 256


def _next_stop(body: str, start: int, size: int) -> int:
    """Where the window opened at ``start`` closes."""
    limit = start + size
    if limit >= len(body):
        return len(body)
    back = max(body.rfind(" ", start + 1, limit + 1), body.rfind("\n", start + 1, limit + 1))
    if back != -1:
        return back
    ahead = [p for p in (body.find(" ", limit), body.find("\n", limit)) if p != -1]
    return min(ahead, default=len(body))


def cut(body: str, size: int, overlap: int) -> list[tuple[int, int, str]]:
    """(start, stop, stripped text) of every non-empty window."""
    pieces = []
    start = 0
    while start < len(body):
        stop = _next_stop(body, start, size)
        piece = body[start:stop].strip()
        if piece:
            pieces.append((start, stop, piece))
        if start + size >= len(body):
            break
        # An overlap as long as the window would stand still: drop it here.
        start = stop - overlap if stop - overlap > start else stop
    return pieces


def windows_of(texts: pa.Array, size: int, overlap: int) -> pa.Array:
    """The windows of every text; only those of a slice of texts are Python objects at once."""

    def cells(body: str | None) -> list[dict] | None:
        if body is None:
            return None
        return [{"start": a, "stop": b, "text": t} for a, b, t in cut(body, size, overlap)]

    parts = [pa.array([], _ARROW_CHUNKS)]
    for at in range(0, len(texts), SLICE_ROWS):
        bodies = texts.slice(at, SLICE_ROWS).to_pylist()
        parts.append(pa.array([cells(body) for body in bodies], _ARROW_CHUNKS))
    return pa.concat_arrays(parts)


def chunk_column(body: Column, params: ChunkParams) -> Column:
    """Array of windows for each text; documents are independent of each other."""
    size, overlap = params.size, params.overlap

    @F.arrow_udf(_CHUNKS)
    def windows(column: pa.Array) -> pa.Array:
        return windows_of(column, size, overlap)

    return windows(body)


def chunk_rows(rows: DataFrame, params: ChunkParams, *, body: str = "text") -> DataFrame:
    """Replace each text row by its windows.

    ``rows`` has ``doc_id`` and, when a document has several rows, an integer
    ``part`` giving their order; chunks are numbered over the whole document.
    Rows whose normalised text is empty yield nothing.  Without ``part`` no
    data moves; with it the windows are written once, to be numbered.
    """
    kept = [c for c in rows.columns if c != body]
    clean = rows.withColumn(body, text.normalise_newlines(F.col(body))).filter(F.col(body) != "")
    windows = clean.select(*kept, chunk_column(F.col(body), params).alias("__chunks"))
    index = F.col("__i")
    if "part" in rows.columns:
        # Cut once; the counts of earlier parts are a running value of few columns.
        windows = written(windows, "windows")
        count = ordered.Total(F.size("__chunks").cast("long"))
        windows = ordered.running(windows, ["doc_id"], "part", {"__before": count}, levels=2)
        index = F.col("__before") + index
    return (
        windows.select("*", F.posexplode_outer("__chunks").alias("__i", "__c"))
        .filter(F.col("__i").isNotNull())
        .select(
            *kept,
            index.cast("int").alias("chunk_index"),
            F.col("__c.start").alias("start"),
            F.col("__c.stop").alias("stop"),
            F.col("__c.text").alias("text"),
        )
    )

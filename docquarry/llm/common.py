"""Helpers shared by the corpus operators."""

from __future__ import annotations

import math
import threading
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docquarry.session import discard, exchanges_end, scratch_dir
from docquarry.session import release as release

# The paths settled in each open block of :func:`passing`, by thread.
_settled = threading.local()


def settle(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back.

    Cuts the lineage, so that an expensive scan runs once and a lost executor
    costs a reread instead of the whole job.  The files of its exchanges go with the write.
    """
    path = scratch_dir(df.sparkSession, label)
    for paths in getattr(_settled, "blocks", [])[-1:]:
        paths.append(path)
    with exchanges_end(df.sparkSession):
        df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@contextmanager
def passing() -> Iterator[Callable[[DataFrame, str], DataFrame]]:
    """A block whose settled tables are deleted at its end, but those settled by the function it gives.

    Whatever leaves the block has to be settled by that function, as all else is read no more.
    """
    blocks = _settled.blocks = getattr(_settled, "blocks", [])
    kept: list[str] = []
    blocks.append([])

    def keep(df: DataFrame, label: str) -> DataFrame:
        found = settle(df, label)
        kept.append(blocks[-1].pop())
        return found

    try:
        yield keep
    finally:
        for path in blocks.pop():
            discard(path)
        for paths in blocks[-1:]:
            paths.extend(kept)


def narrow(docs: DataFrame, id_col: str, *columns: Column) -> DataFrame:
    """The id as ``doc_id`` and the given columns; nothing else of ``docs`` is read."""
    return docs.select(F.col(id_col).alias("doc_id"), *columns)


def attach(docs: DataFrame, result: Column, fields: list[str]) -> DataFrame:
    """Append the fields of a struct column; an input column of the same name is replaced."""
    taken = {f.lower() for f in fields}
    kept = [F.col(f"`{c}`") for c in docs.columns if c.lower() not in taken]
    slot = "__result"
    while slot in docs.columns:
        slot += "_"
    return docs.withColumn(slot, result).select(
        *kept, *[F.col(f"`{slot}`.`{f}`").alias(f) for f in fields]
    )


def packed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(row, doc_id, text): every row as one struct, so that no column of it can clash with another name."""
    return docs.select(
        F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"),
        F.col(f"`{id_col}`").alias("doc_id"),
        F.col(f"`{text_col}`").alias("text"),
    )


def unpacked(rows: DataFrame, docs: DataFrame, **replaced: Column) -> DataFrame:
    """The columns of ``docs`` again; ``replaced`` ones by name."""
    return rows.select(*[replaced.get(c, F.col("row").getField(c)).alias(c) for c in docs.columns])


def rank_sample(rows: DataFrame, key: Column, bound: int, count: int) -> DataFrame:
    """About ``bound`` of ``count`` rows, chosen by a hash of ``key`` alone."""
    share = min(1.0, bound / max(count, 1))
    return rows.filter(F.pmod(F.xxhash64(key), F.lit(1 << 20)) < F.lit(math.ceil(share * (1 << 20))))


def scan(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")

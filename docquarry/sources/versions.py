"""Tables in hashed buckets that are replaced a few buckets at a time and published as a whole.

A new version writes the buckets it changes below ``data/<table>/version=N`` and then one small commit that
names, for every bucket, the version that holds it.  The commit is one file that appears at once, so a
reader sees the last whole version whatever a later writer did before it failed, and a repeated
version replaces its own files.  A write costs the touched buckets, a read those it asks for.
"""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docquarry.session import exchanges_end
from docquarry.sources.appended import open_store

_COMMIT = "table string, bucket int, since long"


@dataclass(frozen=True)
class Layout:
    """How a table is cut: the columns that its bucket is hashed from, and the number of buckets."""

    keys: tuple[str, ...]
    buckets: int = 64

    def bucket(self, keys: Sequence[str] | None = None) -> Column:
        if not self.keys:
            return F.lit(0)
        return F.pmod(F.xxhash64(*(keys or self.keys)), F.lit(self.buckets)).cast("int")

    def touched(self, rows: DataFrame) -> list[int]:
        """Buckets of these rows; at most the number of buckets."""
        return sorted(r[0] for r in rows.select(self.bucket().alias("b")).distinct().collect())

    def of_buckets(self, rows: DataFrame, some: Iterable[int]) -> DataFrame:
        return rows.filter(self.bucket().isin(list(some)))


class Snapshot:
    """One published version."""

    def __init__(self, spark: SparkSession, path: str, version: int | None, held: dict[tuple[str, int], int]):
        self.spark, self.path, self.version, self.held = spark, path, version, held

    def read(self, table: str, buckets: Iterable[int] | None = None) -> DataFrame | None:
        """Rows of the table, or of some of its buckets; None if there are none."""
        wanted = None if buckets is None else set(buckets)
        paths = [
            f"{self.path}/data/{table}/version={since}/bucket={bucket}"
            for (name, bucket), since in sorted(self.held.items())
            if name == table and (wanted is None or bucket in wanted)
        ]
        if not paths:
            return None
        return self.spark.read.option("basePath", f"{self.path}/data/{table}").parquet(*paths).drop("version", "bucket")


class VersionedTables:
    """Tables below ``path`` that share their commits."""

    def __init__(self, spark: SparkSession, path: str, layouts: dict[str, Layout]):
        self.spark, self.path, self.layouts = spark, path.rstrip("/"), layouts

    def snapshot(self, before: int | None = None) -> Snapshot:
        """The last published version (before one that is being written again)."""
        try:
            commits = self.spark.read.schema(f"{_COMMIT}, version long").parquet(f"{self.path}/commits")
        except AnalysisException as error:
            if error.getCondition() != "PATH_NOT_FOUND":
                raise
            return Snapshot(self.spark, self.path, None, {})
        if before is not None:
            commits = commits.filter(F.col("version") < before)
        last = commits.agg(F.max("version")).first()[0]
        # A row a bucket.
        held = [] if last is None else commits.filter(F.col("version") == last).collect()
        return Snapshot(
            self.spark, self.path, last, {(r["table"], r["bucket"]): r["since"] for r in held if r["bucket"] is not None}
        )

    def publish(
        self, version: int, changes: dict[str, tuple[DataFrame | Iterable[DataFrame], list[int]]], before: Snapshot
    ) -> None:
        """Replace the listed buckets of each table by the rows given for them, then commit.

        Rows given in parts (one at least) are written one part after the other, so that only one's exchanges
        lie on disk at once.
        """
        held = dict(before.held)
        for table, (rows, touched) in changes.items():
            place = f"{self.path}/data/{table}/version={version}"
            mode = "overwrite"
            for part in [rows] if isinstance(rows, DataFrame) else rows:
                bucketed = part.withColumn("bucket", self.layouts[table].bucket())
                # AQE splits a large bucket over many writers.
                with exchanges_end(self.spark):
                    bucketed.hint("rebalance", "bucket").write.mode(mode).option(
                        "partitionOverwriteMode", "static"
                    ).option("compression", "zstd").partitionBy("bucket").parquet(place)
                mode = "append"
            for bucket in touched:
                held.pop((table, bucket), None)
            for row in self._filled(place):
                held[table, row] = version
        rows = [(t, b, v) for (t, b), v in sorted(held.items())] or [("", None, version)]
        commit = self.spark.createDataFrame(rows, _COMMIT).coalesce(1)
        commit.write.mode("overwrite").option("partitionOverwriteMode", "static").parquet(
            f"{self.path}/commits/version={version}"
        )

    def _filled(self, place: str) -> list[int]:
        try:
            written = self.spark.read.parquet(place)
        except AnalysisException as error:
            if error.getCondition() != "UNABLE_TO_INFER_SCHEMA":
                raise
            return []
        return [r[0] for r in written.select("bucket").distinct().collect()] if "bucket" in written.columns else []

    def expire(self, keep: int = 2) -> None:
        """Delete versions that none of the last ``keep`` commits names; their readers must have ended.

        In stores that pyarrow has no file system for, old versions stay.
        """
        try:
            store, root = open_store(self.path)
        except pa.ArrowInvalid:
            return
        commits = self.spark.read.schema(f"{_COMMIT}, version long").parquet(f"{self.path}/commits")
        versions = sorted((r[0] for r in commits.select("version").distinct().collect()), reverse=True)
        kept = versions[:keep]
        used = {
            (r["table"], r["since"]) for r in commits.filter(F.col("version").isin(kept)).select("table", "since").distinct().collect()
        }
        for version in versions[keep:]:
            store.delete_dir(f"{root}/commits/version={version}")
        for table in self.layouts:
            for entry in store.get_file_info(fs.FileSelector(f"{root}/data/{table}", allow_not_found=True)):
                since = int(entry.base_name.partition("=")[2])
                if since <= versions[0] and (table, since) not in used:
                    store.delete_dir(entry.path)

"""Tailing the append-only request log."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from docquarry.functions import redact, text
from docquarry.operators import telemetry
from docquarry.sources import appended, jsonl
from docquarry.sources.versions import Layout, VersionedTables


def tail(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """Lines appended since the last checkpoint; the checkpoint holds each file's byte offset.

    Bytes appended to a file that was read before are new lines.  Files that disappear or
    shrink fail the query, as files of an append-only log are never rewritten.  Malformed lines,
    among them arrays and lines that are not UTF-8, are dropped.
    """
    lines = jsonl.parsed(appended.stream_lines(spark, path), schema)
    return jsonl.well_formed(lines.select("__row.*"))


def lines_of_run(
    spark: SparkSession, path: str, schema: T.StructType, starting: dict[str, int], conversations: DataFrame
) -> tuple[DataFrame, DataFrame]:
    """What a run appended after the recorded offsets: its cleaned rows, and the number of malformed lines.

    A line that is not UTF-8 is malformed.
    """
    lines = appended.lines_since(spark, path, starting)
    rows = jsonl.parsed(lines.withColumn("value", F.coalesce("value", F.lit("\ufffd"))), schema).select("__row.*")
    return run_logs(jsonl.well_formed(rows), conversations), jsonl.malformed_count(rows)


def run_logs(stream: DataFrame, conversations: DataFrame) -> DataFrame:
    """Rows of one run, explanations cleaned; a stream-static semi join."""
    return telemetry.sanitised(telemetry.of_run(stream, conversations))


def write_available(
    stream: DataFrame, path: str, checkpoint: str, mode: str = "append"
) -> StreamingQuery:
    """Process what is there, then stop; a later call continues."""
    query = (
        stream.writeStream.format("parquet")
        .option("path", path)
        .option("checkpointLocation", checkpoint)
        .outputMode(mode)
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    return query


def availability_counts(stream: DataFrame) -> DataFrame:
    """Running counts per role and state; ``cause`` is NULL for valid results."""
    marked = telemetry.by_role(stream).select(
        "role",
        F.when(F.lower("label") == "unknown", "unknown")
        .when(~text.is_blank(F.col("label")), "valid")
        .alias("state"),
        F.when(F.lower("label") == "unknown", redact.failure_cause(F.col("explanation"))).alias("cause"),
    )
    return marked.filter(F.col("state").isNotNull()).groupBy("role", "state", "cause").count()


def windowed_availability(stream: DataFrame, time: str, width: str, late: str) -> DataFrame:
    """The same per event-time window with a bound on late rows."""
    rows = stream.withWatermark(time, late).select(
        F.window(time, width).alias("window"),
        F.inline(
            F.array(
                F.struct(F.lit("relevance").alias("role"), F.col("retrieval.retrieval_relevance").alias("label")),
                F.struct(F.lit("groundedness").alias("role"), F.col("generation.groundedness_label").alias("label")),
            )
        ),
    )
    state = F.when(F.lower("label") == "unknown", "unknown").when(~text.is_blank(F.col("label")), "valid")
    return (
        rows.withColumn("state", state)
        .filter(F.col("state").isNotNull())
        .groupBy("window", "role", "state")
        .count()
    )


_TOTALS = {"totals": Layout(())}


def update_table(stream: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Publish the totals of a complete-mode aggregate as a new version each batch.

    A reader (see :func:`read_totals`) sees the last whole version, also while the next one is
    written or after its write failed.
    """

    def store(batch: DataFrame, batch_id: int) -> None:
        tables = VersionedTables(batch.sparkSession, path, _TOTALS)
        tables.publish(batch_id, {"totals": (batch, [0])}, tables.snapshot(batch_id))
        tables.expire()

    query = (
        stream.writeStream.outputMode("complete")
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .foreachBatch(store)
        .start()
    )
    query.awaitTermination()
    return query


def read_totals(spark: SparkSession, path: str) -> DataFrame | None:
    """The totals last published; None before the first."""
    return VersionedTables(spark, path, _TOTALS).snapshot().read("totals")

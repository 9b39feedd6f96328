"""Incremental ingest that skips bytes already indexed."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from docquarry.operators import ingest
from docquarry.params import ChunkParams
from docquarry.sources.versions import Layout, VersionedTables
from docquarry.streaming.tables import batch_rows, replace_batch

# What has been indexed, by bytes; a batch reads and replaces the buckets of its own files.
_KNOWN = {"known": Layout(("kb_id", "fingerprint"), 256)}


def index_uploads(
    uploads: DataFrame, path: str, checkpoint: str, params: ChunkParams, order: str
) -> StreamingQuery:
    """Append first copies of new files to the documents at ``path``, see :func:`indexed_uploads`.

    The bytes that were indexed before are kept as a table of hashed buckets: a batch
    costs the buckets that its files fall into, however many batches there were.
    """

    def store(batch: DataFrame, batch_id: int) -> None:
        known = VersionedTables(batch.sparkSession, f"{path}/state", _KNOWN)
        before = known.snapshot(batch_id)
        touched = _KNOWN["known"].touched(batch)
        seen = before.read("known", touched)
        replace_batch(ingest.first_copies(batch, seen, params, order), f"{path}/documents", batch_id)
        added = batch_rows(batch.sparkSession, f"{path}/documents", batch_id)
        if added is None:
            return
        keys = added.select(*ingest.COPY_KEYS)
        known.publish(batch_id, {"known": (keys if seen is None else keys.unionByName(seen), touched)}, before)
        known.expire()

    query = (
        uploads.writeStream.option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .foreachBatch(store)
        .start()
    )
    query.awaitTermination()
    return query


def indexed_uploads(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(f"{path}/documents")

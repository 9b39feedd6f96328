"""Streaming jobs over files derived from the tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from docquarry.params import ChunkParams
from docquarry.session import scratch_dir
from docquarry.streaming import logs as log_stream
from docquarry.streaming import sessions, uploads
from workload.dialogue import _SESSIONS
from workload.ingestion import _UPLOADS
from workload.logs import _RUN, EVENT_LOGS, EVENT_LOGS_SQL, _clean_sql, cause_sql, nested
from workload.tables import Registry, derive, plain

R = Registry()


def _log_files(spark, sf):
    """The event logs as nested JSON lines in several files."""
    path = scratch_dir(spark, "tail")
    frame = nested(derive(spark, sf, EVENT_LOGS))
    # A few large steps of arrival, whatever the size of the table.
    for half in ("value < 5", "value >= 5"):
        ids = derive(spark, sf, f"SELECT event_id FROM {{events}} WHERE {half}")
        frame.join(ids, "event_id", "left_semi").write.mode("append").option("ignoreNullFields", "false").json(path)
    return path, frame.schema


@R.add(
    "streamed_run_logs",
    f"""SELECT event_id, conversation_id, {_clean_sql('relevance_label', 'relevance_explanation')} FROM ({EVENT_LOGS_SQL})
    WHERE conversation_id IN ({plain(_RUN)})""",
)
def streamed_run_logs(spark, sf):
    path, schema = _log_files(spark, sf)
    out, checkpoint = scratch_dir(spark, "out"), scratch_dir(spark, "offsets")
    rows = log_stream.run_logs(log_stream.tail(spark, path, schema), derive(spark, sf, _RUN))
    flat = rows.select("event_id", "conversation_id", "retrieval.relevance_explanation")
    log_stream.write_available(flat, out, checkpoint)
    # Nothing new arrived: a second call adds no rows.
    log_stream.write_available(flat, out, checkpoint)
    return spark.read.parquet(out)


@R.add(
    "streamed_availability",
    f"""WITH l AS (SELECT 'relevance' AS role, relevance_label AS label, relevance_explanation AS e FROM ({EVENT_LOGS_SQL})
      UNION ALL SELECT 'groundedness', groundedness_label, groundedness_explanation FROM ({EVENT_LOGS_SQL}))
    SELECT role, CASE WHEN lower(label) = 'unknown' THEN 'unknown' ELSE 'valid' END AS state,
      CASE WHEN lower(label) = 'unknown' THEN {cause_sql('e')} END AS cause, count(*) AS count FROM l WHERE trim(label) <> '' GROUP BY ALL""",
)
def streamed_availability(spark, sf):
    path, schema = _log_files(spark, sf)
    out, checkpoint = scratch_dir(spark, "out"), scratch_dir(spark, "offsets")
    counts = log_stream.availability_counts(log_stream.tail(spark, path, schema))
    log_stream.update_table(counts, out, checkpoint)
    return log_stream.read_totals(spark, out)


@R.add(
    "streamed_uploads",
    f"""SELECT kb_id, fingerprint, count(*) AS n FROM (SELECT DISTINCT kb_id, fingerprint FROM ({plain(_UPLOADS)})) GROUP BY ALL""",
)
def streamed_uploads(spark, sf):
    source, out, checkpoint = (scratch_dir(spark, x) for x in ("uploads", "documents", "offsets"))
    files = derive(spark, sf, _UPLOADS)
    # Two arrivals of the same files: the second must add nothing.
    for _ in range(2):
        files.write.mode("append").parquet(source)
        stream = spark.readStream.schema(files.schema).parquet(source)
        uploads.index_uploads(stream, out, checkpoint, ChunkParams(600, 50), "doc_id")
    return uploads.indexed_uploads(spark, out).groupBy("kb_id", "fingerprint").agg(F.count("*").alias("n"))


@R.add(
    "streamed_admission",
    f"""WITH s AS (SELECT *, CASE WHEN trim(question) = '' THEN 'noop' WHEN length(trim(question)) > 2000 THEN 'too_long' ELSE 'valid' END AS state FROM ({plain(_SESSIONS)}))
    SELECT session_id, event_id, CASE WHEN state <> 'valid' THEN state
      WHEN row_number() OVER (PARTITION BY session_id, state ORDER BY ts, event_id) <= 5 THEN 'admitted' ELSE 'over_limit' END AS admission FROM s""",
)
def streamed_admission(spark, sf):
    source, out, checkpoint = (scratch_dir(spark, x) for x in ("asked", "admitted", "offsets"))
    asked = derive(spark, sf, _SESSIONS)
    # Two arrivals in time order; the second continues from the first.
    for half in ("ts < TIMESTAMP '2024-01-03 00:00:00'", "ts >= TIMESTAMP '2024-01-03 00:00:00'"):
        asked.filter(half).write.mode("append").parquet(source)
        stream = spark.readStream.schema(asked.schema).parquet(source)
        sessions.admit_available(stream, out, checkpoint, ["ts", "event_id"])
    return spark.read.parquet(f"{out}/admissions").select("session_id", "event_id", "admission")


@R.add(
    "streamed_admission_counts",
    f"""WITH s AS (SELECT session_id, CASE WHEN trim(question) = '' THEN 'noop' WHEN length(trim(question)) > 2000 THEN 'too_long' ELSE 'valid' END AS state FROM ({plain(_SESSIONS)})),
    c AS (SELECT session_id, state, count(*) AS n FROM s GROUP BY ALL)
    SELECT session_id, CASE WHEN state = 'valid' THEN 'admitted' ELSE state END AS admission, CASE WHEN state = 'valid' THEN least(n, 5) ELSE n END AS n FROM c
    UNION ALL SELECT session_id, 'over_limit', n - 5 FROM c WHERE state = 'valid' AND n > 5""",
)
def streamed_admission_counts(spark, sf):
    source = scratch_dir(spark, "asked")
    asked = derive(spark, sf, _SESSIONS)
    asked.write.parquet(source)
    stream = spark.readStream.schema(asked.schema).parquet(source)
    out, checkpoint = scratch_dir(spark, "admitted"), scratch_dir(spark, "offsets")
    log_stream.write_available(sessions.admit_continuously(stream), out, checkpoint)
    return spark.read.parquet(out).groupBy("session_id", "admission").agg(F.count("*").alias("n"))

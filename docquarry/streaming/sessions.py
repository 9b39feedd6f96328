"""Per-session question allowance over a stream."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from docquarry.functions import text
from docquarry.operators.admission import admit_questions
from docquarry.params import AdmissionLimits
from docquarry.sources.versions import Layout, VersionedTables
from docquarry.streaming.tables import batch_rows, replace_batch


# Questions each session has spent; a batch reads and replaces the buckets of its own sessions.
_SPENT = {"spent": Layout(("session_id",), 256)}


def admit_available(
    asked: DataFrame,
    path: str,
    checkpoint: str,
    order: list[str],
    limits: AdmissionLimits = AdmissionLimits(),
) -> StreamingQuery:
    """Label questions batch by batch in (``order``) sequence.

    Writes ``path/admissions`` and, as a table of hashed buckets, the allowance spent by each session:
    a batch costs the buckets that its sessions fall into, however many batches there were.
    Each batch runs the skew-safe batch operator, so no session is tied to one task.
    """

    def store(batch: DataFrame, batch_id: int) -> None:
        spent = VersionedTables(batch.sparkSession, f"{path}/state", _SPENT)
        before = spent.snapshot(batch_id)
        touched = _SPENT["spent"].touched(batch)
        used = before.read("spent", touched)
        known = used and used.join(batch.select("session_id").distinct(), "session_id", "left_semi")
        replace_batch(admit_questions(batch, order, limits, known), f"{path}/admissions", batch_id)
        done = batch_rows(batch.sparkSession, f"{path}/admissions", batch_id)
        if done is None:
            return
        now = done.filter(F.col("admission") == "admitted").groupBy("session_id").agg(
            F.count("*").cast("int").alias("used")
        )
        if used is not None:
            now = used.unionByName(now).groupBy("session_id").agg(F.sum("used").cast("int").alias("used"))
        spent.publish(batch_id, {"spent": (now, touched)}, before)
        spent.expire()

    query = (
        asked.writeStream.option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .foreachBatch(store)
        .start()
    )
    query.awaitTermination()
    return query


def admit_continuously(asked: DataFrame, limits: AdmissionLimits = AdmissionLimits()) -> DataFrame:
    """The same with one integer of keyed state, in order of arrival.

    For low latency; a session's rows of one micro-batch pass through one task
    in Arrow batches.  ``asked``: session_id, event_id, question.  Texts are
    classified in the JVM, the state function sees ids only.
    """
    clean = text.strip(F.coalesce("question", F.lit("")))
    marked = asked.select(
        "session_id",
        "event_id",
        F.when(clean == "", "noop")
        .when(F.length(clean) > limits.max_characters, "too_long")
        .otherwise("valid")
        .alias("kind"),
    )
    allowance = limits.max_questions

    def admit(key, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        used = state.get[0] if state.exists else 0
        for rows in batches:
            valid = rows["kind"] == "valid"
            place = used + valid.cumsum()
            admission = rows["kind"].mask(valid & (place <= allowance), "admitted")
            admission = admission.mask(valid & (place > allowance), "over_limit")
            used = min(allowance, used + int(valid.sum()))
            yield rows[["session_id", "event_id"]].assign(admission=admission)
        state.update((used,))

    schema = "session_id long, event_id long, admission string"
    return marked.groupBy("session_id").applyInPandasWithState(
        admit, schema, "used int", "append", "NoTimeout"
    )

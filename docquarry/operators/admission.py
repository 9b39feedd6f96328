"""Question and upload limits."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from docquarry.functions import text
from docquarry.params import AdmissionLimits, UploadLimits

# Upload rejections, in the order they are checked.
WRONG_TYPE = "Please upload only PDF, DOC, or DOCX files."
FILE_TOO_LARGE = "Each file must be at most 10 MiB."
TOO_MANY_DOCUMENTS = "The cloud knowledge base supports at most 3 documents."
TOO_MANY_BYTES = "The cloud knowledge base supports at most 20 MiB of uploaded files."


def admit_questions(
    asked: DataFrame,
    order: list[str],
    limits: AdmissionLimits = AdmissionLimits(),
    used: DataFrame | None = None,
) -> DataFrame:
    """Adds ``admission``: noop, too_long, admitted or over_limit.

    ``asked``: session_id, question and the unique ``order`` columns; ``used``:
    (session_id, used) allowance spent earlier.  Blank and over-long questions
    use up no allowance.  Only the few rows that can be admitted are ranked;
    everything else is compared with its session's cut-off, so a dominant
    session is never sorted in one task.
    """
    clean = text.strip(F.coalesce("question", F.lit("")))
    state = (
        F.when(clean == "", "noop")
        .when(F.length(clean) > limits.max_characters, "too_long")
        .otherwise("valid")
    )
    marked = asked.withColumn("__state", state).withColumn("__at", F.struct(*order))
    by_time = Window.partitionBy("session_id").orderBy("__at")
    first = (
        marked.filter(F.col("__state") == "valid")
        .select("session_id", "__at")
        .withColumn("__rn", F.row_number().over(by_time))
        .filter(F.col("__rn") <= limits.max_questions)
    )
    if used is None:
        left = first.withColumn("__left", F.lit(limits.max_questions))
    else:
        left = first.join(used, "session_id", "left").withColumn(
            "__left",
            F.greatest(F.lit(0), F.lit(limits.max_questions) - F.coalesce("used", F.lit(0))),
        )
    fits = F.col("__rn") <= F.col("__left")
    # A session is capped once its remaining allowance is fully taken.
    capped = (
        left.groupBy("session_id")
        .agg(
            F.max(F.when(fits, F.col("__at"))).alias("__last"),
            (F.count_if(fits) == F.any_value("__left")).alias("__capped"),
        )
        .filter(F.col("__capped"))
    )
    over = F.col("__capped").isNotNull() & ~F.coalesce(F.col("__at") <= F.col("__last"), F.lit(False))
    return (
        marked.join(capped, "session_id", "left")
        .withColumn(
            "admission",
            F.when(F.col("__state") != "valid", F.col("__state"))
            .when(over, "over_limit")
            .otherwise("admitted"),
        )
        .drop("__state", "__at", "__last", "__capped")
    )


def check_uploads(
    files: DataFrame,
    existing: DataFrame,
    bases: DataFrame,
    previous: DataFrame,
    limits: UploadLimits = UploadLimits(),
) -> DataFrame:
    """(kb_id, documents, total_bytes, rejection) of each upload batch.

    ``files``: kb_id, pos, path, size_bytes, fingerprint, chunk_size,
    chunk_overlap; ``existing``: kb_id, doc_id, size_bytes and the same key;
    ``bases``: kb_id, mode, current_mode; ``previous``: kb_id, fingerprint of
    the earlier uploader content.  The first failing rule rejects the batch.
    """
    key = ["fingerprint", "chunk_size", "chunk_overlap"]
    problem = F.when(~text.is_supported_file(F.col("path")), WRONG_TYPE).when(
        F.col("size_bytes") > limits.max_file_bytes, FILE_TOO_LARGE
    )
    first_problem = (
        files.withColumn("__problem", problem)
        .filter(F.col("__problem").isNotNull())
        .groupBy("kb_id")
        .agg(F.min_by("__problem", "pos").alias("__problem"))
    )
    removed = (
        previous.select("kb_id", "fingerprint")
        .join(files.select("kb_id", "fingerprint"), ["kb_id", "fingerprint"], "left_anti")
        .select("kb_id")
        .distinct()
        .withColumn("__removed", F.lit(True))
    )
    kept_bases = bases.filter((F.col("mode") != "single") & F.col("mode").eqNullSafe(F.col("current_mode")))
    kept = existing.join(kept_bases.select("kb_id"), "kb_id", "left_semi")
    old = kept.groupBy("kb_id").agg(
        F.count("*").alias("__old_n"), F.sum("size_bytes").alias("__old_bytes")
    )
    # Copies within the batch collapse before anything is counted.
    unique = files.groupBy("kb_id", *key).agg(
        F.min_by("size_bytes", "pos").alias("size_bytes"), F.min("pos").alias("pos")
    )
    single = bases.filter(F.col("mode") == "single").select("kb_id")
    only_first = (
        files.join(single, "kb_id", "left_semi")
        .groupBy("kb_id")
        .agg(F.min_by(F.struct("size_bytes", *key), "pos").alias("__f"))
        .select("kb_id", "__f.size_bytes")
    )
    several = (
        unique.join(single, "kb_id", "left_anti")
        .join(kept.select("kb_id", *key).distinct(), ["kb_id", *key], "left_anti")
        .select("kb_id", "size_bytes")
    )
    new = (
        only_first.unionByName(several)
        .groupBy("kb_id")
        .agg(F.count("*").alias("__new_n"), F.sum("size_bytes").alias("__new_bytes"))
    )
    zero = F.lit(0).cast("long")
    totals = (
        bases.join(first_problem, "kb_id", "left")
        .join(removed, "kb_id", "left")
        .join(old, "kb_id", "left")
        .join(new, "kb_id", "left")
        .withColumn("documents", F.coalesce("__old_n", zero) + F.coalesce("__new_n", zero))
        .withColumn("total_bytes", F.coalesce("__old_bytes", zero) + F.coalesce("__new_bytes", zero))
    )
    rejection = (
        F.when(F.col("__problem").isNotNull(), F.col("__problem"))
        .when((F.col("mode") == "multi") & F.col("__removed"), F.lit(None).cast("string"))
        .when(F.col("documents") > limits.max_documents, TOO_MANY_DOCUMENTS)
        .when(F.col("total_bytes") > limits.max_total_bytes, TOO_MANY_BYTES)
    )
    return totals.select("kb_id", "documents", "total_bytes", rejection.alias("rejection"))

"""Request records, their privacy projection and availability counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docquarry.functions import redact, text
from docquarry.functions.counts import is_finite
from docquarry.functions.shipping import ship_per_question
from docquarry.operators.dense import similarity

RAW_PREVIEW = 300
FINAL_PREVIEW = 500

# Labels a privacy event may carry.
KB_MODES = ("single", "multi")
ROUTES = ("keyword", "semantic", "balanced")
RELEVANCE = ("high", "medium", "low", "unknown")
GROUNDEDNESS = ("grounded", "partially_grounded", "not_grounded", "unknown")

_LATENCIES = (
    "retrieval_latency",
    "dense_latency",
    "bm25_latency",
    "fusion_latency",
    "rerank_latency",
    "retrieval_eval_latency",
    "groundedness_eval_latency",
    "llm_latency",
)
_WHOLE = ("retrieval_top_n", "rerank_candidate_n", "rerank_top_k", "total_tokens")
_REAL = ("fusion_alpha", "fusion_threshold", "relevance_score", *_LATENCIES)


def source_rows(
    sources: DataFrame,
    chunks: DataFrame,
    preview_chars: int,
    *,
    questions: DataFrame | None = None,
    per_question: int = 0,
) -> DataFrame:
    """Ranked sources with ids, rounded scores and a preview.

    ``sources``: query_id, rank, chunk_id, distance, fusion_score and, for final
    sources, rerank_score.  ``chunks`` carries the metadata and text; with
    ``questions`` and a row bound per question it is not moved.
    """
    if questions is not None:
        sources = ship_per_question(sources, questions, per_question)
    meta = chunks.select(
        "chunk_id",
        "doc_id",
        F.col("source_name").alias("file_name"),
        "page",
        "file_type",
        "doc_type",
        "section_header",
        text.preview(text.strip(F.col("text")), preview_chars).alias("content_preview"),
    )
    extra = (
        [F.bround("rerank_score", 6).alias("rerank_score")]
        if "rerank_score" in sources.columns
        else []
    )
    return meta.join(sources, "chunk_id").select(
        "query_id",
        "rank",
        "doc_id",
        "file_name",
        "chunk_id",
        "page",
        F.bround("distance", 6).alias("distance"),
        F.bround(similarity(F.col("distance")), 6).alias("similarity"),
        F.bround("fusion_score", 6).alias("fusion_score"),
        "content_preview",
        "file_type",
        "doc_type",
        "section_header",
        *extra,
    )


def _listed(rows: DataFrame, name: str) -> DataFrame:
    """Source rows of each question as one ordered array; a question has few."""
    fields = [c for c in rows.columns if c != "query_id"]
    return rows.groupBy("query_id").agg(
        F.array_sort(F.collect_list(F.struct(*fields))).alias(name)
    )


def request_records(
    requests: DataFrame, raw: DataFrame, final: DataFrame, margins: DataFrame
) -> DataFrame:
    """One nested record per request.

    ``requests``: query_id and the flat request columns; ``raw``/``final``:
    :func:`source_rows` of the fusion survivors and of the reranked rows;
    ``margins``: query_id, rerank_margin.
    """
    joined = requests.join(_listed(raw, "raw_retrieval"), "query_id", "left").join(
        _listed(final, "final_sources"), "query_id", "left"
    ).join(margins, "query_id", "left")
    n = lambda c: F.coalesce(F.size(F.col(c)), F.lit(0))
    survivors = F.when(F.col("raw_retrieval").isNull(), 0).otherwise(n("raw_retrieval"))
    finals = F.when(F.col("final_sources").isNull(), 0).otherwise(n("final_sources"))
    four = lambda c: F.bround(F.col(c).cast("double"), 4)
    latency = F.struct(
        *[
            four(f"{c}_latency").alias(f"{'total' if c == 'retrieval' else c}_seconds")
            for c in ("retrieval", "dense", "bm25", "fusion", "rerank")
        ]
    )
    retrieval = F.struct(
        F.col("retrieval_route").alias("route"),
        four("fusion_alpha").alias("fusion_alpha"),
        "retrieval_top_n",
        "rerank_candidate_n",
        "rerank_top_k",
        four("fusion_threshold").alias("fusion_threshold"),
        latency.alias("latency"),
        survivors.alias("num_fusion_survivors"),
        F.least(survivors, F.col("rerank_candidate_n")).alias("num_reranker_candidates"),
        "raw_retrieval",
        "final_sources",
        "rerank_margin",
        "retrieval_relevance",
        four("relevance_score").alias("relevance_score"),
        "relevance_explanation",
        four("retrieval_eval_latency").alias("retrieval_eval_latency"),
        finals.alias("num_final_sources"),
    )
    generation = F.struct(
        "answer",
        "groundedness_label",
        "groundedness_explanation",
        four("groundedness_eval_latency").alias("groundedness_eval_latency"),
    )
    return joined.select(
        "timestamp",
        "conversation_id",
        "query_id",
        "kb_mode",
        "active_doc_names",
        F.struct(
            F.col("original_query").alias("original"), F.col("rewritten_query").alias("rewritten")
        ).alias("query"),
        retrieval.alias("retrieval"),
        generation.alias("generation"),
        F.struct("total_tokens", four("llm_latency").alias("latency_seconds")).alias("llm_metrics"),
    )


def _allowed(value: Column, labels: tuple[str, ...]) -> Column:
    return F.when(value.isin(*labels), value).otherwise("unknown")


def privacy_events(requests: DataFrame) -> DataFrame:
    """Content-free event per request, built from named columns only.

    Any number that is not finite turns the whole event into an error event.
    """
    numbers = [*_REAL, *_WHOLE]
    broken = F.lit(False)
    for c in numbers:
        value = F.col(c).cast("double")
        broken = broken | (value.isNotNull() & ~is_finite(value))
    keep = lambda c: F.when(~F.col("__broken"), c)
    real = lambda c: keep(F.bround(F.col(c).cast("double"), 4)).alias(c)
    whole = lambda c: keep(F.col(c).try_cast("bigint")).alias(c)
    label = lambda c, allowed: keep(_allowed(F.col(c), allowed)).alias(c)
    marked = requests.withColumn("__broken", broken)
    return marked.select(
        "request_id",
        F.when(F.col("__broken"), "rag_telemetry_error").otherwise("rag_request_completed").alias("event"),
        keep(F.col("timestamp")).alias("timestamp"),
        label("kb_mode", KB_MODES),
        label("retrieval_route", ROUTES),
        real("fusion_alpha"),
        whole("retrieval_top_n"),
        whole("rerank_candidate_n"),
        whole("rerank_top_k"),
        real("fusion_threshold"),
        keep(F.col("num_fusion_survivors")).alias("num_fusion_survivors"),
        keep(F.least("num_fusion_survivors", F.col("rerank_candidate_n").try_cast("bigint"))).alias(
            "num_reranker_candidates"
        ),
        keep(F.col("num_final_sources")).alias("num_final_sources"),
        label("retrieval_relevance", RELEVANCE),
        real("relevance_score"),
        label("groundedness_label", GROUNDEDNESS),
        *[real(c) for c in _LATENCIES],
        whole("total_tokens"),
    )


def of_run(logs: DataFrame, conversations: DataFrame) -> DataFrame:
    """Log rows of the run's conversations."""
    ids = conversations.select("conversation_id").distinct()
    return logs.join(ids, "conversation_id", "left_semi")


def sanitised(logs: DataFrame) -> DataFrame:
    """Clean the two explanation fields of nested records; all else is kept."""

    def clean(label: Column, explanation: Column) -> Column:
        return F.when(
            explanation.isNotNull(),
            F.when(F.lower(label) == "unknown", redact.failure_summary(explanation)).otherwise(
                redact.log_explanation(explanation)
            ),
        )

    r, g = F.col("retrieval"), F.col("generation")
    return logs.withColumn(
        "retrieval",
        r.withField(
            "relevance_explanation", clean(r["retrieval_relevance"], r["relevance_explanation"])
        ),
    ).withColumn(
        "generation",
        g.withField(
            "groundedness_explanation",
            clean(g["groundedness_label"], g["groundedness_explanation"]),
        ),
    )


def by_role(logs: DataFrame) -> DataFrame:
    """Two rows per record: (role, label, explanation)."""
    roles = F.array(
        F.struct(
            F.lit("relevance").alias("role"),
            F.col("retrieval.retrieval_relevance").alias("label"),
            F.col("retrieval.relevance_explanation").alias("explanation"),
        ),
        F.struct(
            F.lit("groundedness").alias("role"),
            F.col("generation.groundedness_label").alias("label"),
            F.col("generation.groundedness_explanation").alias("explanation"),
        ),
    )
    return logs.select(F.inline(roles))


def availability(logs: DataFrame) -> DataFrame:
    """(role, measure, n): valid, unknown and unknown per cause, zero-filled."""
    marked = by_role(logs).select(
        "role",
        (F.lower("label") == "unknown").alias("unknown"),
        ((F.lower("label") != "unknown") & ~text.is_blank(F.col("label"))).alias("valid"),
        redact.failure_cause(F.col("explanation")).alias("cause"),
    )
    measures = [("valid", F.col("valid")), ("unknown", F.col("unknown"))] + [
        (f"unknown:{c}", F.col("unknown") & (F.col("cause") == c)) for c in redact.CAUSES
    ]
    # Both roles are present even without logs: one global row, unpivoted.
    wide = marked.agg(
        *[
            F.count_if(F.coalesce((F.col("role") == role) & cond, F.lit(False))).alias(f"{role}|{m}")
            for role in ("relevance", "groundedness")
            for m, cond in measures
        ]
    )
    cells = [
        F.struct(
            F.lit(role).alias("role"), F.lit(m).alias("measure"), F.col(f"`{role}|{m}`").alias("n")
        )
        for role in ("relevance", "groundedness")
        for m, _ in measures
    ]
    return wide.select(F.inline(F.array(*cells)))

"""Weighted fusion of the two retrieval branches."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from docquarry.functions.shipping import ship_per_question

FUSION_DIGITS = 10
# Fixed value: distance shown for a chunk the dense branch did not return.
MISSING_DISTANCE = 1.0


def fuse(
    dense: DataFrame,
    lexical: DataFrame,
    questions: DataFrame,
    *,
    threshold: float = 0.0,
    lookup: DataFrame | None = None,
    per_question: int | None = None,
) -> DataFrame:
    """(query_id, chunk_id, distance, dense, bm25, fusion_score, fusion_rank).

    ``dense``: query_id, chunk_id, distance, dense; ``lexical``: query_id,
    chunk_id, bm25; ``questions``: query_id, alpha; ``lookup``: chunk_id of the
    active chunks - a lexical-only chunk outside it is dropped.  Ties follow
    chunk_id.  A threshold of 0 or less keeps everything.  ``per_question`` is
    the top-N of the lexical branch; with it the lookup table is not moved.
    """
    both = (
        dense.select("query_id", "chunk_id", "distance", "dense")
        .join(lexical.select("query_id", "chunk_id", "bm25"), ["query_id", "chunk_id"], "full_outer")
    )
    if lookup is not None:
        needed = lexical.select("chunk_id").distinct()
        if per_question is not None:
            needed = ship_per_question(needed, questions, per_question)
        known = (
            lookup.select("chunk_id")
            .join(needed, "chunk_id", "left_semi")
            .distinct()
            .withColumn("__known", F.lit(True))
        )
        both = (
            both.join(known, "chunk_id", "left")
            .filter(F.col("dense").isNotNull() | F.col("__known"))
            .drop("__known")
        )
    scored = both.join(questions.select("query_id", "alpha"), "query_id").select(
        "query_id",
        "chunk_id",
        F.coalesce("distance", F.lit(MISSING_DISTANCE)).alias("distance"),
        F.coalesce("dense", F.lit(0.0)).alias("dense"),
        F.coalesce("bm25", F.lit(0.0)).alias("bm25"),
        "alpha",
    ).withColumn(
        "fusion_score",
        F.round(
            F.col("alpha") * F.col("dense") + (F.lit(1) - F.col("alpha")) * F.col("bm25"),
            FUSION_DIGITS,
        ),
    )
    if threshold > 0:
        scored = scored.filter(F.col("fusion_score") >= threshold)
    order = Window.partitionBy("query_id").orderBy(F.col("fusion_score").desc(), "chunk_id")
    return scored.drop("alpha").withColumn("fusion_rank", F.row_number().over(order))


def candidates(fused: DataFrame, limit: int) -> DataFrame:
    """The fused rows that reach the expensive scorer."""
    return fused.filter(F.col("fusion_rank") <= limit)


def stage_counts(
    questions: DataFrame, fused: DataFrame, reranked: DataFrame, candidate_limit: int
) -> DataFrame:
    """Rows surviving each stage per question, 0 included."""
    survivors = fused.groupBy("query_id").agg(F.count("*").alias("num_fusion_survivors"))
    final = reranked.groupBy("query_id").agg(F.count("*").alias("num_final_sources"))
    zero = F.lit(0)
    return (
        questions.select("query_id")
        .join(survivors, "query_id", "left")
        .join(final, "query_id", "left")
        .select(
            "query_id",
            F.coalesce("num_fusion_survivors", zero).alias("num_fusion_survivors"),
            F.least(F.coalesce("num_fusion_survivors", zero), F.lit(candidate_limit)).alias(
                "num_reranker_candidates"
            ),
            F.coalesce("num_final_sources", zero).alias("num_final_sources"),
        )
    )

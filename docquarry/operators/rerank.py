"""Joint question-passage scoring of the capped candidates."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docquarry.functions import text
from docquarry.functions.shipping import ship_per_question, ship_texts

SCORE_DIGITS = 10
PairScorer = Callable[[pd.Series, pd.Series], pd.Series]


def token_overlap(question: Column, passage: Column) -> Column:
    """Default scorer: share of the question's distinct tokens found in the passage."""
    asked = F.array_distinct(text.tokens(question))
    shared = F.size(F.array_intersect(asked, text.tokens(passage)))
    return F.round(F.coalesce(F.try_divide(shared, F.size(asked)), F.lit(0.0)), SCORE_DIGITS)


def model_score(make_scorer: Callable[[], PairScorer]) -> Callable[[Column, Column], Column]:
    """Scorer from a caller-supplied model, loaded once per Python worker batch stream."""

    @F.pandas_udf("double")
    def scores(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        predict = make_scorer()
        for questions, passages in batches:
            yield predict(questions, passages).astype("float64")

    return scores


def rerank(
    candidates: DataFrame,
    questions: DataFrame,
    passages: DataFrame,
    top_k: int,
    scorer: Callable[[Column, Column], Column] = token_overlap,
    *,
    per_question: int | None = None,
) -> DataFrame:
    """Best K by joint score; equal scores keep the fusion order.

    Texts stay out of the ranking plan until here: ``questions`` (query_id,
    question) and ``passages`` (chunk_id, passage) join the capped candidates.
    ``per_question`` is the cap the candidates were cut to.  Candidates are sent to the passages without
    a text; each question's text is sent once, if all of them are small.
    """
    if per_question is not None:
        candidates = ship_per_question(candidates, questions, per_question)
    pairs = passages.select("chunk_id", "passage").join(candidates, "chunk_id")
    pairs = pairs.join(ship_texts(questions.select("query_id", "question"), "question"), "query_id")
    scored = pairs.withColumn("rerank_score", scorer(F.col("question"), F.col("passage"))).drop(
        "question", "passage"
    )
    order = Window.partitionBy("query_id").orderBy(F.col("rerank_score").desc(), "fusion_rank")
    return scored.withColumn("rank", F.row_number().over(order)).filter(
        F.col("rank") <= max(1, int(top_k))
    )


def margin(reranked: DataFrame) -> DataFrame:
    """Score of the first minus the second row; NULL with fewer than two."""
    at = lambda r: F.max(F.when(F.col("rank") == r, F.col("rerank_score")))
    return reranked.groupBy("query_id").agg(F.bround(at(1) - at(2), 6).alias("rerank_margin"))

"""Comparison of checker models on the same cases."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docquarry.functions import redact, text
from docquarry.functions.counts import domain_counts, for_each, is_finite, listed
from docquarry.functions.quantiles import summarise
from docquarry.operators.checks import GROUNDEDNESS_LABELS, RELEVANCE_LABELS

UNUSABLE = {
    "relevance": "Relevance checker returned an unknown or malformed result.",
    "groundedness": "Groundedness checker returned an unknown or malformed result.",
}


def model_order(case_ordinal: Column, position: Column, models: int) -> Column:
    """1-based place of a model: as listed on even cases, reversed on odd ones."""
    return F.when(case_ordinal % 2 == 0, position + 1).otherwise(F.lit(models) - position)


def _latency_ok(value: Column) -> Column:
    return value.isNull() | (is_finite(value) & (value >= 0))


def result_rows(results: DataFrame) -> DataFrame:
    """Validity, status and error text of raw results of both checkers.

    ``results``: relevance_label, relevance_score, relevance_explanation,
    relevance_latency, groundedness_label, groundedness_explanation,
    groundedness_latency.
    """

    def problem(role: str, valid: Column) -> Column:
        said = F.col(f"{role}_explanation")
        return F.when(
            ~valid,
            F.when(~text.is_blank(said), redact.error_message(said)).otherwise(F.lit(UNUSABLE[role])),
        )

    def has_text(role: str) -> Column:
        return ~text.is_blank(F.col(f"{role}_explanation"))

    score = F.col("relevance_score")
    relevant = (
        F.coalesce(F.col("relevance_label").isin(*RELEVANCE_LABELS), F.lit(False))
        & is_finite(score)
        & F.coalesce(score.between(0.0, 1.0), F.lit(False))
        & has_text("relevance")
        & _latency_ok(F.col("relevance_latency"))
    )
    grounded = (
        F.coalesce(F.col("groundedness_label").isin(*GROUNDEDNESS_LABELS), F.lit(False))
        & has_text("groundedness")
        & _latency_ok(F.col("groundedness_latency"))
    )
    marked = results.withColumn("__r", problem("relevance", relevant)).withColumn(
        "__g", problem("groundedness", grounded)
    )
    errors = F.nullif(F.concat_ws("; ", "__r", "__g"), F.lit(""))
    return (
        marked.withColumn("status", F.when(errors.isNull(), "success").otherwise("error"))
        .withColumn("error", errors)
        .withColumn("relevance_label", F.coalesce("relevance_label", F.lit("unknown")))
        .withColumn("groundedness_label", F.coalesce("groundedness_label", F.lit("unknown")))
        .withColumn("relevance_score", F.when(F.col("__r").isNull(), score))
        .drop("__r", "__g")
    )


LATENCY_PARTS = ("relevance", "groundedness", "combined")


def _models(results: DataFrame, models: Sequence[str]) -> DataFrame:
    return listed(results.sparkSession, models, "model_id")


def per_model(results: DataFrame, selected_count: Column, models: Sequence[str]) -> DataFrame:
    """Coverage, success and validity counts and rates of every listed model, 0 without results."""
    rated = F.coalesce(F.col("relevance_label").isin(*RELEVANCE_LABELS), F.lit(False)) & F.col(
        "relevance_score"
    ).isNotNull()
    grounded = F.col("groundedness_label").isin(*GROUNDEDNESS_LABELS)
    counted = results.groupBy("model_id").agg(
        F.count("*").alias("result_count"),
        F.count_if(F.col("status") == "success").alias("successful_result_count"),
        F.count_if(~F.col("status").eqNullSafe("success")).alias("error_result_count"),
        F.count_if(rated).alias("relevance_valid_result_count"),
        F.count_if(grounded).alias("groundedness_valid_result_count"),
    )
    rate = lambda c: F.coalesce(F.try_divide(F.col(c), selected_count), F.lit(0.0))
    counts = [c for c in counted.columns if c != "model_id"]
    return for_each(_models(results, models), counted, counts).select(
        "*",
        rate("result_count").alias("result_coverage"),
        rate("relevance_valid_result_count").alias("relevance_valid_result_rate"),
        rate("groundedness_valid_result_count").alias("groundedness_valid_result_rate"),
    )


def label_distribution(
    results: DataFrame,
    column: str,
    labels: Sequence[str],
    selected_count: int | Column,
    models: Sequence[str],
) -> DataFrame:
    """(model_id, label, n) of every listed model, incl. 'unknown' (outside the set) and 'missing'."""
    expected = selected_count if isinstance(selected_count, Column) else F.lit(selected_count)
    listed = _models(results, models)
    cells = listed.select("model_id", F.explode(F.array(*[F.lit(x) for x in (*labels, "unknown")])).alias("label"))
    counted = domain_counts(
        results, F.col(column), labels, keys=["model_id"], other="unknown"
    )
    known = for_each(cells, counted, ["n"])
    sizes = for_each(listed, results.groupBy("model_id").agg(F.count("*").alias("n")), ["n"])
    missing = sizes.withColumn("n", F.greatest(F.lit(0).cast("long"), expected - F.col("n")))
    return known.unionByName(missing.select("model_id", F.lit("missing").alias("label"), "n"))


def paired(
    results: DataFrame, keys: Sequence[str], models: tuple[str, str], column: str, labels: Sequence[str]
) -> DataFrame:
    """Cases on which both models gave a valid label: keys, left_label, right_label.

    One aggregation on the case key instead of a self-join.
    """
    at = lambda m: F.max(F.when(F.col("model_id") == m, F.col(column)))
    both = results.filter(F.col("model_id").isin(*models)).groupBy(*keys).agg(
        at(models[0]).alias("left_label"), at(models[1]).alias("right_label")
    )
    return both.filter(F.col("left_label").isin(*labels) & F.col("right_label").isin(*labels))


def agreement(pairs: DataFrame) -> DataFrame:
    equal = F.col("left_label") == F.col("right_label")
    return pairs.agg(
        F.count("*").alias("eligible_case_count"),
        F.count_if(equal).alias("agreement_count"),
        F.try_divide(F.count_if(equal), F.count("*")).alias("agreement_rate"),
    )


def disagreements(pairs: DataFrame) -> DataFrame:
    return pairs.filter(F.col("left_label") != F.col("right_label"))


def disagreement_cases(*pair_sets: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Distinct cases that differ on any label, in key order."""
    union = disagreements(pair_sets[0]).select(*keys)
    for pairs in pair_sets[1:]:
        union = union.unionByName(disagreements(pairs).select(*keys))
    return union.distinct().orderBy(*keys)


def combined_latency(relevance: Column, groundedness: Column) -> Column:
    """Sum of the recorded parts; NULL when neither is recorded."""
    zero = F.lit(0.0)
    return F.when(
        F.coalesce(relevance, groundedness).isNotNull(),
        F.coalesce(relevance, zero) + F.coalesce(groundedness, zero),
    )


def latency_summaries(results: DataFrame, models: Sequence[str]) -> DataFrame:
    """(model_id, part, n, mean, median, maximum) over finite values >= 0.

    Every listed model has its three parts; n is 0 and the rest NULL without values.
    """
    r, g = F.col("relevance_latency"), F.col("groundedness_latency")
    cells = F.array(
        F.struct(F.lit("relevance").alias("part"), r.alias("value")),
        F.struct(F.lit("groundedness").alias("part"), g.alias("value")),
        F.struct(F.lit("combined").alias("part"), combined_latency(r, g).alias("value")),
    )
    usable = results.select("model_id", F.inline(cells)).filter(
        is_finite(F.col("value")) & (F.col("value") >= 0)
    )
    cells = _models(results, models).select(
        "model_id", F.explode(F.array(*[F.lit(p) for p in LATENCY_PARTS])).alias("part")
    )
    return for_each(cells, summarise(usable, ["model_id", "part"], "value").drop("p95"), ["n"])


def run_status(results: DataFrame, expected: Column) -> DataFrame:
    """incomplete, complete_with_errors or complete, with the counts behind it."""
    totals = results.agg(
        F.count("*").alias("results"), F.count_if(~F.col("status").eqNullSafe("success")).alias("errors")
    )
    return totals.withColumn("expected", expected).withColumn(
        "run_status",
        F.when(F.col("results") != F.col("expected"), "incomplete")
        .when(F.col("errors") > 0, "complete_with_errors")
        .otherwise("complete"),
    )

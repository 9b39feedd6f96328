"""Roll-ups of recorded semantic judgements."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docquarry.functions.counts import domain_counts
from docquarry.operators.answer_f1 import ANSWER_TYPES

# Transport counters and their sums.
COUNT_FIELDS = (
    "provider_attempt_count",
    "retry_count",
    "rate_limit_response_count",
    "rate_limit_retry_count",
    "other_transient_retry_count",
    "schema_output_retry_count",
)
SECONDS_FIELDS = ("pacing_sleep_seconds", "retry_backoff_sleep_seconds")
ERROR_FIELDS = (
    "final_provider_error_category",
    "final_http_status",
    "final_provider_error_type",
    "final_provider_error_code",
    "final_retry_decision",
)

# Upper bounds of the score bands.
BANDS = (("0-1", 0.1), ("2-4", 0.4), ("5-6", 0.6), ("7-8", 0.8), ("9-10", None))

# Provider codes that mean unusable structured output.
SCHEMA_CODES = (
    "failed_generation",
    "invalid_json",
    "json_generation_failed",
    "json_schema_validation_failed",
    "json_validate_failed",
    "malformed_json",
    "model_output_invalid",
    "schema_generation_failed",
    "schema_output_validation_failed",
)

# Messages of failed cases and scores.
GENERATION_FAILED = (
    "Generation failed, so semantic correctness is zero without invoking the judge."
)
OUT_OF_RANGE = "DeepEval returned out-of-range score "
NO_REFERENCE_RESULTS = "The case has no reference results."


def reference_results(outputs: DataFrame, threshold: float) -> DataFrame:
    """Judge outputs (score, reason, error_type, error_message) as reference results.

    A score outside [0, 1] is an error of its own.
    """
    out_of_range = ~F.coalesce(F.col("score").between(0.0, 1.0), F.lit(False))
    failed = F.col("error_type").isNotNull()
    bad = failed | out_of_range
    message = F.when(failed, F.col("error_message")).otherwise(
        F.concat(F.lit(OUT_OF_RANGE), F.col("score").cast("string"), F.lit("."))
    )
    rest = [c for c in outputs.columns if c not in ("score", "reason", "error_type", "error_message")]
    return outputs.select(
        *rest,
        F.when(bad, "judge_error").otherwise("success").alias("status"),
        F.when(~bad, F.col("score")).alias("semantic_score"),
        F.when(~bad, F.col("score") >= threshold).alias("passed"),
        F.when(~bad, F.col("reason")).alias("judge_reason"),
        F.when(failed, F.col("error_type")).when(out_of_range, "ValueError").alias("error_type"),
        F.when(bad, message).alias("error_message"),
    )


def resolve_cases(
    cases: DataFrame, results: DataFrame, keys: Sequence[str], threshold: float
) -> DataFrame:
    """Case score: 0 after a generation failure, NULL if any reference failed or
    there is none, else the best reference (the first wins ties).

    ``cases``: keys, generation_status; ``results``: keys, reference_index,
    annotation_id, reference_answer, answer_type and :func:`reference_results`.
    """
    failed = F.col("status") != "success"
    winner = F.struct(
        "reference_index", "annotation_id", "reference_answer", "answer_type", "semantic_score", "judge_reason"
    )
    per_case = results.groupBy(*keys).agg(
        F.count("*").alias("reference_count"),
        F.count_if(~failed).alias("successful_references"),
        F.count_if(failed).alias("failed_references"),
        F.min_by(
            F.when(failed, F.struct("error_type", "error_message")),
            F.when(failed, F.col("reference_index")),
        ).alias("__error"),
        F.max_by(
            winner, F.when(~failed, F.struct(F.col("semantic_score"), -F.col("reference_index")))
        ).alias("__w"),
    )
    joined = cases.join(per_case, list(keys), "left")
    broken = F.col("generation_status") != "success"
    unjudged = F.col("reference_count").isNull()
    partial = ~broken & (unjudged | (F.col("failed_references") > 0))
    good = ~broken & ~partial
    won = lambda field: F.when(good, F.col(f"__w.{field}"))
    return joined.select(
        *cases.columns,
        F.when(broken, "generation_error").when(partial, "judge_error").otherwise("success").alias("status"),
        F.when(broken, 0.0).when(good, F.col("__w.semantic_score")).alias("semantic_score"),
        F.when(broken, False).when(good, F.col("__w.semantic_score") >= threshold).alias("passed"),
        F.when(broken, GENERATION_FAILED).when(good, F.col("__w.judge_reason")).alias("judge_reason"),
        won("reference_index").alias("matched_reference_index"),
        won("annotation_id").alias("matched_annotation_id"),
        won("reference_answer").alias("matched_reference"),
        won("answer_type").alias("matched_answer_type"),
        F.when(partial, F.when(unjudged, NO_REFERENCE_RESULTS).otherwise(F.col("__error.error_message"))).alias(
            "error_message"
        ),
        F.when(broken, 0).otherwise(F.coalesce("successful_references", F.lit(0))).alias("successful_references"),
        F.when(broken, 0).otherwise(F.coalesce("failed_references", F.lit(0))).alias("failed_references"),
        F.coalesce("reference_count", F.lit(0)).alias("reference_count"),
    )


def case_transport(results: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Transport telemetry of a case from its references; the last error wins."""
    error = F.struct(*ERROR_FIELDS)
    has_error = F.col("final_provider_error_category").isNotNull()
    rolled = results.groupBy(*keys).agg(
        *[F.sum(c).alias(c) for c in COUNT_FIELDS],
        *[F.bround(F.sum(c), 6).alias(c) for c in SECONDS_FIELDS],
        F.bool_or("retry_after_used").alias("retry_after_used"),
        F.max_by(F.when(has_error, error), F.when(has_error, F.col("reference_index"))).alias("__e"),
    )
    return rolled.select("*", *[F.col(f"__e.{c}").alias(c) for c in ERROR_FIELDS]).drop("__e")


def run_metrics(
    selected: DataFrame, judged: DataFrame, keys: Sequence[str], *, subset: bool = False
) -> DataFrame:
    """Coverage, mean, pass rate and the full-run value as one row."""
    joined = selected.select(*keys, "generation_status").join(
        judged.select(*keys, "status", "semantic_score", "passed"), list(keys), "left"
    )
    scored = F.count("semantic_score")
    base = joined.agg(
        F.count("*").alias("selected_case_count"),
        F.count_if(F.col("generation_status") == "success").alias("successful_generation_count"),
        F.count_if(F.col("generation_status") != "success").alias("generation_error_count"),
        F.count_if(F.col("status") == "success").alias("successful_judgment_count"),
        F.count_if(F.col("status") == "judge_error").alias("judge_error_count"),
        scored.alias("non_null_evaluated_case_count"),
        F.coalesce(F.try_divide(scored, F.count("*")), F.lit(0.0)).alias("evaluation_coverage"),
        F.avg("semantic_score").alias("mean_semantic_correctness"),
        F.try_divide(
            F.count_if(F.col("semantic_score").isNotNull() & F.col("passed")), scored
        ).alias("pass_rate"),
    )
    full = (F.col("evaluation_coverage") == 1.0) & F.lit(not subset)
    return base.withColumn(
        "full_run_semantic_correctness", F.when(full, F.col("mean_semantic_correctness"))
    )


def band(score: Column) -> Column:
    name = F.lit(BANDS[-1][0])
    for label, upper in reversed(BANDS[:-1]):
        name = F.when(score <= upper, label).otherwise(name)
    return F.when(score.isNotNull(), name)


def band_counts(judged: DataFrame) -> DataFrame:
    return domain_counts(judged, band(F.col("semantic_score")), [b for b, _ in BANDS], name="band")


def reliability(selected: DataFrame, attempts: DataFrame) -> DataFrame:
    """Transport totals over the deciding attempts, errors over the history."""
    covered = F.col(COUNT_FIELDS[0]).isNotNull()
    zero = F.lit(0).cast("long")
    totals = selected.agg(
        F.coalesce(F.sum("provider_attempt_count"), zero).alias("total_provider_attempts"),
        F.count_if(F.col("retry_count") > 0).alias("cases_requiring_retry_count"),
        *[
            F.coalesce(F.sum(c), zero).alias(f"total_{c}")
            for c in COUNT_FIELDS[1:]
        ],
        *[F.bround(F.coalesce(F.sum(c), F.lit(0.0)), 6).alias(f"total_{c}") for c in SECONDS_FIELDS],
        F.count_if(covered).alias("telemetry_covered_selected_case_count"),
        F.count_if(F.col("status") == "judge_error").alias("unresolved_judge_error_count"),
    )
    history = attempts.agg(
        F.count_if(F.col("status") == "judge_error").alias("historical_judge_error_attempt_count")
    )
    return totals.join(history)


def reference_totals(judged: DataFrame) -> DataFrame:
    """Successful, failed and expected reference judgements and non-first winners."""
    return judged.agg(
        F.sum("successful_references").alias("successful_reference_judgment_count"),
        F.sum("failed_references").alias("reference_judgment_error_count"),
        F.coalesce(
            F.sum(F.when(F.col("generation_status") == "success", F.col("reference_count"))),
            F.lit(0),
        ).alias("expected_reference_judgment_count"),
        F.count_if(F.col("matched_reference_index") > 0).alias("non_first_winning_reference_count"),
    )


def reference_count_distribution(judged: DataFrame) -> DataFrame:
    return judged.groupBy("reference_count").agg(F.count("*").alias("cases"))


def matched_type_counts(judged: DataFrame) -> DataFrame:
    return domain_counts(
        judged, F.col("matched_answer_type"), ANSWER_TYPES, name="answer_type", count="cases"
    )


def provider_token(value: Column) -> Column:
    """Provider error names as lower-case words joined by underscores."""
    words = F.regexp_replace(F.lower(F.trim(value)), "[^a-z0-9]+", "_")
    return F.nullif(F.substring(F.regexp_replace(words, "^_+|_+$", ""), 1, 100), F.lit(""))


def failure_category(kind: Column, status: Column, error_type: Column, error_code: Column) -> Column:
    """Category of a recorded request failure.

    ``kind``: 'output', 'timeout', 'connection', 'status' or other.
    """
    http = status.isNotNull()
    schema = provider_token(error_type).isin(*SCHEMA_CODES) | provider_token(error_code).isin(
        *SCHEMA_CODES
    )
    return (
        F.when(kind == "output", "schema_output")
        .when(status == 429, "rate_limit")
        .when(kind == "timeout", "timeout")
        .when(kind == "connection", "connection")
        .when(status.between(500, 599), "transient_http")
        .when(status.isin(400, 422) & F.coalesce(schema, F.lit(False)), "schema_output")
        .when(http | (kind == "status"), "permanent_http")
        .otherwise("permanent_error")
    )


def is_retryable(category: Column) -> Column:
    return ~category.isin("permanent_http", "permanent_error")


def snapshot_deltas(
    snapshots: DataFrame, keys: Sequence[str], number: str, counters: Sequence[str]
) -> DataFrame:
    """Change of cumulative counters between consecutive snapshots.

    Snapshot numbers are dense, so each row also speaks for its successor: one
    aggregation on (key, number) replaces a window over a whole key.
    """
    def as_of(at: Column, real: bool, sign: int) -> Column:
        return F.struct(
            at.alias("__at"), F.lit(real).alias("__real"), *[(sign * F.col(c)).alias(f"__{c}") for c in counters]
        )

    both = F.array(as_of(F.col(number), True, 1), as_of(F.col(number) + 1, False, -1))
    return (
        snapshots.select(*keys, F.inline(both))
        .withColumnRenamed("__at", number)
        .groupBy(*keys, number)
        .agg(F.bool_or("__real").alias("__real"), *[F.sum(f"__{c}").alias(f"{c}_delta") for c in counters])
        .filter("__real")
        .drop("__real")
    )


def category_deltas(
    snapshots: DataFrame, keys: Sequence[str], number: str, category: str, total: str
) -> DataFrame:
    """Per-category change; categories without change are dropped.

    ``snapshots`` holds a cumulative total per (key, number, category); a
    category absent from a snapshot counts 0.
    """
    numbers = snapshots.select(*keys, number).distinct()
    changes = snapshot_deltas(snapshots, [*keys, category], number, [total])
    return changes.join(numbers, [*keys, number], "left_semi").filter(F.col(f"{total}_delta") != 0)

"""Tables behind an evaluation report."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docquarry.functions import quantiles, redact, text
from docquarry.functions.counts import domain_counts, for_each, is_finite, listed
from docquarry.operators.checks import GROUNDEDNESS_LABELS, RELEVANCE_LABELS

# Issue names and their severity, worst first.
ISSUES = (
    "generation error",
    "judge error",
    "failed semantic threshold",
    "not grounded",
    "partially grounded",
    "unknown groundedness",
    "low retrieval relevance",
    "unknown relevance",
)
NO_ISSUE = 99

# Nested log fields behind each reported series.
LOG_SERIES = (
    ("Total retrieval", "retrieval.latency.total_seconds"),
    ("Dense retrieval", "retrieval.latency.dense_seconds"),
    ("BM25", "retrieval.latency.bm25_seconds"),
    ("Fusion", "retrieval.latency.fusion_seconds"),
    ("Reranking", "retrieval.latency.rerank_seconds"),
    ("Generator", "llm_metrics.latency_seconds"),
    ("Relevance checker", "retrieval.retrieval_eval_latency"),
    ("Groundedness checker", "generation.groundedness_eval_latency"),
)
ANSWER_SERIES = "End-to-end answer"
JUDGE_SERIES = "Semantic judge"


def match_logs(cases: DataFrame, logs: DataFrame) -> DataFrame:
    """Each case with its log count and match: matched, missing or duplicate.

    Every log column is carried as ``log`` only when exactly one row matches.
    """
    grouped = logs.groupBy("conversation_id").agg(
        F.count("*").alias("log_rows"),
        F.any_value(F.struct(*logs.columns)).alias("log"),
    )
    joined = cases.join(grouped, "conversation_id", "left")
    rows = F.coalesce("log_rows", F.lit(0))
    return (
        joined.withColumn("log_rows", rows)
        .withColumn(
            "log_match",
            F.when(rows == 1, "matched").when(rows == 0, "missing").otherwise("duplicate"),
        )
        .withColumn("log", F.when(F.col("log_rows") == 1, F.col("log")))
    )


def diagnostic_label(value: Column, allowed: tuple[str, ...]) -> Column:
    """Longest allowed label that the normalised value equals or ends with."""
    plain = F.regexp_replace(F.lower(text.strip(value)), "[- ]", "_")
    chosen = F.lit("unknown")
    for label in sorted(allowed, key=len):
        hit = (plain == label) | plain.endswith("_" + label)
        chosen = F.when(hit, label).otherwise(chosen)
    return F.when(text.is_blank(value), "unknown").otherwise(chosen)


def case_diagnostics(matched: DataFrame, keys: list[str]) -> DataFrame:
    """Relevance and groundedness label per case; 'missing' without a single log."""
    found = F.col("log").isNotNull()
    return matched.select(
        *keys,
        F.when(found, diagnostic_label(F.col("log.retrieval.retrieval_relevance"), RELEVANCE_LABELS))
        .otherwise("missing")
        .alias("relevance"),
        F.when(found, diagnostic_label(F.col("log.generation.groundedness_label"), GROUNDEDNESS_LABELS))
        .otherwise("missing")
        .alias("groundedness"),
    )


def label_distribution(diagnostics: DataFrame, column: str, allowed: tuple[str, ...]) -> DataFrame:
    """(label, n, share) zero-filled over the labels, unknown and missing."""
    counts = domain_counts(diagnostics, F.col(column), (*allowed, "unknown", "missing"))
    total = diagnostics.agg(F.count("*")).scalar()
    return counts.select(
        "label", "n", F.coalesce(F.try_divide(F.col("n"), total), F.lit(0.0)).alias("share")
    )


def long_series(logs: DataFrame) -> DataFrame:
    """(series, value) of the recorded latencies; NULLs are skipped."""
    cells = F.array(
        *[
            F.struct(F.lit(name).alias("series"), F.col(path).cast("double").alias("value"))
            for name, path in LOG_SERIES
        ]
    )
    return logs.select(F.inline(cells)).filter(F.col("value").isNotNull())


def all_series(answers: DataFrame, logs: DataFrame, judged: DataFrame | None) -> DataFrame:
    """The ten latency series in long form."""

    def elapsed(df: DataFrame, name: str) -> DataFrame:
        return df.select(
            F.lit(name).alias("series"), F.col("elapsed_seconds").cast("double").alias("value")
        ).filter(F.col("value").isNotNull())

    series = elapsed(answers, ANSWER_SERIES).unionByName(long_series(logs))
    return series.unionByName(elapsed(judged, JUDGE_SERIES)) if judged is not None else series


def invalid_series_values(series: DataFrame) -> DataFrame:
    return series.filter(~is_finite(F.col("value")) | (F.col("value") < 0))


def series_summary(series: DataFrame, names: Sequence[str] | None = None) -> DataFrame:
    """count, mean, median, nearest-rank p95 and maximum of each named series.

    ``names``: the ten reported ones by default.  A series without values has a count of 0
    and NULL elsewhere.
    """
    every = names or (ANSWER_SERIES, *[name for name, _ in LOG_SERIES], JUDGE_SERIES)
    return for_each(listed(series.sparkSession, every, "series"), quantiles.summarise(series, ["series"], "value"), ["n"])


def token_usage(logs: DataFrame) -> DataFrame:
    tokens = F.col("llm_metrics.total_tokens")
    return logs.agg(
        F.count(tokens).alias("recorded_cases"),
        F.sum(tokens).alias("total_tokens"),
        F.avg(tokens).alias("mean_tokens"),
    )


def triage(
    answers: DataFrame, judged: DataFrame, diagnostics: DataFrame, keys: list[str]
) -> DataFrame:
    """Cases with their issues and worst severity.

    ``answers``: keys, case_ordinal, status; ``judged``: keys, judge_status,
    passed; ``diagnostics``: keys, relevance, groundedness.
    """
    joined = answers.join(judged, keys, "left").join(diagnostics, keys, "left")
    tests = (
        F.col("status") == "error",
        F.col("judge_status") == "judge_error",
        F.col("judge_status").isin("success", "generation_error") & ~F.col("passed"),
        F.col("groundedness") == "not_grounded",
        F.col("groundedness") == "partially_grounded",
        F.col("groundedness") == "unknown",
        F.col("relevance") == "low",
        F.col("relevance") == "unknown",
    )
    issues = F.array_compact(F.array(*[F.when(t, F.lit(n)) for n, t in zip(ISSUES, tests)]))
    codes = F.array_compact(F.array(*[F.when(t, F.lit(i)) for i, t in enumerate(tests)]))
    return joined.select(
        *keys,
        "case_ordinal",
        issues.alias("issues"),
        F.coalesce(F.array_min(codes), F.lit(NO_ISSUE)).alias("severity"),
    )


def attention(triaged: DataFrame) -> DataFrame:
    """Cases that need a look, worst first, then in case order."""
    return triaged.filter(F.col("severity") < NO_ISSUE).orderBy("severity", "case_ordinal")


NOT_READY = "not_ready"
READY_WITH_WARNING = "ready_with_diagnostic_warning"
READY = "ready"


def readiness(summary: DataFrame) -> DataFrame:
    """Three-way verdict over a one-row summary.

    ``summary``: is_subset, selected, succeeded, f1_available,
    semantic_selected, semantic_coverage, judge_errors, log_matched,
    log_duplicates, unknown_labels, missing_labels; NULL means not available.
    """
    complete = (
        ~F.col("is_subset")
        & (F.col("succeeded") == F.col("selected"))
        & F.col("f1_available")
        & F.col("semantic_selected").eqNullSafe(F.col("selected"))
        & F.col("semantic_coverage").eqNullSafe(F.lit(1.0))
        & F.col("judge_errors").eqNullSafe(F.lit(0).cast("long"))
        & F.col("log_matched").eqNullSafe(F.col("selected"))
        & (F.coalesce("log_duplicates", F.lit(0)) == 0)
    )
    partial = (F.col("unknown_labels") > 0) | (F.col("missing_labels") > 0)
    return summary.withColumn(
        "readiness",
        F.when(~complete, NOT_READY).when(partial, READY_WITH_WARNING).otherwise(READY),
    )


def one_row(*parts: DataFrame) -> DataFrame:
    """Put one-row aggregates side by side."""
    joined = parts[0]
    for part in parts[1:]:
        joined = joined.join(part)
    return joined


def unsafe_texts(rows: DataFrame, key: str, markers: list[str], body: str = "text") -> DataFrame:
    """(key, marker) for each forbidden marker found in a text, ignoring case."""
    return rows.select(key, F.explode(redact.mentions_any(F.col(body), markers)).alias("marker"))

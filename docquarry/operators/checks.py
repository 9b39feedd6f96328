"""Validation of checker outputs."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docquarry.functions import text

RELEVANCE_LABELS = ("high", "medium", "low")
GROUNDEDNESS_LABELS = ("grounded", "partially_grounded", "not_grounded")
# The text and the length limit of refused checks.
NO_CONTEXT = "No retrieved context was available."
ERROR_LIMIT = 500

# Weight of each rank; ranks beyond the fifth do not count.
RANK_WEIGHTS = (1.0, 0.8, 0.6, 0.4, 0.2)


@dataclass(frozen=True)
class CheckerWording:
    """The explanations of one checker's failures."""

    choice_count: str
    budget: str
    empty: str
    scores: str
    label: str
    explanation: str
    unparsed: str
    failed: str
    malformed: str


RELEVANCE = CheckerWording(
    choice_count="The relevance checker returned an invalid choice count.",
    budget="The relevance checker exhausted its completion budget.",
    empty="The relevance checker returned empty content.",
    scores="The relevance checker returned invalid context scores.",
    label="The relevance checker returned an invalid label.",
    explanation="The relevance checker returned an empty explanation.",
    unparsed="Could not validate retrieval relevance output: ",
    failed="Retrieval relevance check failed: ",
    malformed="Retrieval relevance checker returned a malformed result.",
)
GROUNDEDNESS = CheckerWording(
    choice_count="The groundedness checker returned an invalid choice count.",
    budget="The groundedness checker exhausted its completion budget.",
    empty="The groundedness checker returned empty content.",
    scores="",
    label="The groundedness checker returned an invalid label.",
    explanation="The groundedness checker returned an empty explanation.",
    unparsed="Could not validate groundedness output: ",
    failed="Groundedness check failed: ",
    malformed="Groundedness checker returned a malformed result.",
)


def _json(content: Column) -> Column:
    return F.try_parse_json(content)


def _field(parsed: Column, name: str) -> Column:
    return F.try_variant_get(parsed, f"$.{name}", "variant")


def _typed(value: Column, kind: str) -> Column:
    return F.coalesce(F.schema_of_variant(value) == kind, F.lit(False))


def _string(parsed: Column, name: str) -> Column:
    """String member of a JSON object; NULL for any other type."""
    value = _field(parsed, name)
    return F.when(_typed(value, "STRING"), F.try_variant_get(parsed, f"$.{name}", "string"))


def _scores(parsed: Column) -> Column:
    """Integer array member; NULL when any element is not an integer."""
    value = _field(parsed, "scores")
    ints = F.try_variant_get(parsed, "$.scores", "array<bigint>")
    whole = _typed(value, "ARRAY<BIGINT>") & ~F.array_contains(
        F.transform(ints, lambda x: x.isNull()), True
    )
    return F.when(whole, ints)


def rank_weighted(scores: Column) -> Column:
    """Weighted mean of half scores over the first five ranks."""
    at = [F.get(scores, F.lit(i)) for i in range(len(RANK_WEIGHTS))]
    total = sum(
        (F.coalesce(a / 2.0 * w, F.lit(0.0)) for a, w in zip(at[1:], RANK_WEIGHTS[1:])),
        at[0] / 2.0 * RANK_WEIGHTS[0],
    )
    weight = sum(
        (F.when(a.isNotNull(), w).otherwise(0.0) for a, w in zip(at[1:], RANK_WEIGHTS[1:])),
        F.lit(RANK_WEIGHTS[0]),
    )
    return total / weight


def short_error(message: Column) -> Column:
    return F.substring(text.collapse_whitespace(message), 1, ERROR_LIMIT)


def _transport_reason(say: CheckerWording) -> Column:
    """Reason that applies before the content is looked at."""
    return (
        F.when(F.col("request_error").isNotNull(), F.concat(F.lit(say.failed), short_error(F.col("request_error"))))
        .when(~F.col("choice_count").eqNullSafe(1), say.choice_count)
        .when(F.col("finish_reason") == "length", say.budget)
        .when(text.is_blank(F.col("content")), say.empty)
    )


def relevance(outputs: DataFrame) -> DataFrame:
    """Judge recorded relevance outputs.

    ``outputs``: request_error, choice_count, finish_reason, content,
    doc_count, latency.  Adds relevance_label, relevance_score,
    relevance_explanation, relevance_latency.  A request without documents is
    low with score 0 and was never sent.
    """
    say = RELEVANCE
    parsed = outputs.withColumn("__json", _json(text.strip(F.col("content"))))
    parts = parsed.select(
        *outputs.columns,
        F.col("__json").isNull().alias("__broken"),
        F.coalesce(F.schema_of_variant("__json").startswith("OBJECT"), F.lit(False)).alias("__object"),
        _scores(F.col("__json")).alias("__scores"),
        _string(F.col("__json"), "label").alias("__label"),
        _string(F.col("__json"), "explanation").alias("__text"),
    )
    in_range = F.size(F.array_except("__scores", F.array(*[F.lit(i).cast("long") for i in (0, 1, 2)]))) == 0
    good_scores = F.coalesce((F.size("__scores") == F.col("doc_count")) & in_range, F.lit(False))
    reason = (
        F.when(_transport_reason(say).isNotNull(), _transport_reason(say))
        .when(F.col("__broken"), F.lit(say.unparsed + "malformed JSON"))
        .when(~F.col("__object"), F.lit(say.failed + "not a JSON object"))
        .when(~good_scores, say.scores)
        .when(~F.coalesce(F.col("__label").isin(*RELEVANCE_LABELS), F.lit(False)), say.label)
        .when(text.is_blank(F.col("__text")), say.explanation)
    )
    judged = parts.withColumn("__reason", reason)
    none = F.col("doc_count") == 0
    valid = F.col("__reason").isNull()
    return judged.select(
        *outputs.columns,
        F.when(none, "low").when(valid, F.col("__label")).otherwise("unknown").alias("relevance_label"),
        F.when(none, 0.0).when(valid, rank_weighted(F.col("__scores"))).alias("relevance_score"),
        F.when(none, NO_CONTEXT)
        .when(valid, text.strip(F.col("__text")))
        .otherwise(F.col("__reason"))
        .alias("relevance_explanation"),
        F.when(~none, F.col("latency")).alias("relevance_latency"),
    )


def groundedness(outputs: DataFrame) -> DataFrame:
    """Judge recorded groundedness outputs; ``outputs`` carries ``context``.

    Blank context means not_grounded without a call.
    """
    say = GROUNDEDNESS
    parsed = outputs.withColumn("__json", _json(text.strip(F.col("content"))))
    parts = parsed.select(
        *outputs.columns,
        F.col("__json").isNull().alias("__broken"),
        F.coalesce(F.schema_of_variant("__json").startswith("OBJECT"), F.lit(False)).alias("__object"),
        _string(F.col("__json"), "label").alias("__label"),
        _string(F.col("__json"), "explanation").alias("__text"),
    )
    reason = (
        F.when(_transport_reason(say).isNotNull(), _transport_reason(say))
        .when(F.col("__broken"), F.lit(say.unparsed + "malformed JSON"))
        .when(~F.col("__object"), F.lit(say.failed + "not a JSON object"))
        .when(~F.coalesce(F.col("__label").isin(*GROUNDEDNESS_LABELS), F.lit(False)), say.label)
        .when(text.is_blank(F.col("__text")), say.explanation)
    )
    judged = parts.withColumn("__reason", reason)
    none = text.is_blank(F.col("context"))
    valid = F.col("__reason").isNull()
    return judged.select(
        *outputs.columns,
        F.when(none, "not_grounded").when(valid, F.col("__label")).otherwise("unknown").alias("groundedness_label"),
        F.when(none, NO_CONTEXT)
        .when(valid, text.strip(F.col("__text")))
        .otherwise(F.col("__reason"))
        .alias("groundedness_explanation"),
        F.when(~none, F.col("latency")).alias("groundedness_latency"),
    )


def guard_result(
    results: DataFrame, labels: tuple[str, ...], say: CheckerWording, *, scored: bool
) -> DataFrame:
    """Replace results of the wrong shape by 'unknown'.

    ``results``: failure, label, score, explanation, latency - all as recorded
    text.  Numbers that do not parse count as malformed.
    """
    number_ok = lambda c: F.col(c).isNull() | F.col(c).try_cast("double").isNotNull()
    good = (
        F.coalesce(F.col("label").isin(*labels, "unknown"), F.lit(False))
        & F.col("explanation").isNotNull()
        & number_ok("latency")
    )
    if scored:
        good = good & number_ok("score")
    failed = F.col("failure").isNotNull()
    usable = ~failed & good
    columns = [
        F.when(usable, F.col("label")).otherwise("unknown").alias("label"),
        F.when(usable, F.col("explanation"))
        .when(failed, F.concat(F.lit(say.failed), F.col("failure")))
        .otherwise(F.lit(say.malformed))
        .alias("explanation"),
        F.when(usable, F.col("latency").try_cast("double")).alias("latency"),
    ]
    if scored:
        columns.insert(1, F.when(usable, F.col("score").try_cast("double")).alias("score"))
    rest = [c for c in results.columns if c not in ("failure", "label", "score", "explanation", "latency")]
    return results.select(*rest, *columns)

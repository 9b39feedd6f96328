"""Token F1 of answers against several references."""

from __future__ import annotations

import string
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docquarry.functions import multiset, text
from docquarry.functions.digest import sha256_list

ANSWER_TYPES = ("extractive", "abstractive", "boolean", "none")

# Fixed values of the metric.
ABSTENTION = "The document does not contain this information."
UNANSWERABLE = "Unanswerable"
NO_EVIDENCE = "No gold evidence was supplied."


def answer_tokens(answer: Column) -> Column:
    """Lower-case tokens without ASCII punctuation and articles."""
    bare = F.translate(F.lower(answer), string.punctuation, "")
    return text.tokens(F.regexp_replace(bare, r"(?U)\b(?:a|an|the)\b", " "))


def normalise_answer(answer: Column) -> Column:
    """The tokens of an answer, separated by single spaces."""
    return F.array_join(answer_tokens(answer), " ")


def canonical_prediction(prediction: Column) -> Column:
    abstains = F.contains(F.lower(prediction), F.lit(ABSTENTION.lower()))
    return F.when(abstains, UNANSWERABLE).otherwise(F.coalesce(prediction, F.lit("")))


# --- gold annotations -----------------------------------------------------------


def gold_answer(annotation: Column) -> Column:
    """Reference text; NULL when the annotation holds no valid answer."""
    return (
        F.when(annotation["unanswerable"], UNANSWERABLE)
        .when(F.size(annotation["extractive_spans"]) > 0, F.array_join(annotation["extractive_spans"], ", "))
        .when(annotation["free_form_answer"] != "", annotation["free_form_answer"])
        .when(annotation["yes_no"], "Yes")
        .when(~annotation["yes_no"], "No")
    )


def gold_type(annotation: Column) -> Column:
    return (
        F.when(annotation["unanswerable"], "none")
        .when(F.size(annotation["extractive_spans"]) > 0, "extractive")
        .when(annotation["free_form_answer"] != "", "abstractive")
        .when(annotation["yes_no"].isNotNull(), "boolean")
    )


def evidence(annotation: Column) -> Column:
    """Non-blank highlighted evidence, else non-blank evidence, else none."""

    def usable(name: str) -> Column:
        return F.filter(annotation[name], lambda x: ~text.is_blank(x))

    marked, plain = usable("highlighted_evidence"), usable("evidence")
    nothing = F.array().cast("array<string>")
    values = F.when(F.size(marked) > 0, marked).when(F.size(plain) > 0, plain).otherwise(nothing)
    source = (
        F.when(F.size(marked) > 0, "highlighted_evidence")
        .when(F.size(plain) > 0, "evidence")
        .otherwise("none")
    )
    return F.struct(
        source.alias("source"), values.alias("ordered_values"), sha256_list(values).alias("sha256")
    )


def references(cases: DataFrame, keys: Sequence[str], bundle: str = "gold_answers") -> DataFrame:
    """One row per annotation of a gold bundle, in annotation order."""
    zipped = F.arrays_zip(
        F.col(f"{bundle}.answer").alias("annotation"),
        F.col(f"{bundle}.annotation_id").alias("annotation_id"),
        F.col(f"{bundle}.worker_id").alias("worker_id"),
    )
    return cases.select(*keys, F.posexplode(zipped).alias("annotation_index", "__a")).select(
        *keys,
        "annotation_index",
        F.col("__a.annotation_id").alias("annotation_id"),
        F.col("__a.worker_id").alias("worker_id"),
        gold_answer(F.col("__a.annotation")).alias("answer"),
        gold_type(F.col("__a.annotation")).alias("answer_type"),
        evidence(F.col("__a.annotation")).alias("evidence"),
    )


def expected_output(answer_type: Column, answer: Column, shown: Column) -> Column:
    """Reference and its evidence as the text a judge sees."""
    listed = F.size(shown["ordered_values"]) > 0
    return F.concat_ws(
        "\n",
        F.concat(F.lit("Answer type: "), answer_type),
        F.concat(F.lit("Reference answer: "), answer),
        F.concat(F.lit("Gold evidence source: "), shown["source"]),
        F.when(listed, "Gold evidence (ordered JSON array):"),
        F.when(listed, F.to_json(shown["ordered_values"])).otherwise(f"Gold evidence: {NO_EVIDENCE}"),
    )


# --- scoring --------------------------------------------------------------------


def _with_occurrences(df: DataFrame, column: str, name: str) -> DataFrame:
    """Normalised tokens of a text, each occurrence made distinct."""
    counted = multiset.with_token_counts(df, answer_tokens(F.col(column)), "__counts")
    return counted.withColumn(name, multiset.numbered(F.col("__counts"))).drop("__counts")


def score_references(
    cases: DataFrame, refs: DataFrame, keys: Sequence[str]
) -> DataFrame:
    """F1 of each reference.

    ``cases``: keys, status, prediction; ``refs``: keys, annotation_index,
    answer, answer_type.  Token multisets are built inside each row, so the
    only exchange brings prediction and references of a case together; work is
    linear in the text length.  Without a usable prediction every reference
    scores 0.
    """
    keys = list(keys)
    usable = cases.filter(
        (F.col("status") == "success") & ~text.is_blank(F.col("prediction"))
    ).select(*keys, canonical_prediction(F.col("prediction")).alias("__prediction"))
    said = _with_occurrences(usable, "__prediction", "__said").drop("__prediction")
    wanted = _with_occurrences(refs, "answer", "__wanted")
    common = F.coalesce(multiset.overlap(F.col("__wanted"), F.col("__said")), F.lit(0))
    paired = (
        wanted.join(said, keys, "left")
        .withColumn("__common", common)
        .withColumn("__p", F.try_divide("__common", F.size("__said")))
        .withColumn("__r", F.try_divide("__common", F.size("__wanted")))
    )
    p, r = F.col("__p"), F.col("__r")
    return paired.select(
        *refs.columns,
        F.when(F.col("__common") > 0, F.lit(2) * p * r / (p + r)).otherwise(0.0).alias("f1"),
    )


def best_reference(scored: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Highest F1 per case; the first annotation wins ties."""
    best = F.max_by(
        F.struct("annotation_index", "answer", "answer_type", "f1"),
        F.struct(F.col("f1"), -F.col("annotation_index")),
    )
    return scored.groupBy(*keys).agg(best.alias("__b")).select(
        *keys,
        F.col("__b.annotation_index").alias("annotation_index"),
        F.col("__b.answer").alias("best_reference"),
        F.col("__b.answer_type").alias("matched_answer_type"),
        F.col("__b.f1").alias("answer_f1"),
    )


def run_metrics(best: DataFrame, cases: DataFrame, keys: Sequence[str]) -> DataFrame:
    """One row: mean F1, its percentage, means by matched type and counts."""
    by_type = [
        F.coalesce(
            F.avg(F.when(F.col("matched_answer_type") == t, F.col("answer_f1"))), F.lit(0.0)
        ).alias(f"f1_{t}")
        for t in ANSWER_TYPES
    ]
    return best.join(cases.select(*keys, "status"), list(keys)).agg(
        F.avg("answer_f1").alias("answer_f1"),
        (F.avg("answer_f1") * 100).alias("answer_f1_percentage"),
        *by_type,
        F.count("*").alias("evaluated_cases"),
        F.count_if(F.col("status") == "success").alias("successful_predictions"),
        F.count_if(F.col("status") == "error").alias("generation_errors"),
    )

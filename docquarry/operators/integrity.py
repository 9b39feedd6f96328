"""Integrity rules.  Every function returns (rule, key) rows; none means valid."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docquarry.functions import digest, text
from docquarry.functions.counts import is_finite
from docquarry.operators import answer_f1, semantic
from docquarry.operators.dataset import QUESTION_FIELDS
from docquarry.operators.ingest import CHUNK_METADATA

ANSWER_STATUSES = ("success", "error")
SCORE_STATUSES = ("success", "generation_error", "judge_error")
RETRY_DECISIONS = ("not_retryable", "retries_exhausted")


def broken_rules(df: DataFrame, key: Column, rules: Mapping[str, Column]) -> DataFrame:
    """One row per rule a row breaks; a rule that evaluates to NULL is not broken."""
    found = F.array_compact(
        F.array(*[F.when(F.coalesce(bad, F.lit(False)), F.lit(name)) for name, bad in rules.items()])
    )
    return df.select(key.alias("key"), F.explode(found).alias("rule")).select("rule", "key")


def case_key(prefix: str = "") -> Column:
    return F.concat_ws("/", F.col(f"{prefix}paper_id"), F.col(f"{prefix}question_id"))


def repeated_keys(df: DataFrame, keys: Sequence[str], rule: str) -> DataFrame:
    return (
        df.groupBy(*keys)
        .agg(F.count("*").alias("__n"))
        .filter(F.col("__n") > 1)
        .select(F.lit(rule).alias("rule"), F.concat_ws("/", *[F.col(k).cast("string") for k in keys]).alias("key"))
    )


def missing_keys(left: DataFrame, right: DataFrame, keys: Sequence[str], rule: str) -> DataFrame:
    """Keys of ``left`` that ``right`` lacks."""
    return (
        left.select(*keys)
        .distinct()
        .join(right.select(*keys), list(keys), "left_anti")
        .select(F.lit(rule).alias("rule"), F.concat_ws("/", *[F.col(k).cast("string") for k in keys]).alias("key"))
    )


def metric_differences(
    recorded: DataFrame, recomputed: DataFrame, tolerance: float, rule: str = "metric_differs"
) -> DataFrame:
    """Names whose values differ; both sides are (name, value), NULL equals NULL."""
    a, b = F.col("value"), F.col("__again")
    both = recorded.join(recomputed.select("name", _again("value")), "name", "full_outer")
    same = (a.isNull() & b.isNull()) | F.coalesce(F.abs(a - b) <= tolerance, F.lit(False))
    return both.filter(~same).select(F.lit(rule).alias("rule"), F.col("name").alias("key"))


def _again(name: str) -> Column:
    return F.col(name).alias("__again")


def as_metrics(row: DataFrame) -> DataFrame:
    """One-row aggregate as (name, value)."""
    cells = [
        F.struct(F.lit(c).alias("name"), F.col(c).cast("double").alias("value")) for c in row.columns
    ]
    return row.select(F.inline(F.array(*cells)))


# --- record rules ----------------------------------------------------------------


def answer_records(records: DataFrame) -> DataFrame:
    """Answer attempts (V1)."""
    blank = lambda c: text.is_blank(F.col(c))
    elapsed = F.col("elapsed_seconds")
    return broken_rules(
        records,
        F.col("line_no").cast("string"),
        {
            **{f"blank_{c}": blank(c) for c in ("paper_id", "question_id", "question", "conversation_id")},
            "invalid_status": ~F.coalesce(F.col("status").isin(*ANSWER_STATUSES), F.lit(False)),
            "success_without_answer": (F.col("status") == "success") & blank("cleaned_answer"),
            "invalid_elapsed_seconds": ~is_finite(elapsed) | (elapsed < 0),
        },
    )


def gold_bundles(cases: DataFrame, bundle: str = "gold_answers") -> DataFrame:
    """Alignment and answer form of gold annotations (V2)."""
    size = lambda f: F.size(F.col(f"{bundle}.{f}"))
    shape = broken_rules(
        cases,
        case_key(),
        {
            "no_annotations": F.coalesce(size("answer"), F.lit(0)) <= 0,
            "misaligned_annotations": ~(
                size("answer").eqNullSafe(size("annotation_id"))
                & size("answer").eqNullSafe(size("worker_id"))
            ),
        },
    )
    refs = answer_f1.references(cases, ["paper_id", "question_id"], bundle)
    rows = broken_rules(
        refs,
        F.concat_ws("/", "paper_id", "question_id", F.col("annotation_index").cast("string")),
        {
            "no_valid_answer": F.col("answer").isNull(),
            "blank_annotation_id": F.coalesce(F.col("annotation_id"), F.lit("")) == "",
            "blank_worker_id": F.coalesce(F.col("worker_id"), F.lit("")) == "",
        },
    )
    return shape.unionByName(rows)


def papers(rows: DataFrame) -> DataFrame:
    """Saved papers and their parallel question arrays (G3), with the bundles' own rules.

    ``rows``: paper_ordinal, id, qas.  A paper is named by its id, or by its ordinal where that is blank;
    a question by paper and index, or by its case key where that is repeated.
    """
    named = rows.withColumn("__blank", text.is_blank(F.col("id"))).withColumn(
        "__name", F.when(F.col("__blank"), F.col("paper_ordinal").cast("string")).otherwise(F.col("id"))
    )
    count = F.size("qas.question")
    lacking = {f"missing_{f}": F.col("qas").isNotNull() & F.col(f"qas.{f}").isNull() for f in QUESTION_FIELDS}
    uneven = {
        f"misaligned_{f}": F.col(f"qas.{f}").isNotNull() & (F.size(f"qas.{f}") != count)
        for f in QUESTION_FIELDS
        if f != "question"
    }
    whole = broken_rules(
        named,
        F.col("__name"),
        {"invalid_paper_id": F.col("__blank"), "missing_qas": F.col("qas").isNull(), **lacking, **uneven},
    )
    # Up to the number of questions, which the other arrays may fall short of.
    asked = named.select(
        "__name", "__blank", "qas", F.posexplode("qas.question").alias("__i", "question")
    ).select(
        "__name",
        "__blank",
        "__i",
        "question",
        F.get("qas.question_id", F.col("__i")).alias("question_id"),
        F.get("qas.answers", F.col("__i")).alias("gold_answers"),
        # Rules of a question presume that its array reaches it.
        (F.size("qas.question_id") > F.col("__i")).alias("__named"),
        (F.size("qas.answers") > F.col("__i")).alias("__answered"),
    )
    questions = broken_rules(
        asked,
        F.concat_ws("/", "__name", F.col("__i").cast("string")),
        {
            "invalid_question": text.is_blank(F.col("question")),
            "invalid_question_id": F.col("__named") & text.is_blank(F.col("question_id")),
        },
    )
    cases = asked.filter(~F.col("__blank") & ~text.is_blank(F.col("question_id"))).withColumnRenamed("__name", "paper_id")
    return (
        whole.unionByName(questions)
        .unionByName(repeated_keys(named.filter(~F.col("__blank")), ["id"], "repeated_paper_id"))
        .unionByName(repeated_keys(cases, ["paper_id", "question_id"], "repeated_case"))
        .unionByName(gold_bundles(cases.filter("__answered")))
    )


def require(found: DataFrame, what: str, shown: int = 20) -> None:
    """Raises ValueError that lists the first broken rules, if there are any."""
    first = found.orderBy("rule", "key").limit(shown).collect()
    if first:
        raise ValueError(f"{what}: " + "; ".join(f"{r['rule']} {r['key']}" for r in first))


def transport(rows: DataFrame, key: Column) -> DataFrame:
    """Ranges and sums of transport telemetry (V3); flat counter columns and status."""
    c = F.col
    rules: dict[str, Column] = {}
    for f in semantic.COUNT_FIELDS:
        rules[f"invalid_{f}"] = c(f).isNull() | (c(f) < 0)
    for f in semantic.SECONDS_FIELDS:
        rules[f"invalid_{f}"] = ~is_finite(c(f)) | (c(f) < 0)
    any_count = F.lit(False)
    for f in semantic.COUNT_FIELDS:
        any_count = any_count | (c(f) != 0)
    other = (
        (c("pacing_sleep_seconds") != 0)
        | (c("retry_backoff_sleep_seconds") != 0)
        | c("retry_after_used")
        | c("final_provider_error_category").isNotNull()
    )
    name_bad = lambda f: c(f).isNotNull() & ~F.rlike(c(f), F.lit(r"^[a-z0-9_]+\z"))
    generation_error = c("status") == "generation_error"
    rules |= {
        "invalid_retry_after_used": c("retry_after_used").isNull(),
        "blank_error_category": c("final_provider_error_category").isNotNull()
        & text.is_blank(c("final_provider_error_category")),
        "invalid_http_status": c("final_http_status") < 100,
        "invalid_error_type": name_bad("final_provider_error_type"),
        "invalid_error_code": name_bad("final_provider_error_code"),
        "invalid_retry_decision": ~c("final_retry_decision").isin(*RETRY_DECISIONS),
        "retries_exceed_attempts": c("retry_count") > c("provider_attempt_count"),
        "rate_limit_retries_exceed_responses": c("rate_limit_retry_count")
        > c("rate_limit_response_count"),
        "retry_after_without_rate_limit_retry": c("retry_after_used")
        & (c("rate_limit_retry_count") == 0),
        "retry_categories_do_not_add_up": c("rate_limit_retry_count")
        + c("other_transient_retry_count")
        + c("schema_output_retry_count")
        != c("retry_count"),
        "generation_error_with_attempts": generation_error & any_count,
        "generation_error_with_telemetry": generation_error & other,
    }
    return broken_rules(rows, key, rules)


def reference_evaluations(
    scores: DataFrame, references: DataFrame, evaluations: DataFrame, threshold: float
) -> DataFrame:
    """Recorded case scores against their reference evaluations (V4).

    ``scores``: case keys, generation_status and the recorded result columns of
    :func:`semantic.resolve_cases` plus transport columns; ``references``: case
    keys, reference_index, annotation_id, answer_type, reference_answer;
    ``evaluations``: the same plus status, semantic_score, passed,
    judge_reason, error_type, error_message and transport columns.
    """
    keys = ["paper_id", "question_id"]
    identity = ["annotation_id", "answer_type", "reference_answer"]
    judged = scores.filter(F.col("generation_status") == "success").select(*keys)
    expected = references.join(judged, keys, "left_semi").select(
        *keys, "reference_index", F.struct(*identity).alias("__ref")
    )
    actual = evaluations.select(
        *keys,
        "reference_index",
        F.struct(*identity).alias("__eval"),
        F.struct("status", "semantic_score", "passed", "judge_reason", "error_type").alias("e"),
    )
    aligned = expected.join(actual, [*keys, "reference_index"], "full_outer")
    ok, failed = F.col("e.status") == "success", F.col("e.status") == "judge_error"
    score = F.col("e.semantic_score")
    per_reference = broken_rules(
        aligned,
        F.concat_ws("/", *keys, F.col("reference_index").cast("string")),
        {
            "missing_evaluation": F.col("__eval").isNull(),
            "unexpected_evaluation": F.col("__ref").isNull(),
            "misaligned_evaluation": F.col("__ref") != F.col("__eval"),
            "invalid_status": F.col("__eval").isNotNull()
            & ~F.coalesce(F.col("e.status").isin("success", "judge_error"), F.lit(False)),
            "invalid_score": ok & ~F.coalesce(is_finite(score) & score.between(0.0, 1.0), F.lit(False)),
            "wrong_pass_flag": ok & ~F.col("e.passed").eqNullSafe(score >= threshold),
            "success_without_reason": ok & F.col("e.judge_reason").isNull(),
            "success_with_error": ok & F.col("e.error_type").isNotNull(),
            "failure_with_result": failed
            & (score.isNotNull() | F.col("e.passed").isNotNull() | F.col("e.judge_reason").isNotNull()),
            "failure_without_error": failed & F.col("e.error_type").isNull(),
        },
    )
    again = semantic.resolve_cases(scores.select(*keys, "generation_status"), evaluations, keys, threshold)
    compared = ["status", "semantic_score", "passed", "judge_reason", *[f"matched_{f}" for f in (
        "reference_index", "annotation_id", "reference", "answer_type")]]
    sums = semantic.case_transport(evaluations, keys)
    joined = (
        scores.alias("s")
        .join(again.select(*keys, F.struct(*compared).alias("again")), keys)
        .join(sums.select(*keys, F.struct(*[c for c in sums.columns if c not in keys]).alias("sums")), keys, "left")
    )
    live = F.col("generation_status") == "success"
    rules = {f"wrong_{c}": ~F.col(c).eqNullSafe(F.col(f"again.{c}")) for c in compared}
    for f in (*semantic.COUNT_FIELDS, "retry_after_used", *semantic.ERROR_FIELDS):
        rules[f"unreconciled_{f}"] = live & ~F.col(f).eqNullSafe(F.col(f"sums.{f}"))
    for f in semantic.SECONDS_FIELDS:
        rules[f"unreconciled_{f}"] = live & ~F.coalesce(
            F.abs(F.col(f) - F.col(f"sums.{f}")) <= 1e-6, F.lit(False)
        )
    return per_reference.unionByName(broken_rules(joined, case_key(), rules))


def judge_attempts(attempts: DataFrame, model: str, version: str) -> DataFrame:
    """Identity and numbering of judge score rows (V5)."""
    c = F.col
    expected = digest.resume_key(c("paper_id"), c("question_id"), c("judge_model"), c("evaluator_version"))
    rows = broken_rules(
        attempts,
        c("line_no").cast("string"),
        {
            "wrong_resume_key": ~c("resume_key").eqNullSafe(expected),
            "other_judge_model": ~c("judge_model").eqNullSafe(model),
            "other_evaluator_version": ~c("evaluator_version").eqNullSafe(version),
            "invalid_status": ~F.coalesce(c("status").isin(*SCORE_STATUSES), F.lit(False)),
            "invalid_attempt_number": ~F.coalesce(c("attempt_number") >= 1, F.lit(False)),
        },
    )
    repeated = repeated_keys(
        attempts, ["paper_id", "question_id", "attempt_number"], "repeated_attempt_number"
    )
    return rows.unionByName(repeated)


def f1_artifacts(
    answers: DataFrame, scores: DataFrame, recorded: DataFrame, tolerance: float = 1e-12
) -> DataFrame:
    """F1 score rows against answers, and recorded metrics against rows (V6).

    ``answers``: keys, question, status, case_ordinal; ``scores``: keys,
    question, answer_f1, matched_answer_type, score_ordinal; ``recorded``:
    (name, value) as :func:`as_metrics` of :func:`answer_f1.run_metrics`.
    """
    keys = ["paper_id", "question_id"]
    joined = scores.withColumnRenamed("question", "__asked").join(answers, keys)
    value = F.col("answer_f1")
    rows = broken_rules(
        joined,
        case_key(),
        {
            "question_changed": ~F.col("__asked").eqNullSafe(F.col("question")),
            "out_of_order": F.col("score_ordinal") != F.col("case_ordinal"),
            "f1_out_of_range": ~F.coalesce(is_finite(value) & value.between(0.0, 1.0), F.lit(False)),
            "invalid_answer_type": ~F.coalesce(
                F.col("matched_answer_type").isin(*answer_f1.ANSWER_TYPES), F.lit(False)
            ),
            "error_with_score": (F.col("status") == "error") & (value != 0.0),
        },
    )
    again = as_metrics(
        answer_f1.run_metrics(scores.select(*keys, "answer_f1", "matched_answer_type"), answers, keys)
    )
    return (
        rows.unionByName(missing_keys(answers, scores, keys, "missing_score"))
        .unionByName(missing_keys(scores, answers, keys, "unexpected_score"))
        .unionByName(repeated_keys(scores, keys, "repeated_score"))
        .unionByName(metric_differences(recorded, again, tolerance))
    )


def semantic_artifacts(
    selected: DataFrame,
    judged: DataFrame,
    recorded: DataFrame,
    threshold: float,
    tolerance: float = 1e-12,
    *,
    subset: bool = False,
    transport_reliability: tuple[DataFrame, DataFrame, DataFrame] | None = None,
) -> DataFrame:
    """Semantic score rows and the recorded run metrics recomputed (V7).

    ``recorded``: (name, value) of the run metrics, with ``band:<name>`` counts.
    ``transport_reliability``: the arguments of :func:`reliability`, for runs that record it.
    """
    keys = ["paper_id", "question_id"]
    joined = judged.drop("generation_status").join(selected.select(*keys, "generation_status"), keys)
    c = F.col
    score = c("semantic_score")
    in_range = F.coalesce(is_finite(score) & score.between(0.0, 1.0), F.lit(False))
    rows = broken_rules(
        joined,
        case_key(),
        {
            "invalid_status": ~F.coalesce(c("status").isin(*SCORE_STATUSES), F.lit(False)),
            "score_out_of_range": (c("status") != "judge_error") & ~in_range,
            "wrong_pass_flag": (c("status") == "success") & ~c("passed").eqNullSafe(score >= threshold),
            "judged_generation_error": (c("status") != "generation_error")
            & (c("generation_status") != "success"),
            "generation_error_of_success": (c("status") == "generation_error")
            & (c("generation_status") == "success"),
            "scored_generation_error": (c("status") == "generation_error")
            & ((score != 0.0) | c("passed")),
            "scored_judge_error": (c("status") == "judge_error")
            & (score.isNotNull() | c("passed").isNotNull()),
        },
    )
    again = as_metrics(semantic.run_metrics(selected, judged, keys, subset=subset)).unionByName(
        semantic.band_counts(judged).select(
            F.concat(F.lit("band:"), c("band")).alias("name"), c("n").cast("double").alias("value")
        )
    )
    found = (
        rows.unionByName(missing_keys(selected, judged, keys, "missing_score"))
        .unionByName(missing_keys(judged, selected, keys, "unexpected_score"))
        .unionByName(repeated_keys(judged, keys, "repeated_score"))
        .unionByName(metric_differences(recorded, again, tolerance))
    )
    return found if transport_reliability is None else found.unionByName(reliability(*transport_reliability))


def reliability(recorded: DataFrame, deciding: DataFrame, attempts: DataFrame) -> DataFrame:
    """Recorded transport reliability, (name, value), against the attempts (V7).

    ``deciding``: the attempt that each case is decided by; ``attempts``: all of them.  Counts have to be
    equal, seconds within a millionth.
    """
    again = as_metrics(semantic.reliability(deciding, attempts))
    seconds = F.col("name").isin(*[f"total_{c}" for c in semantic.SECONDS_FIELDS])
    rule = "reliability_differs"
    return metric_differences(recorded.filter(seconds), again.filter(seconds), 1e-6, rule).unionByName(
        metric_differences(recorded.filter(~seconds), again.filter(~seconds), 0.0, rule)
    )


def generation_manifest(
    answers: DataFrame, recorded: DataFrame, subset_digest: DataFrame | None = None
) -> DataFrame:
    """Recorded generation counts and subset digest against the answers (V8).

    ``recorded``: (name, value) of selected_questions, successful and failed;
    ``subset_digest``: recorded_digest and recomputed_digest of a subset run.
    """
    keys = ["paper_id", "question_id"]
    counts = answers.agg(
        F.count("*").alias("selected_questions"),
        F.count_if(F.col("status") == "success").alias("successful"),
        F.count_if(F.col("status") != "success").alias("failed"),
    )
    found = metric_differences(recorded, as_metrics(counts), 0.0, "count_differs").unionByName(
        repeated_keys(answers, keys, "repeated_case")
    )
    if subset_digest is None:
        return found
    differs = ~F.col("recorded_digest").eqNullSafe(F.col("recomputed_digest"))
    return found.unionByName(
        broken_rules(subset_digest, F.lit("case_selection"), {"subset_digest_differs": differs})
    )


def comparison_inputs(inputs: DataFrame) -> DataFrame:
    """Stored checker inputs against their digests (V9)."""
    c = F.col
    live = c("status") == "success"
    contexts = digest.sha256_fields(
        relevance=c("relevance_checker_context"), groundedness=c("checker_context")
    )
    return broken_rules(
        inputs,
        case_key(),
        {
            "invalid_status": ~F.coalesce(c("status").isin("success", "input_error"), F.lit(False)),
            "context_digest_differs": live & ~c("context_digest").eqNullSafe(contexts),
            "answer_digest_differs": live
            & ~c("answer_digest").eqNullSafe(digest.sha256_text(c("generated_answer"))),
        },
    )


def comparison_results(results: DataFrame, inputs: DataFrame, models: Sequence[str]) -> DataFrame:
    """Checker results against the inputs of their run (V9)."""
    keys = ["paper_id", "question_id"]
    joined = results.join(
        inputs.select(
            *keys,
            F.lit(True).alias("__known"),
            F.col("context_digest").alias("__context"),
            F.col("answer_digest").alias("__answer"),
        ),
        keys,
        "left",
    )
    c = F.col
    known = c("__known").isNotNull()
    return broken_rules(
        joined,
        F.concat_ws("/", *keys, "model_id"),
        {
            "unknown_case": ~known,
            "unknown_model": ~F.coalesce(c("model_id").isin(*models), F.lit(False)),
            "invalid_status": ~F.coalesce(
                c("status").isin("success", "error", "input_error"), F.lit(False)
            ),
            "context_digest_differs": known & ~c("context_digest").eqNullSafe(c("__context")),
            "answer_digest_differs": known & ~c("answer_digest").eqNullSafe(c("__answer")),
        },
    )


def history_binding(judged_references: DataFrame, generation_references: DataFrame) -> DataFrame:
    """Judged references and evidence against the generation's (V10).

    Both sides: case keys, annotation_index, annotation_id, answer,
    answer_type, evidence_sha256; the judged side also attempt_number.
    """
    on = ["paper_id", "question_id", "annotation_index"]
    facts = ["annotation_id", "answer", "answer_type"]
    truth = generation_references.select(
        *on, F.struct(*facts).alias("__facts"), F.col("evidence_sha256").alias("__evidence")
    )
    joined = judged_references.join(truth, on, "left")
    known = F.col("__facts").isNotNull()
    return broken_rules(
        joined,
        F.concat_ws("/", *[F.col(k).cast("string") for k in [*on, "attempt_number"]]),
        {
            "unknown_reference": ~known,
            "reference_differs": known & ~F.struct(*facts).eqNullSafe(F.col("__facts")),
            "evidence_differs": known
            & ~F.col("evidence_sha256").eqNullSafe(F.col("__evidence")),
        },
    )


def is_absolute_path(value: Column) -> Column:
    return F.coalesce(F.rlike(value, F.lit(r"^(?:/|[A-Za-z]:[\\/]|\\\\[^\\/]+[\\/][^\\/]+)")), F.lit(False))


def portable_documents(documents: DataFrame, fields: Sequence[str]) -> DataFrame:
    """Stored passages: no absolute path, text rebuilds from its parts (V11)."""
    rebuilt = text.structured_text(
        F.col("page_content"), F.col("source_name"), F.col("section_header"), F.col("page"), F.col("doc_type")
    )
    rules = {f"absolute_{f}": is_absolute_path(F.col(f)) for f in fields}
    rules["text_differs"] = ~F.col("structured_text").eqNullSafe(rebuilt)
    return broken_rules(documents, F.col("chunk_id"), rules)


def portable_metadata(documents: DataFrame, metadata: str = "metadata", key: str = "chunk_id") -> DataFrame:
    """Stored metadata, JSON text: an object of listed fields with scalar values and no absolute path (V11).

    ``filename`` is a bare name.  Other rules are not looked at for what is no object.
    """
    value = F.try_parse_json(F.col(metadata))
    kind = F.schema_of_variant(value)
    is_object = F.coalesce(kind.startswith("OBJECT"), F.lit(False))
    read = documents.select(
        F.col(key).alias("__key"),
        is_object.alias("__object"),
        F.when(is_object, F.json_object_keys(metadata)).alias("__fields"),
        F.when(is_object, value).alias("__value"),
    )

    def field(name: str, kind: str) -> Column:
        return F.try_variant_get("__value", f"$.{name}", kind)

    rules = {
        "not_an_object": ~F.col("__object"),
        "foreign_field": F.size(F.array_except("__fields", F.array(*[F.lit(f) for f in CHUNK_METADATA]))) > 0,
        "filename_with_folder": F.rlike(field("filename", "string"), F.lit(r"[/\\]")),
    }
    for name in CHUNK_METADATA:
        rules[f"non_scalar_{name}"] = F.rlike(
            F.schema_of_variant(field(name, "variant")), F.lit("^(OBJECT|ARRAY)<")
        )
        if name != "filename":
            rules[f"absolute_{name}"] = is_absolute_path(field(name, "string"))
    return broken_rules(read, F.col("__key"), rules)


def base_completeness(
    bases: DataFrame, documents: DataFrame, chunks: DataFrame, vectors: DataFrame, postings: DataFrame
) -> DataFrame:
    """Knowledge bases that lack one of their tables (V12).

    A table is cut to its bases before it is compared; the rows of a large base do not move.
    """
    found = None
    for rule, part in (
        ("no_documents", documents),
        ("no_chunks", chunks),
        ("no_vectors", vectors),
        ("no_postings", postings),
    ):
        lacking = missing_keys(bases, part.select("kb_id").distinct(), ["kb_id"], rule)
        found = lacking if found is None else found.unionByName(lacking)
    return found


def accounting(recorded: DataFrame, recomputed: DataFrame) -> DataFrame:
    """Recorded checker counts against :func:`telemetry.availability` (V12)."""
    name = F.concat_ws("|", "role", "measure").alias("name")
    value = F.col("n").cast("double").alias("value")
    return metric_differences(
        recorded.select(name, value), recomputed.select(name, value), 0.0, "accounting_differs"
    )


# Where a field of the run summary comes from: the stage and its metric.
SUMMARY_SOURCES = {
    "selected": ("answer_f1", "evaluated_cases"),
    "succeeded": ("answer_f1", "successful_predictions"),
    "answer_f1": ("answer_f1", "answer_f1"),
    "semantic_selected": ("semantic", "selected_case_count"),
    "semantic_coverage": ("semantic", "evaluation_coverage"),
    "judge_errors": ("semantic", "judge_error_count"),
}


def summary_metrics(
    summary: DataFrame,
    stages: Mapping[str, DataFrame],
    sources: Mapping[str, tuple[str, str]] = SUMMARY_SOURCES,
    tolerance: float = 1e-6,
) -> DataFrame:
    """Fields of the one-row run summary against the metrics of its stages (V12).

    ``stages``: one-row metrics by stage; fields of stages that are not given are not checked.
    """
    fields = {f: source for f, source in sources.items() if source[0] in stages}
    again = None
    for stage, metrics in stages.items():
        own = {f: m for f, (of, m) in fields.items() if of == stage}
        if own:
            rows = as_metrics(metrics.select(*[F.col(m).alias(f) for f, m in own.items()]))
            again = rows if again is None else again.unionByName(rows)
    return metric_differences(as_metrics(summary.select(*fields)), again, tolerance, "summary_differs")

"""Integrity rules over derived records with damaged rows among them."""

from __future__ import annotations

from pyspark.sql import functions as F

from docquarry.functions import digest, text
from docquarry.operators import answer_f1, index, integrity, report, semantic, telemetry
from workload import evaluation as ev
from workload.logs import EVENT_LOGS_SQL, event_logs, _AVAILABILITY
from workload.retrieval import tok_ctes, CHUNKS_BY_LANG
from workload.tables import Registry, derive, plain, table

R = Registry()
KEYS = ev.KEYS
KEY_SQL = "concat(paper_id, '/', question_id)"


def rules_sql(source: str, key: str, rules: dict[str, str]) -> str:
    return " UNION ALL ".join(
        f"SELECT '{name}' AS rule, {key} AS key FROM {source} WHERE {bad}" for name, bad in rules.items()
    )


# --- V1 -------------------------------------------------------------------------------

_RECORDS = """
SELECT event_id AS line_no, CASE event_id % 41 WHEN 1 THEN ' ' ELSE 'p' END AS paper_id, CASE event_id % 43 WHEN 1 THEN NULL ELSE 'q' END AS question_id,
  props AS question, CASE event_id % 47 WHEN 2 THEN '' ELSE 'c' END AS conversation_id,
  CASE event_type WHEN 'view' THEN 'success' WHEN 'click' THEN 'success' WHEN 'signup' THEN CASE WHEN event_id % 5 = 0 THEN 'done' ELSE 'error' END ELSE 'error' END AS status,
  CASE event_id % 19 WHEN 3 THEN NULL WHEN 4 THEN ' ' ELSE 'answer' END AS cleaned_answer,
  CASE event_id % 53 WHEN 5 THEN -value WHEN 6 THEN NULL WHEN 7 THEN CAST('NaN' AS DOUBLE) ELSE value END AS elapsed_seconds FROM {events}"""


@R.add(
    "answer_record_rules",
    rules_sql(
        f"({plain(_RECORDS)})",
        "CAST(line_no AS STRING)",
        {
            "blank_paper_id": "coalesce(trim(paper_id), '') = ''",
            "blank_question_id": "question_id IS NULL",
            "blank_conversation_id": "conversation_id = ''",
            "invalid_status": "status = 'done'",
            "success_without_answer": "status = 'success' AND coalesce(trim(cleaned_answer), '') = ''",
            "invalid_elapsed_seconds": "elapsed_seconds IS NULL OR isnan(elapsed_seconds) OR elapsed_seconds < 0",
        },
    ),
)
def answer_record_rules(spark, sf):
    return integrity.answer_records(derive(spark, sf, _RECORDS))


# --- V2: annotations of form 6 hold no answer -------------------------------------------


@R.add(
    "gold_bundle_rules",
    f"""WITH {ev._REF_SQL} SELECT 'no_valid_answer' AS rule, concat({KEY_SQL}, '/', annotation_index) AS key FROM ref WHERE answer IS NULL
    UNION ALL SELECT 'misaligned_annotations', {KEY_SQL} FROM (SELECT DISTINCT paper_id, question_id FROM ref WHERE hash_no % 5 = 0)
    UNION ALL SELECT 'blank_worker_id', concat({KEY_SQL}, '/2') FROM (SELECT DISTINCT paper_id, question_id FROM ref WHERE hash_no % 5 = 0)""".replace(
        "ref AS (SELECT paper_id,", "ref AS (SELECT CAST(substr(question_id, 2) AS BIGINT) AS hash_no, paper_id,"
    ),
)
def gold_bundle_rules(spark, sf):
    cases = ev._bundles(spark, sf)
    damaged = F.substring("question_id", 2, 20).cast("long") % 5 == 0
    gold = F.col("gold_answers")
    short = gold.withField("worker_id", F.slice(gold["worker_id"], 1, 2))
    return integrity.gold_bundles(
        cases.withColumn("gold_answers", F.when(damaged, short).otherwise(gold))
    )


# --- G3: a paper of every kind of damage --------------------------------------------------

_DAMAGED_SQL = f"""{ev._PAPER_SQL}, {ev._CASE_SQL}, hurt AS (SELECT paper_ordinal % 12 AS d, id, paper_ordinal, questions FROM paper)"""


@R.add(
    "qa_paper_rules",
    f"""WITH {_DAMAGED_SQL}
    SELECT 'invalid_paper_id' AS rule, id AS key FROM hurt WHERE d = 1
    UNION ALL SELECT 'missing_qas', id FROM hurt WHERE d = 2
    UNION ALL SELECT 'missing_question_writer', id FROM hurt WHERE d = 3
    UNION ALL SELECT 'misaligned_search_query', id FROM hurt WHERE d = 4
    UNION ALL SELECT 'invalid_question', concat(id, '/0') FROM hurt WHERE d = 5 AND questions > 0
    UNION ALL SELECT 'invalid_question_id', concat(id, '/0') FROM hurt WHERE d = 6 AND questions > 0
    UNION ALL SELECT 'repeated_case', concat(paper_id, '/', question_id) FROM qcase JOIN hurt ON id = paper_id
      WHERE (d = 7 AND question_index = 0 AND questions > 1) OR d = 8
    UNION ALL SELECT 'repeated_paper_id', id FROM hurt WHERE d = 8
    UNION ALL SELECT 'misaligned_annotations', concat(paper_id, '/', question_id) FROM qcase JOIN hurt ON id = paper_id WHERE d = 9
    UNION ALL SELECT 'blank_worker_id', concat(paper_id, '/', question_id, '/0') FROM qcase JOIN hurt ON id = paper_id WHERE d = 9""",
)
def qa_paper_rules(spark, sf):
    d, qas = F.col("paper_ordinal") % 12, F.col("qas")
    first = F.lit(0)

    def altered(column, new):
        return F.transform(column, lambda x, i: F.when(i == 0, new).otherwise(x))

    def when(kind, changed, field):
        return F.when(d == kind, changed).otherwise(qas[field])

    ids = F.transform(qas["question_id"], lambda x, i: F.when(i == 1, F.get(qas["question_id"], first)).otherwise(x))
    bundles = F.transform(qas["answers"], lambda b: b.withField("worker_id", F.array().cast("array<string>")))
    hurt = (
        qas.withField("question_writer", F.when(d != 3, qas["question_writer"]))
        .withField("search_query", when(4, F.concat(qas["search_query"], F.array(F.lit("more"))), "search_query"))
        .withField("question", when(5, altered(qas["question"], F.lit(" ")), "question"))
        .withField(
            "question_id",
            F.when(d == 6, altered(qas["question_id"], F.lit(None).cast("string"))).otherwise(when(7, ids, "question_id")),
        )
        .withField("answers", when(9, bundles, "answers"))
    )
    papers = ev._papers(spark, sf).select(
        "paper_ordinal", F.when(d == 1, " ").otherwise(F.col("id")).alias("id"), F.when(d != 2, hurt).alias("qas")
    )
    return integrity.papers(papers.unionByName(papers.filter(d == 8)))


# --- V3 ----------------------------------------------------------------------------------

_TRANSPORT = """
SELECT event_id, CASE event_type WHEN 'error' THEN 'generation_error' ELSE 'success' END AS status,
  CASE WHEN event_type = 'error' AND event_id % 3 = 0 THEN 0 ELSE event_id % 4 - CASE WHEN event_id % 61 = 0 THEN 5 ELSE 0 END END AS provider_attempt_count,
  CASE WHEN event_type = 'error' AND event_id % 3 = 0 THEN 0 ELSE event_id % 3 END AS retry_count,
  event_id % 2 AS rate_limit_response_count, CASE WHEN event_id % 3 = 1 THEN 1 ELSE 0 END AS rate_limit_retry_count,
  CASE WHEN event_id % 3 = 2 THEN 1 ELSE 0 END AS other_transient_retry_count, CASE WHEN event_id % 6 = 2 THEN 1 ELSE 0 END AS schema_output_retry_count,
  CASE WHEN event_id % 59 = 1 THEN CAST('NaN' AS DOUBLE) ELSE value END AS pacing_sleep_seconds, value - 1 AS retry_backoff_sleep_seconds,
  CASE event_id % 7 WHEN 0 THEN true WHEN 1 THEN NULL ELSE false END AS retry_after_used,
  CASE event_id % 8 WHEN 0 THEN ' ' WHEN 1 THEN 'timeout' END AS final_provider_error_category,
  CAST(CASE event_id % 9 WHEN 0 THEN 42 WHEN 1 THEN 429 END AS INT) AS final_http_status,
  CASE event_id % 10 WHEN 0 THEN 'Bad Type' WHEN 1 THEN 'ok_1' END AS final_provider_error_type,
  CASE event_id % 11 WHEN 0 THEN '' WHEN 1 THEN 'ok' END AS final_provider_error_code,
  CASE event_id % 12 WHEN 0 THEN 'gave_up' WHEN 1 THEN 'not_retryable' END AS final_retry_decision FROM {events}"""


@R.add(
    "transport_rules",
    rules_sql(
        f"({plain(_TRANSPORT)})",
        "CAST(event_id AS STRING)",
        {
            "invalid_provider_attempt_count": "provider_attempt_count < 0",
            "invalid_pacing_sleep_seconds": "isnan(pacing_sleep_seconds) OR pacing_sleep_seconds < 0",
            "invalid_retry_backoff_sleep_seconds": "retry_backoff_sleep_seconds < 0",
            "invalid_retry_after_used": "retry_after_used IS NULL",
            "blank_error_category": "trim(final_provider_error_category) = ''",
            "invalid_http_status": "final_http_status < 100",
            "invalid_error_type": "final_provider_error_type = 'Bad Type'",
            "invalid_error_code": "final_provider_error_code = ''",
            "invalid_retry_decision": "final_retry_decision = 'gave_up'",
            "retries_exceed_attempts": "retry_count > provider_attempt_count",
            "rate_limit_retries_exceed_responses": "rate_limit_retry_count > rate_limit_response_count",
            "retry_after_without_rate_limit_retry": "retry_after_used AND rate_limit_retry_count = 0",
            "retry_categories_do_not_add_up": "rate_limit_retry_count + other_transient_retry_count + schema_output_retry_count <> retry_count",
            "generation_error_with_attempts": """status = 'generation_error' AND (provider_attempt_count <> 0 OR retry_count <> 0 OR rate_limit_response_count <> 0
              OR rate_limit_retry_count <> 0 OR other_transient_retry_count <> 0 OR schema_output_retry_count <> 0)""",
            "generation_error_with_telemetry": """status = 'generation_error' AND (coalesce(pacing_sleep_seconds <> 0, false) OR retry_backoff_sleep_seconds <> 0
              OR coalesce(retry_after_used, false) OR final_provider_error_category IS NOT NULL)""",
        },
    ),
)
def transport_rules(spark, sf):
    return integrity.transport(derive(spark, sf, _TRANSPORT), F.col("event_id").cast("string"))


# --- V4: recorded scores, some of them altered ---------------------------------------------


def _altered_scores(spark, sf):
    """Recorded scores of the cases with references: every 11th has a raised score, every 17th another attempt count."""
    results = ev._results(spark, sf)
    judged = ev._judged(spark, sf)
    sums = semantic.case_transport(results, KEYS)
    n = F.substring("question_id", 2, 20).cast("long")
    return judged.join(sums, KEYS).withColumn(
        "semantic_score", F.when(n % 11 == 0, F.col("semantic_score") + 0.5).otherwise(F.col("semantic_score"))
    ).withColumn(
        "provider_attempt_count",
        F.when(n % 17 == 0, F.col("provider_attempt_count") + 1).otherwise(F.col("provider_attempt_count")),
    ).withColumn("matched_reference_index", F.when(n % 19 == 0, F.lit(7)).otherwise(F.col("matched_reference_index")))


@R.add(
    "reference_evaluation_rules",
    f"""WITH {ev._RESULT_SQL}, j AS (SELECT *, CAST(substr(question_id, 2) AS BIGINT) AS n FROM judged WHERE reference_count > 0), o AS (SELECT *, CAST(substr(question_id, 2) AS BIGINT) AS n FROM result)
    SELECT 'wrong_semantic_score' AS rule, {KEY_SQL} AS key FROM j WHERE n % 11 = 0 AND semantic_score IS NOT NULL
    UNION ALL SELECT 'wrong_matched_reference_index', {KEY_SQL} FROM j WHERE n % 19 = 0
    UNION ALL SELECT 'unreconciled_provider_attempt_count', {KEY_SQL} FROM j WHERE n % 17 = 0 AND generation_status = 'success'
    UNION ALL SELECT 'missing_evaluation', concat({KEY_SQL}, '/3') FROM j WHERE n % 23 = 0 AND generation_status = 'success'
    UNION ALL SELECT 'unexpected_evaluation', concat({KEY_SQL}, '/', reference_index) FROM o WHERE n % 13 = 3
    UNION ALL SELECT 'misaligned_evaluation', concat({KEY_SQL}, '/', reference_index) FROM o WHERE n % 29 = 0 AND n % 13 <> 3
    UNION ALL SELECT 'wrong_pass_flag', concat({KEY_SQL}, '/', reference_index) FROM o WHERE n % 31 = 0 AND good""",
)
def reference_evaluation_rules(spark, sf):
    n = F.substring("question_id", 2, 20).cast("long")
    results = ev._results(spark, sf)
    identity = [*KEYS, "reference_index", "annotation_id", "answer_type", "reference_answer"]
    refs = results.select(*identity)
    extra = refs.filter((n % 23 == 0) & (F.col("reference_index") == 0)).withColumn("reference_index", F.lit(3))
    references = refs.withColumn(
        "annotation_id", F.when(n % 29 == 0, "other").otherwise(F.col("annotation_id"))
    ).unionByName(extra)
    flipped = results.withColumn("passed", F.when(n % 31 == 0, ~F.col("passed")).otherwise(F.col("passed")))
    return integrity.reference_evaluations(_altered_scores(spark, sf), references, flipped, ev.THRESHOLD)


# --- V5 ---------------------------------------------------------------------------------------

_JUDGE_ROWS = """
SELECT event_id AS line_no, CAST(user_id AS STRING) AS paper_id, event_type AS question_id, CASE event_id % 37 WHEN 1 THEN 'other' ELSE 'judge-1' END AS judge_model,
  CASE event_id % 31 WHEN 1 THEN 'v0' ELSE 'v1' END AS evaluator_version, CASE event_id % 29 WHEN 1 THEN 'wrong' END AS damage,
  CASE event_id % 23 WHEN 1 THEN 'maybe' ELSE 'success' END AS status, CAST(event_id % 50 AS INT) AS attempt_number FROM {events}"""


@R.add(
    "judge_row_rules",
    rules_sql(
        f"({plain(_JUDGE_ROWS)})",
        "CAST(line_no AS STRING)",
        {
            "wrong_resume_key": "damage IS NOT NULL",
            "other_judge_model": "judge_model <> 'judge-1'",
            "other_evaluator_version": "evaluator_version <> 'v1'",
            "invalid_status": "status = 'maybe'",
            "invalid_attempt_number": "attempt_number < 1",
        },
    )
    + f""" UNION ALL SELECT 'repeated_attempt_number', concat_ws('/', paper_id, question_id, attempt_number) FROM ({plain(_JUDGE_ROWS)})
    GROUP BY paper_id, question_id, attempt_number HAVING count(*) > 1""",
)
def judge_row_rules(spark, sf):
    rows = derive(spark, sf, _JUDGE_ROWS)
    key = digest.resume_key(*[F.col(c) for c in ("paper_id", "question_id", "judge_model", "evaluator_version")])
    return integrity.judge_attempts(
        rows.withColumn("resume_key", F.coalesce("damage", key)), "judge-1", "v1"
    )


# --- V6 ------------------------------------------------------------------------------------------


@R.add(
    "f1_artifact_rules",
    f"""WITH {ev._F1_SQL}, b AS (SELECT *, CAST(substr(question_id, 2) AS BIGINT) AS n FROM best JOIN ans USING (paper_id, question_id))
    SELECT 'missing_score' AS rule, {KEY_SQL} AS key FROM b WHERE n % 41 = 0
    UNION ALL SELECT 'repeated_score', {KEY_SQL} FROM b WHERE n % 43 = 0 AND n % 41 <> 0
    UNION ALL SELECT 'error_with_score', {KEY_SQL} FROM b, (SELECT unnest([1, 2]) AS i) WHERE status = 'error' AND n % 13 = 3 AND n % 3 = 0 AND n % 41 <> 0 AND (i = 1 OR n % 43 = 0)
    UNION ALL SELECT 'question_changed', {KEY_SQL} FROM b, (SELECT unnest([1, 2]) AS i) WHERE n % 47 = 0 AND n % 41 <> 0 AND (i = 1 OR n % 43 = 0)
    UNION ALL SELECT 'unexpected_score', 'nowhere/' || source FROM (SELECT DISTINCT source FROM documents)
    UNION ALL SELECT 'metric_differs', unnest(['answer_f1', 'answer_f1_percentage', 'evaluated_cases', 'f1_boolean', 'f1_extractive', 'f1_abstractive', 'f1_none', 'successful_predictions', 'generation_errors'])""",
)
def f1_artifact_rules(spark, sf):
    answers = derive(spark, sf, ev._ANSWERS).select(*KEYS, "case_ordinal", "status", F.lit("asked").alias("question"))
    n = F.substring("question_id", 2, 20).cast("long")
    best = answer_f1.best_reference(ev._scored(spark, sf), KEYS)
    raised = (n % 13 == 3) & (n % 3 == 0)
    scores = best.select(
        *KEYS,
        F.when(n % 47 == 0, "changed").otherwise("asked").alias("question"),
        F.when(raised, 0.5).otherwise(F.col("answer_f1")).alias("answer_f1"),
        "matched_answer_type",
        n.alias("score_ordinal"),
    ).filter(n % 41 != 0)
    again = scores.filter(n % 43 == 0)
    stray = table(spark, sf, "documents").select(
        F.lit("nowhere").alias("paper_id"),
        F.col("source").alias("question_id"),
        F.lit("asked").alias("question"),
        F.lit(0.0).alias("answer_f1"),
        F.lit("none").alias("matched_answer_type"),
        F.lit(0).cast("long").alias("score_ordinal"),
    ).distinct()
    recorded = integrity.as_metrics(ev.f1_metrics(spark, sf)).withColumn("value", F.col("value") + 1000)
    return integrity.f1_artifacts(answers, scores.unionByName(again).unionByName(stray), recorded)


# --- V7 --------------------------------------------------------------------------------------------


@R.add(
    "semantic_artifact_rules",
    f"""WITH {ev._RESULT_SQL}, j AS (SELECT *, CAST(substr(question_id, 2) AS BIGINT) AS n FROM judged)
    SELECT 'score_out_of_range' AS rule, {KEY_SQL} AS key FROM j WHERE n % 37 = 0 AND status <> 'judge_error'
    UNION ALL SELECT 'scored_generation_error', {KEY_SQL} FROM j WHERE n % 37 = 0 AND status = 'generation_error'
    UNION ALL SELECT 'wrong_pass_flag', {KEY_SQL} FROM j WHERE n % 37 = 0 AND status = 'success' AND NOT passed
    UNION ALL SELECT 'scored_judge_error', {KEY_SQL} FROM j WHERE n % 37 = 0 AND status = 'judge_error'
    UNION ALL SELECT 'missing_score', {KEY_SQL} FROM j WHERE n % 53 = 1
    UNION ALL SELECT 'metric_differs', 'evaluation_coverage' UNION ALL SELECT 'metric_differs', 'band:9-10' UNION ALL SELECT 'metric_differs', 'mean_semantic_correctness'
    UNION ALL SELECT 'metric_differs', 'non_null_evaluated_case_count' UNION ALL SELECT 'metric_differs', 'pass_rate' """,
)
def semantic_artifact_rules(spark, sf):
    n = F.substring("question_id", 2, 20).cast("long")
    selected = derive(spark, sf, ev.SEMANTIC_CASES)
    judged = ev._judged(spark, sf)
    altered = judged.withColumn(
        "semantic_score", F.when(n % 37 == 0, F.lit(2.0)).otherwise(F.col("semantic_score"))
    )
    # The recorded metrics describe the altered rows, shifted in five places;
    # the missing rows are dropped from both, so the counts agree.
    kept = altered.filter(n % 53 != 1)
    wrong = ("evaluation_coverage", "band:9-10", "mean_semantic_correctness", "non_null_evaluated_case_count", "pass_rate")
    truth = integrity.as_metrics(semantic.run_metrics(selected, kept, KEYS)).unionByName(
        semantic.band_counts(kept).select(
            F.concat(F.lit("band:"), "band").alias("name"), F.col("n").cast("double").alias("value")
        )
    )
    recorded = truth.withColumn("value", F.when(F.col("name").isin(*wrong), F.col("value") + 1).otherwise(F.col("value")))
    return integrity.semantic_artifacts(selected, kept, recorded, ev.THRESHOLD)


@R.add(
    "judge_reliability_rules",
    """SELECT 'reliability_differs' AS rule, 'total_provider_attempts' AS key
    UNION ALL SELECT 'reliability_differs', 'total_pacing_sleep_seconds'
    UNION ALL SELECT 'reliability_differs', 'historical_judge_error_attempt_count'""",
)
def judge_reliability_rules(spark, sf):
    rows, chosen = ev._history(spark, sf)
    truth = integrity.as_metrics(semantic.reliability(chosen, rows))
    wrong = ("total_provider_attempts", "total_pacing_sleep_seconds", "historical_judge_error_attempt_count")
    # A difference of less than a millionth of a second is none.
    off = F.when(F.col("name").isin(*wrong), 1.0).when(F.col("name") == "total_retry_backoff_sleep_seconds", 4e-7)
    recorded = truth.withColumn("value", F.col("value") + F.coalesce(off, F.lit(0.0)))
    return integrity.reliability(recorded, chosen, rows)


# --- V8 ------------------------------------------------------------------------------------------------


@R.add(
    "generation_manifest_rules",
    f"""WITH a AS ({plain(ev._ANSWERS)}) SELECT 'count_differs' AS rule, 'successful' AS key UNION ALL SELECT 'count_differs', 'selected_questions'
    UNION ALL SELECT 'repeated_case', {KEY_SQL} FROM a JOIN labels l ON l.doc_id = a.case_ordinal WHERE l.toxic = 1
    UNION ALL SELECT 'subset_digest_differs', 'case_selection'""",
)
def generation_manifest_rules(spark, sf):
    answers = derive(spark, sf, ev._ANSWERS)
    toxic = table(spark, sf, "labels").filter("toxic = 1").select(F.col("doc_id").alias("case_ordinal"))
    doubled = answers.unionByName(answers.join(toxic, "case_ordinal", "left_semi"))
    truth = doubled.agg(
        (F.count("*") + 1).alias("selected_questions"),
        (F.count_if(F.col("status") == "success") + 1).alias("successful"),
        F.count_if(F.col("status") != "success").alias("failed"),
    )
    digests = ev.selection_digest(spark, sf).select(
        F.lit("0" * 64).alias("recorded_digest"),
        F.col("ordered_case_key_blocks_sha256").alias("recomputed_digest"),
    )
    return integrity.generation_manifest(doubled, integrity.as_metrics(truth), digests)


# --- V9 --------------------------------------------------------------------------------------------------


def _inputs(spark, sf):
    docs = table(spark, sf, "documents")
    n = F.col("doc_id")
    context = digest.sha256_fields(relevance=F.col("text"), groundedness=F.col("lang"))
    return docs.select(
        F.col("source").alias("paper_id"),
        F.concat(F.lit("q"), n.cast("string")).alias("question_id"),
        F.when(n % 19 == 1, "lost").when(n % 17 == 1, "input_error").otherwise("success").alias("status"),
        F.col("text").alias("relevance_checker_context"),
        F.col("lang").alias("checker_context"),
        F.col("source").alias("generated_answer"),
        F.when(n % 13 == 1, "bad").otherwise(context).alias("context_digest"),
        F.when(n % 11 == 1, F.lit(None)).otherwise(digest.sha256_text(F.col("source"))).alias("answer_digest"),
    )


_IN_KEY = "concat(source, '/q', doc_id)"


@R.add(
    "comparison_input_rules",
    rules_sql(
        "documents",
        _IN_KEY,
        {
            "invalid_status": "doc_id % 19 = 1",
            "context_digest_differs": "doc_id % 13 = 1 AND doc_id % 19 <> 1 AND doc_id % 17 <> 1",
            "answer_digest_differs": "doc_id % 11 = 1 AND doc_id % 19 <> 1 AND doc_id % 17 <> 1",
        },
    ),
)
def comparison_input_rules(spark, sf):
    return integrity.comparison_inputs(_inputs(spark, sf))


@R.add(
    "comparison_result_rules",
    rules_sql(
        "(SELECT d.*, CASE WHEN quality = 1 THEN 'A' ELSE 'C' END AS m FROM documents d JOIN labels USING (doc_id))",
        "concat(CASE WHEN doc_id % 7 = 1 THEN 'nowhere' ELSE source END, '/q', doc_id, '/', m)",
        {
            "unknown_case": "doc_id % 7 = 1",
            "unknown_model": "m = 'C'",
            "context_digest_differs": "doc_id % 13 = 1 AND doc_id % 7 <> 1",
            "answer_digest_differs": "doc_id % 11 = 1 AND doc_id % 7 <> 1",
        },
    ),
)
def comparison_result_rules(spark, sf):
    inputs = _inputs(spark, sf)
    n = F.substring("question_id", 2, 20).cast("long")
    labels = table(spark, sf, "labels").select(
        F.concat(F.lit("q"), F.col("doc_id").cast("string")).alias("question_id"), "quality"
    )
    true_context = digest.sha256_fields(relevance=F.col("relevance_checker_context"), groundedness=F.col("checker_context"))
    results = inputs.join(labels, "question_id").select(
        F.when(n % 7 == 1, "nowhere").otherwise(F.col("paper_id")).alias("paper_id"),
        "question_id",
        F.when(F.col("quality") == 1, "A").otherwise("C").alias("model_id"),
        F.lit("success").alias("status"),
        true_context.alias("context_digest"),
        digest.sha256_text(F.col("generated_answer")).alias("answer_digest"),
    )
    return integrity.comparison_results(results, inputs, ["A", "B"])


# --- V10 -----------------------------------------------------------------------------------------------------


@R.add(
    "history_binding_rules",
    f"""WITH {ev._REF_SQL}, r AS (SELECT *, CAST(substr(question_id, 2) AS BIGINT) AS n FROM ref)
    SELECT 'reference_differs' AS rule, concat({KEY_SQL}, '/', annotation_index, '/', 1) AS key FROM r WHERE n % 9 = 1 AND answer IS NOT NULL
    UNION ALL SELECT 'evidence_differs', concat({KEY_SQL}, '/', annotation_index, '/', 1) FROM r WHERE n % 8 = 1
    UNION ALL SELECT 'unknown_reference', concat({KEY_SQL}, '/', annotation_index + 5, '/', 2) FROM r WHERE n % 10 = 1""",
)
def history_binding_rules(spark, sf):
    n = F.substring("question_id", 2, 20).cast("long")
    truth = ev._references(spark, sf).select(
        *KEYS, "annotation_index", "annotation_id", "answer", "answer_type", F.col("evidence.sha256").alias("evidence_sha256")
    )
    judged = truth.withColumn("attempt_number", F.lit(1)).withColumn(
        "answer", F.when(n % 9 == 1, F.concat("answer", F.lit("!"))).otherwise(F.col("answer"))
    ).withColumn("evidence_sha256", F.when(n % 8 == 1, "0").otherwise(F.col("evidence_sha256")))
    strangers = truth.filter(n % 10 == 1).withColumn("annotation_index", F.col("annotation_index") + 5)
    return integrity.history_binding(
        judged.unionByName(strangers.withColumn("attempt_number", F.lit(2))), truth
    )


# --- V11 -------------------------------------------------------------------------------------------------------

_STORED = """
SELECT CAST(doc_id AS STRING) AS chunk_id, text AS page_content,
  CASE doc_id % 12 WHEN 1 THEN concat('/srv/', source) WHEN 2 THEN concat('C:/', source) ELSE source END AS source_name,
  CASE doc_id % 15 WHEN 1 THEN '/etc/x' ELSE lang END AS section_header, CAST(doc_id AS INT) AS page, 'section' AS doc_type, doc_id FROM {documents}"""


@R.add(
    "portable_document_rules",
    rules_sql(
        "documents",
        "CAST(doc_id AS STRING)",
        {
            "absolute_source_name": "doc_id % 12 IN (1, 2)",
            "absolute_section_header": "doc_id % 15 = 1",
            "text_differs": "doc_id % 6 = 5",
        },
    ),
)
def portable_document_rules(spark, sf):
    rows = derive(spark, sf, _STORED)
    whole = text.structured_text(
        F.col("page_content"), F.col("source_name"), F.col("section_header"), F.col("page"), F.col("doc_type")
    )
    stored = rows.withColumn(
        "structured_text", F.when(F.col("doc_id") % 6 == 5, F.concat(whole, F.lit("."))).otherwise(whole)
    )
    return integrity.portable_documents(stored, ["source_name", "section_header"])


_METADATA = """
SELECT CAST(doc_id AS STRING) AS chunk_id, CASE doc_id % 10 WHEN 5 THEN '[1]' WHEN 6 THEN '{{' WHEN 7 THEN NULL ELSE concat(
  '{{"page": ', CAST(doc_id AS STRING), ', "fusion_score": 0.5, "section_header": null, "source_name": "', CASE doc_id % 10 WHEN 3 THEN '/srv/' ELSE '' END, source,
  '", "filename": "', CASE doc_id % 10 WHEN 4 THEN 'up/' ELSE '' END, source, '.pdf"',
  CASE doc_id % 10 WHEN 1 THEN ', "owner": "x"' WHEN 2 THEN ', "languages": ["de"]' WHEN 8 THEN ', "fingerprint": {{"a": 1}}' WHEN 9 THEN ', "raw_content": "[1] {{x}}"' ELSE '' END, '}}') END AS metadata
FROM {documents}"""


@R.add(
    "portable_metadata_rules",
    rules_sql(
        "documents",
        "CAST(doc_id AS STRING)",
        {
            "foreign_field": "doc_id % 10 = 1",
            "non_scalar_languages": "doc_id % 10 = 2",
            "absolute_source_name": "doc_id % 10 = 3",
            "filename_with_folder": "doc_id % 10 = 4",
            "not_an_object": "doc_id % 10 IN (5, 6, 7)",
            "non_scalar_fingerprint": "doc_id % 10 = 8",
        },
    ),
)
def portable_metadata_rules(spark, sf):
    return integrity.portable_metadata(derive(spark, sf, _METADATA))


# --- V12 ----------------------------------------------------------------------------------------------------------


@R.add(
    "base_completeness_rules",
    f"""WITH {tok_ctes(CHUNKS_BY_LANG)}, base AS (SELECT DISTINCT lang AS kb_id FROM documents UNION SELECT DISTINCT role FROM conversations)
    SELECT 'no_documents' AS rule, kb_id AS key FROM base WHERE kb_id NOT IN (SELECT lang FROM documents) AND kb_id <> 'user'
    UNION ALL SELECT 'no_chunks', kb_id FROM base WHERE kb_id NOT IN (SELECT lang FROM documents)
    UNION ALL SELECT 'no_postings', kb_id FROM base WHERE kb_id NOT IN (SELECT kb_id FROM posting)
    UNION ALL SELECT 'no_vectors', kb_id FROM base WHERE kb_id NOT IN (SELECT lang FROM documents JOIN embeddings ON vec_id = doc_id)""",
)
def base_completeness_rules(spark, sf):
    lex = index.build_lexical_index(derive(spark, sf, CHUNKS_BY_LANG))
    docs = table(spark, sf, "documents").select(F.col("lang").alias("kb_id"), "doc_id")
    roles = table(spark, sf, "conversations").select(F.col("role").alias("kb_id"))
    bases = docs.select("kb_id").unionByName(roles).distinct()
    vectors = docs.join(table(spark, sf, "embeddings").select(F.col("vec_id").alias("doc_id")), "doc_id")
    documents = docs.select("kb_id").unionByName(roles.filter("kb_id = 'user'"))
    return integrity.base_completeness(bases, documents, lex.chunks, vectors, lex.postings)


@R.add(
    "checker_accounting_rules",
    "SELECT 'accounting_differs' AS rule, 'groundedness|unknown:malformed_output' AS key UNION ALL SELECT 'accounting_differs', 'relevance|valid'",
)
def checker_accounting_rules(spark, sf):
    again = telemetry.availability(event_logs(spark, sf))
    name = F.concat_ws("|", "role", "measure")
    wrong = name.isin("relevance|valid", "groundedness|unknown:malformed_output")
    recorded = again.withColumn("n", F.when(wrong, F.col("n") + 1).otherwise(F.col("n")))
    return integrity.accounting(recorded, again)


@R.add(
    "run_summary_rules",
    """SELECT 'summary_differs' AS rule, 'selected' AS key UNION ALL SELECT 'summary_differs', 'answer_f1'
    UNION ALL SELECT 'summary_differs', 'semantic_coverage'""",
)
def run_summary_rules(spark, sf):
    summary = ev.run_summary(spark, sf)
    wrong = {"selected": F.col("selected") + 1, "answer_f1": F.col("answer_f1") + 0.5, "semantic_coverage": F.lit(None).cast("double")}
    stages = {"answer_f1": ev.f1_metrics(spark, sf), "semantic": ev.semantic_metrics_row(spark, sf)}
    return integrity.summary_metrics(summary.withColumns(wrong), stages)

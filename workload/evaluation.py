"""Dataset selection, answer scoring, semantic roll-ups and reports."""

from __future__ import annotations

from pyspark.sql import functions as F

from docquarry.functions import digest
from docquarry.operators import (
    answer_f1,
    attempts,
    comparison,
    dataset,
    report,
    semantic,
)
from docquarry.operators.checks import GROUNDEDNESS_LABELS, RELEVANCE_LABELS
from docquarry.session import scratch_dir, spread
from docquarry.sources import papers as paper_source
from workload.logs import MATCH_SQL, case_logs, event_logs, EVENT_LOGS_SQL, matched_cases
from workload.ingestion import strip_sql, WS
from workload.tables import Registry, derive, plain, table

R = Registry()
KEYS = ["paper_id", "question_id"]
THRESHOLD = 0.7

# --- papers: a conversation is a paper, its user turns are questions -------------------


def _papers(spark, sf):
    """Nested papers; the turns of one conversation are the paper's own arrays."""
    turns = table(spark, sf, "conversations")
    asked = F.array_sort(
        F.collect_list(F.when(F.col("role") == "user", F.struct("turn", "text")))
    )
    sections = F.array_sort(
        F.collect_list(F.when(F.col("role") == "system", F.struct("turn", "text")))
    )
    grouped = turns.groupBy("conv_id").agg(asked.alias("q"), sections.alias("s"))
    name = F.col("conv_id").cast("string")
    same = lambda x: F.transform("q", lambda t: F.lit(x))
    annotation = F.struct(
        F.lit(False).alias("unanswerable"),
        F.array().cast("array<string>").alias("extractive_spans"),
        F.lit(None).cast("boolean").alias("yes_no"),
        F.lit("free").alias("free_form_answer"),
        F.array().cast("array<string>").alias("evidence"),
        F.array().cast("array<string>").alias("highlighted_evidence"),
    )
    bundle = F.struct(
        F.array(annotation).alias("answer"),
        F.array(F.lit("a0")).alias("annotation_id"),
        F.array(F.lit("w0")).alias("worker_id"),
    )
    qas = F.struct(
        F.transform("q", lambda t: t["text"]).alias("question"),
        F.transform("q", lambda t: F.concat(F.lit("q"), t["turn"].cast("string"))).alias("question_id"),
        same("infinity").alias("nlp_background"),
        same("familiar").alias("topic_background"),
        same("no").alias("paper_read"),
        same("s").alias("search_query"),
        same("w").alias("question_writer"),
        F.transform("q", lambda t: bundle).alias("answers"),
    )
    return grouped.select(
        name.alias("id"),
        F.col("conv_id").alias("paper_ordinal"),
        qas.alias("qas"),
        F.struct(F.transform("s", lambda t: t["text"]).alias("section_name")).alias("full_text"),
    )


_PAPER_SQL = """paper AS (SELECT CAST(conv_id AS STRING) AS id, conv_id AS paper_ordinal, count(*) FILTER (role = 'user') AS questions,
  count(*) FILTER (role = 'system') AS sections FROM conversations GROUP BY conv_id)"""


@R.add(
    "papers_from_parquet",
    f"WITH {_PAPER_SQL} SELECT id, questions, sections FROM paper",
)
def papers_from_parquet(spark, sf):
    path = scratch_dir(spark, "papers")
    _papers(spark, sf).write.parquet(path)
    read = paper_source.read_papers(spark, path)
    return read.select(
        "id",
        F.size("qas.question").cast("long").alias("questions"),
        F.size("full_text.section_name").cast("long").alias("sections"),
    )


@R.add("eligible_papers", f"WITH {_PAPER_SQL} SELECT id, questions FROM paper WHERE questions >= 3 AND sections > 0")
def eligible_papers(spark, sf):
    return dataset.eligible_papers(_papers(spark, sf)).select(
        "id", F.size("qas.question").cast("long").alias("questions")
    )


@R.add(
    "sampled_papers",
    f"WITH {_PAPER_SQL} SELECT id FROM paper ORDER BY md5(concat('1001|', id)), id LIMIT 28",
)
def sampled_papers(spark, sf):
    return dataset.sample_papers(_papers(spark, sf).select("id"), 28, 1001)


_CASE_SQL = """turned AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS i FROM conversations WHERE role = 'user'),
qcase AS (SELECT CAST(conv_id AS STRING) AS paper_id, conv_id AS paper_ordinal, CAST(i AS INT) AS question_index, text AS question,
  concat('q', CAST(turn AS STRING)) AS question_id, row_number() OVER (ORDER BY conv_id, turn) - 1 AS case_ordinal FROM turned)"""


@R.add(
    "flattened_questions",
    f"WITH {_CASE_SQL} SELECT paper_id, paper_ordinal, question_index, question, question_id FROM qcase",
)
def flattened_questions(spark, sf):
    return dataset.flatten_questions(_papers(spark, sf)).select(
        "paper_id", "paper_ordinal", "question_index", "question", "question_id"
    )


@R.add("saved_papers", f"WITH {_CASE_SQL} SELECT paper_id, question_index, question, question_id FROM qcase")
def saved_papers(spark, sf):
    # JSON array files of at most 20 consecutive papers each.
    path = scratch_dir(spark, "saved")
    rows = _papers(spark, sf).select(
        F.to_json(F.struct("id", "qas")).alias("j"),
        "paper_ordinal",
        F.floor(F.col("paper_ordinal") / 20).alias("part"),
    )
    listed = F.transform(F.array_sort(F.collect_list(F.struct("paper_ordinal", "j"))), lambda x: x["j"])
    arrays = rows.groupBy("part").agg(
        F.concat(F.lit("["), F.array_join(listed, ","), F.lit("]")).alias("value")
    )
    arrays.write.partitionBy("part").text(path)
    read = paper_source.read_saved_papers(spark, path)
    return dataset.flatten_questions(read).select("paper_id", "question_index", "question", "question_id")


def _cases(spark, sf):
    papers = _papers(spark, sf)
    order = dataset.number_cases(papers).select(F.col("id").alias("paper_id"), "first_case")
    flat = dataset.flatten_questions(papers).join(order, "paper_id")
    return flat.select(
        "paper_id",
        "paper_ordinal",
        "question_id",
        "question",
        (F.col("first_case") + F.col("question_index")).alias("case_ordinal"),
    )


@R.add("case_order", f"WITH {_CASE_SQL} SELECT paper_id, question_id, case_ordinal FROM qcase")
def case_order(spark, sf):
    return _cases(spark, sf).select("paper_id", "question_id", "case_ordinal")


@R.add(
    "first_cases",
    f"WITH {_CASE_SQL} SELECT paper_id, question_id, case_ordinal FROM qcase WHERE paper_ordinal < 40 ORDER BY case_ordinal LIMIT 75",
)
def first_cases(spark, sf):
    return dataset.first_cases(_cases(spark, sf), 40, 75).select("paper_id", "question_id", "case_ordinal")


_WANTED = """
SELECT CAST(conv_id AS STRING) AS paper_id, concat('q', CAST(turn AS STRING)) AS question_id
FROM {conversations} WHERE role = 'user' AND length(text) > 200
UNION ALL SELECT CAST(conv_id AS STRING) AS paper_id, 'q-none' AS question_id FROM {conversations} WHERE role = 'system'"""


@R.add(
    "cases_by_key",
    f"WITH {_CASE_SQL} SELECT c.paper_id, c.question_id FROM qcase c SEMI JOIN ({plain(_WANTED)}) w USING (paper_id, question_id)",
)
def cases_by_key(spark, sf):
    return dataset.cases_by_key(_cases(spark, sf), derive(spark, sf, _WANTED))[0].select("paper_id", "question_id")


@R.add(
    "missing_case_keys",
    f"WITH {_CASE_SQL} SELECT DISTINCT paper_id, question_id FROM ({plain(_WANTED)}) w ANTI JOIN qcase c USING (paper_id, question_id)",
)
def missing_case_keys(spark, sf):
    return dataset.cases_by_key(_cases(spark, sf), derive(spark, sf, _WANTED))[1]


# --- answer attempts ----------------------------------------------------------------------

# A user's hour is a case, each event one attempt in file order.
_ATTEMPTS = """
SELECT CAST(user_id AS STRING) AS paper_id, CAST(date_trunc('hour', ts) AS STRING) AS question_id, event_id AS line_no,
  CASE WHEN event_type IN ('error', 'signup') THEN 'error' ELSE 'success' END AS status,
  CASE WHEN event_type = 'error' THEN 'judge_error' WHEN event_type IN ('signup', 'view') THEN 'generation_error' ELSE 'success' END AS judge_status,
  event_type AS question, value FROM {events}"""


@R.add(
    "latest_answers",
    f"""SELECT paper_id, question_id, arg_max(line_no, CASE WHEN status = 'success' THEN line_no + 1000000000000 ELSE line_no END) AS line_no,
      min(line_no) AS first_seen, count(*) AS attempt_count FROM ({plain(_ATTEMPTS)}) GROUP BY ALL""",
)
def latest_answers(spark, sf):
    rows = derive(spark, sf, _ATTEMPTS)
    return attempts.latest(rows, KEYS, "line_no").select(*KEYS, "line_no", "first_seen", "attempt_count")


@R.add(
    "latest_judgements",
    f"""SELECT paper_id, question_id, arg_max(line_no, CASE judge_status WHEN 'success' THEN 2000000000000 WHEN 'generation_error' THEN 1000000000000 ELSE 0 END + line_no) AS line_no,
      count(*) AS attempt_count FROM ({plain(_ATTEMPTS)}) GROUP BY ALL""",
)
def latest_judgements(spark, sf):
    rows = derive(spark, sf, _ATTEMPTS)
    return attempts.latest(rows, KEYS, "line_no", attempts.JUDGE_TIERS, "judge_status").select(
        *KEYS, "line_no", "attempt_count"
    )


@R.add(
    "duplicate_attempts",
    f"SELECT count(*) - count(DISTINCT (paper_id, question_id)) AS duplicate_attempts FROM ({plain(_ATTEMPTS)})",
)
def duplicate_attempts(spark, sf):
    return attempts.duplicate_count(attempts.latest(derive(spark, sf, _ATTEMPTS), KEYS, "line_no"))


@R.add(
    "inconsistent_attempts",
    f"SELECT paper_id, question_id FROM ({plain(_ATTEMPTS)}) GROUP BY ALL HAVING count(DISTINCT question) > 1",
)
def inconsistent_attempts(spark, sf):
    return attempts.inconsistent_keys(derive(spark, sf, _ATTEMPTS), KEYS, ["question"])


_RECORDS = """
SELECT CAST(conv_id AS STRING) AS paper_id, concat('q', CAST(turn - 1 AS STRING)) AS question_id,
  CASE WHEN length(text) % 4 = 0 THEN 'error' ELSE 'success' END AS status FROM {conversations} WHERE role = 'assistant'"""


@R.add(
    "pending_cases",
    f"""WITH {_CASE_SQL} SELECT paper_id, question_id, case_ordinal FROM qcase
    ANTI JOIN (SELECT * FROM ({plain(_RECORDS)}) WHERE status = 'success') r USING (paper_id, question_id)""",
)
def pending_cases(spark, sf):
    return dataset.pending(_cases(spark, sf), derive(spark, sf, _RECORDS)).select(*KEYS, "case_ordinal")


@R.add(
    "generation_run_status",
    f"""WITH {_CASE_SQL}, r AS ({plain(_RECORDS)}), l AS ({EVENT_LOGS_SQL}),
    t AS (SELECT (SELECT count(*) FROM r) AS answer_records, (SELECT count(*) FROM r WHERE status = 'success') AS successful,
      (SELECT count(*) FROM r WHERE status <> 'success') AS failed,
      (SELECT count(*) FROM qcase ANTI JOIN (SELECT * FROM r WHERE status = 'success') s USING (paper_id, question_id)) AS pending_cases,
      CAST((SELECT count_if(lower(relevance_label) = 'unknown') + count_if(lower(groundedness_label) = 'unknown') FROM l) AS BIGINT) AS unknown_diagnostics,
      (SELECT count(*) FROM l) AS application_log_records)
    SELECT *, CASE WHEN pending_cases = 0 AND unknown_diagnostics = 0 AND application_log_records >= successful THEN 'complete' ELSE 'complete_with_errors' END AS run_status FROM t""",
)
def generation_run_status(spark, sf):
    from docquarry.operators import telemetry

    records = derive(spark, sf, _RECORDS)
    logs = event_logs(spark, sf)
    return dataset.generation_status(
        dataset.pending(_cases(spark, sf), records),
        dataset.record_counters(records),
        telemetry.availability(logs),
        logs.agg(F.count("*").alias("application_log_records")),
    )


# --- gold bundles ------------------------------------------------------------------------------

# Whole documents are predictions; each has three reference annotations, paired
# with benchmark texts by number.
_ANSWERS = """
SELECT source AS paper_id, concat('q', CAST(doc_id AS STRING)) AS question_id, doc_id AS case_ordinal,
  CASE doc_id % 17 WHEN 5 THEN concat('Sorry. THE document does not contain this information. ', text) WHEN 6 THEN ' ' WHEN 7 THEN 'Yes!' ELSE text END AS prediction,
  CASE doc_id % 13 WHEN 3 THEN 'error' ELSE 'success' END AS status FROM {documents}"""
_GOLD = """
SELECT d.source AS paper_id, concat('q', CAST(d.doc_id AS STRING)) AS question_id, CAST(s.k AS INT) AS annotation_index,
  concat('a', CAST(s.k AS STRING)) AS annotation_id, concat('w', CAST(b.item_id AS STRING)) AS worker_id, b.text, CAST((d.doc_id % 7 + s.k) % 7 AS INT) AS form
FROM {documents} d JOIN (VALUES (0), (1), (2)) AS s(k) ON s.k < 3
JOIN {benchmark} b ON b.item_id = (d.doc_id * 3 + s.k) % (SELECT count(*) FROM {benchmark})"""


def _bundles(spark, sf):
    """Nested gold bundles of three annotations per case."""
    form, body = F.col("form"), F.col("text")
    lines = F.split(body, r"\. ")
    none = F.array().cast("array<string>")
    annotation = F.struct(
        (form == 0).alias("unanswerable"),
        F.when(form.isin(0, 1), F.array(body, F.lit("two"))).otherwise(none).alias("extractive_spans"),
        F.when(form.isin(2, 3), form == 2).alias("yes_no"),
        F.when(form.isin(4, 5), body).otherwise("").alias("free_form_answer"),
        lines.alias("evidence"),
        F.when(form % 2 == 0, F.array(F.lit(" "), F.lit("\n")))
        .when(form == 5, F.slice(lines, 1, 1))
        .otherwise(none)
        .alias("highlighted_evidence"),
    )
    rows = derive(spark, sf, _GOLD).select(
        *KEYS, F.struct("annotation_index", annotation.alias("a"), "annotation_id", "worker_id").alias("r")
    )
    listed = rows.groupBy(*KEYS).agg(F.array_sort(F.collect_list("r")).alias("r"))
    return listed.select(
        *KEYS,
        F.struct(
            F.transform("r", lambda x: x["a"]).alias("answer"),
            F.transform("r", lambda x: x["annotation_id"]).alias("annotation_id"),
            F.transform("r", lambda x: x["worker_id"]).alias("worker_id"),
        ).alias("gold_answers"),
    )


def _references(spark, sf):
    return answer_f1.references(_bundles(spark, sf), KEYS)


# Annotations without any valid form convert to NULL; they are violations, and
# are left out before scoring.
_REF_SQL = f"""ref AS (SELECT paper_id, question_id, annotation_index, annotation_id, worker_id, form, text,
  CASE WHEN form = 0 THEN 'Unanswerable' WHEN form = 1 THEN concat(text, ', two') WHEN form = 2 THEN 'Yes' WHEN form = 3 THEN 'No'
    WHEN form IN (4, 5) THEN text END AS answer,
  CASE WHEN form = 0 THEN 'none' WHEN form = 1 THEN 'extractive' WHEN form IN (2, 3) THEN 'boolean' WHEN form IN (4, 5) THEN 'abstractive' END AS answer_type
  FROM ({plain(_GOLD)}))"""


@R.add(
    "gold_references",
    f"WITH {_REF_SQL} SELECT paper_id, question_id, annotation_index, annotation_id, worker_id, answer, answer_type FROM ref",
)
def gold_references(spark, sf):
    return _references(spark, sf).drop("evidence")


_EVIDENCE_SQL = f"""evid AS (SELECT *, CASE WHEN form = 5 THEN 'highlighted_evidence' ELSE 'evidence' END AS source,
  CASE WHEN form = 5 THEN regexp_split_to_array(text, '\\. ')[1:1] ELSE regexp_split_to_array(text, '\\. ') END AS vals FROM ref)"""


@R.add(
    "reference_evidence",
    f"""WITH {_REF_SQL}, {_EVIDENCE_SQL} SELECT paper_id, question_id, annotation_index, source, array_to_string(vals, '|') AS joined,
      sha256(CAST(to_json(vals) AS STRING)) AS sha256 FROM evid""",
)
def reference_evidence(spark, sf):
    return _references(spark, sf).select(
        *KEYS,
        "annotation_index",
        F.col("evidence.source").alias("source"),
        F.array_join("evidence.ordered_values", "|").alias("joined"),
        F.col("evidence.sha256").alias("sha256"),
    )


@R.add(
    "judge_expected_output",
    f"""WITH {_REF_SQL}, {_EVIDENCE_SQL} SELECT paper_id, question_id, annotation_index, concat('Answer type: ', answer_type, chr(10), 'Reference answer: ', answer,
      chr(10), 'Gold evidence source: ', source, chr(10), 'Gold evidence (ordered JSON array):', chr(10), CAST(to_json(vals) AS STRING)) AS expected_output
    FROM evid WHERE answer IS NOT NULL""",
)
def judge_expected_output(spark, sf):
    refs = _references(spark, sf).filter(F.col("answer").isNotNull())
    return refs.select(
        *KEYS,
        "annotation_index",
        answer_f1.expected_output(F.col("answer_type"), F.col("answer"), F.col("evidence")).alias("expected_output"),
    )


# --- token F1 --------------------------------------------------------------------------------------

_PUNCT = "!\"#$%&''()*+,-./:;<=>?@[\\]^_`{|}~"


@R.add(
    "normalized_answers",
    f"""SELECT doc_id, len(w) AS words, md5(array_to_string(w, ' ')) AS digest FROM (SELECT doc_id,
      [t for t in regexp_split_to_array(translate(lower(text), '{_PUNCT}', ''), '[{WS}]+') if t NOT IN ('', 'a', 'an', 'the')] AS w FROM documents)""",
)
def normalized_answers(spark, sf):
    n = table(spark, sf, "documents").select("doc_id", answer_f1.normalise_answer(F.col("text")).alias("n"))
    return n.select(
        "doc_id",
        F.size(F.array_remove(F.split("n", " "), "")).cast("long").alias("words"),
        F.md5("n").alias("digest"),
    )


@R.add(
    "canonical_predictions",
    f"""SELECT paper_id, question_id, CASE WHEN contains(lower(prediction), 'the document does not contain this information.') THEN 'Unanswerable' ELSE prediction END AS prediction
    FROM ({plain(_ANSWERS)})""",
)
def canonical_predictions(spark, sf):
    return derive(spark, sf, _ANSWERS).select(
        *KEYS, answer_f1.canonical_prediction(F.col("prediction")).alias("prediction")
    )


def _words(x):
    return f"[t for t in regexp_split_to_array(translate(lower({x}), '{_PUNCT}', ''), '[{WS}]+') if t NOT IN ('', 'a', 'an', 'the')]"


_F1_SQL = f"""{_REF_SQL}, ans AS ({plain(_ANSWERS)}),
said AS MATERIALIZED (SELECT paper_id, question_id, t, count(*) AS c FROM (SELECT paper_id, question_id, unnest({_words(
  "CASE WHEN contains(lower(prediction), 'the document does not contain this information.') THEN 'Unanswerable' ELSE prediction END")}) AS t FROM ans WHERE status = 'success') GROUP BY ALL),
want AS MATERIALIZED (SELECT paper_id, question_id, annotation_index, t, count(*) AS c FROM (SELECT paper_id, question_id, annotation_index, unnest({_words('answer')}) AS t
  FROM ref WHERE answer IS NOT NULL) GROUP BY ALL),
saidn AS (SELECT paper_id, question_id, sum(c) AS n FROM said GROUP BY ALL),
wantn AS (SELECT paper_id, question_id, annotation_index, sum(c) AS n FROM want GROUP BY ALL),
common AS (SELECT w.paper_id, w.question_id, w.annotation_index, sum(least(w.c, s.c)) AS m FROM want w JOIN said s
  ON w.paper_id = s.paper_id AND w.question_id = s.question_id AND w.t = s.t GROUP BY ALL),
f1 AS (SELECT r.paper_id, r.question_id, r.annotation_index, r.answer, r.answer_type,
  coalesce(2 * (m / s.n) * (m / w.n) / ((m / s.n) + (m / w.n)), 0.0)::DOUBLE AS f1
  FROM ref r LEFT JOIN common c USING (paper_id, question_id, annotation_index) LEFT JOIN saidn s USING (paper_id, question_id)
  LEFT JOIN wantn w USING (paper_id, question_id, annotation_index) WHERE r.answer IS NOT NULL),
best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY paper_id, question_id ORDER BY f1 DESC, annotation_index) AS rn FROM f1) WHERE rn = 1)"""


def _scored(spark, sf):
    refs = _references(spark, sf).drop("evidence").filter(F.col("answer").isNotNull())
    return answer_f1.score_references(spread(derive(spark, sf, _ANSWERS)), refs, KEYS)


@R.add(
    "token_f1_by_reference",
    f"WITH {_F1_SQL} SELECT paper_id, question_id, annotation_index, round(f1, 9) AS f1 FROM f1",
)
def token_f1_by_reference(spark, sf):
    return _scored(spark, sf).select(*KEYS, "annotation_index", F.round("f1", 9).alias("f1"))


@R.add(
    "best_references",
    f"""WITH {_F1_SQL} SELECT paper_id, question_id, annotation_index, answer AS best_reference, answer_type AS matched_answer_type,
      round(f1, 9) AS answer_f1 FROM best""",
)
def best_references(spark, sf):
    return answer_f1.best_reference(_scored(spark, sf), KEYS).withColumn("answer_f1", F.round("answer_f1", 9))


F1_METRICS_SQL = """SELECT avg(f1) AS answer_f1, avg(f1) * 100 AS answer_f1_percentage,
  coalesce(avg(f1) FILTER (answer_type = 'extractive'), 0) AS f1_extractive, coalesce(avg(f1) FILTER (answer_type = 'abstractive'), 0) AS f1_abstractive,
  coalesce(avg(f1) FILTER (answer_type = 'boolean'), 0) AS f1_boolean, coalesce(avg(f1) FILTER (answer_type = 'none'), 0) AS f1_none,
  count(*) AS evaluated_cases, count(*) FILTER (status = 'success') AS successful_predictions, count(*) FILTER (status = 'error') AS generation_errors
  FROM best JOIN ans USING (paper_id, question_id)"""
_F1_COLUMNS = ["answer_f1", "answer_f1_percentage"] + [f"f1_{t}" for t in answer_f1.ANSWER_TYPES]


def f1_metrics(spark, sf):
    best = answer_f1.best_reference(_scored(spark, sf), KEYS)
    return answer_f1.run_metrics(best, derive(spark, sf, _ANSWERS), KEYS)


@R.add(
    "answer_f1_metrics",
    f"""WITH {_F1_SQL} SELECT {", ".join(f"round({c}, 6) AS {c}" for c in _F1_COLUMNS)}, evaluated_cases, successful_predictions, generation_errors
    FROM ({F1_METRICS_SQL})""",
)
def answer_f1_metrics(spark, sf):
    m = f1_metrics(spark, sf)
    return m.select(
        *[F.round(c, 6).alias(c) for c in _F1_COLUMNS],
        "evaluated_cases",
        "successful_predictions",
        "generation_errors",
    )


# --- semantic judgements ---------------------------------------------------------------------------

# Up to three judged references per document, with recorded transport counters.
SEMANTIC_CASES = """
SELECT source AS paper_id, concat('q', CAST(doc_id AS STRING)) AS question_id, doc_id AS case_ordinal,
  CASE doc_id % 13 WHEN 3 THEN 'error' ELSE 'success' END AS generation_status FROM {documents}"""
_OUTPUTS = """
SELECT d.source AS paper_id, concat('q', CAST(d.doc_id AS STRING)) AS question_id, CAST(s.k AS INT) AS reference_index,
  concat('a', CAST(s.k AS STRING)) AS annotation_id, concat('ref ', CAST(s.k AS STRING)) AS reference_answer,
  CASE (d.doc_id + s.k) % 4 WHEN 0 THEN 'extractive' WHEN 1 THEN 'abstractive' WHEN 2 THEN 'boolean' ELSE 'none' END AS answer_type,
  CASE WHEN (d.doc_id * 7 + s.k) % 61 = 0 THEN 1.5 ELSE (d.doc_id * 37 + s.k * 19) % 21 / 20.0 END AS score,
  concat('because ', CAST(d.n_chars AS STRING)) AS reason,
  CASE WHEN (d.doc_id * 5 + s.k) % 47 = 0 THEN 'JudgeRequestError' END AS error_type,
  CASE WHEN (d.doc_id * 5 + s.k) % 47 = 0 THEN 'provider down' END AS error_message,
  1 + (d.doc_id + s.k) % 3 AS provider_attempt_count, (d.doc_id + s.k) % 3 AS retry_count,
  (d.doc_id + s.k) % 3 AS rate_limit_response_count, CASE WHEN d.doc_id % 2 = 0 THEN (d.doc_id + s.k) % 3 ELSE 0 END AS rate_limit_retry_count,
  CASE WHEN d.doc_id % 2 = 1 THEN (d.doc_id + s.k) % 3 ELSE 0 END AS other_transient_retry_count, d.doc_id * 0 AS schema_output_retry_count,
  CAST(6.0 AS DOUBLE) AS pacing_sleep_seconds, CAST((d.doc_id + s.k) % 3 * 0.3 AS DOUBLE) AS retry_backoff_sleep_seconds,
  d.doc_id % 6 = 0 AND (d.doc_id + s.k) % 3 > 0 AS retry_after_used,
  CASE WHEN (d.doc_id + s.k) % 3 = 2 THEN concat('cat', CAST(s.k AS STRING)) END AS final_provider_error_category,
  CASE WHEN (d.doc_id + s.k) % 3 = 2 THEN CAST(429 AS INT) END AS final_http_status, CAST(NULL AS STRING) AS final_provider_error_type,
  CAST(NULL AS STRING) AS final_provider_error_code, CASE WHEN (d.doc_id + s.k) % 3 = 2 THEN 'retries_exhausted' END AS final_retry_decision
FROM {documents} d JOIN (VALUES (0), (1), (2)) AS s(k) ON s.k <= d.doc_id % 3 AND d.doc_id % 29 <> 7"""
_RESULT_SQL = f"""outputs AS ({plain(_OUTPUTS)}),
result AS (SELECT *, error_type IS NULL AND score BETWEEN 0 AND 1 AS good FROM outputs),
scase AS ({plain(SEMANTIC_CASES)}),
sagg AS (SELECT paper_id, question_id, count(*) AS reference_count, count(*) FILTER (good) AS oks, count(*) FILTER (NOT good) AS bads,
  arg_min(CASE WHEN error_type IS NOT NULL THEN error_message ELSE 'DeepEval returned out-of-range score 1.5.' END, reference_index) FILTER (NOT good) AS error_message,
  max(score) FILTER (good) AS top FROM result GROUP BY ALL),
win AS (SELECT r.paper_id, r.question_id, min(reference_index) AS wi FROM result r JOIN sagg a USING (paper_id, question_id) WHERE good AND score = top GROUP BY ALL),
judged AS (SELECT c.*, CASE WHEN generation_status <> 'success' THEN 'generation_error' WHEN bads > 0 OR reference_count IS NULL THEN 'judge_error' ELSE 'success' END AS status,
  CASE WHEN generation_status <> 'success' THEN 0.0 WHEN bads = 0 THEN top END::DOUBLE AS semantic_score,
  CASE WHEN generation_status <> 'success' THEN false WHEN bads = 0 THEN top >= {THRESHOLD} END AS passed,
  CASE WHEN generation_status = 'success' AND bads = 0 THEN wi END AS matched_reference_index,
  CASE WHEN generation_status = 'success' AND bads = 0 THEN (SELECT any_value(answer_type) FROM result r WHERE r.paper_id = c.paper_id AND r.question_id = c.question_id AND r.reference_index = wi) END AS matched_answer_type,
  CASE WHEN generation_status <> 'success' THEN NULL WHEN reference_count IS NULL THEN 'The case has no reference results.'
    WHEN bads > 0 THEN a.error_message END AS error_message,
  CASE WHEN generation_status = 'success' THEN coalesce(oks, 0) ELSE 0 END AS successful_references,
  CASE WHEN generation_status = 'success' THEN coalesce(bads, 0) ELSE 0 END AS failed_references, coalesce(reference_count, 0) AS reference_count
  FROM scase c LEFT JOIN sagg a USING (paper_id, question_id) LEFT JOIN win USING (paper_id, question_id))"""


def _results(spark, sf):
    rows = derive(spark, sf, _OUTPUTS).withColumn("score", F.col("score").cast("double"))
    return semantic.reference_results(rows, THRESHOLD)


def _judged(spark, sf):
    return semantic.resolve_cases(
        derive(spark, sf, SEMANTIC_CASES), _results(spark, sf), KEYS, THRESHOLD
    )


@R.add(
    "reference_judgements",
    f"""WITH {_RESULT_SQL} SELECT paper_id, question_id, reference_index, CASE WHEN good THEN 'success' ELSE 'judge_error' END AS status,
      CASE WHEN good THEN CAST(score AS DOUBLE) END AS semantic_score, CASE WHEN good THEN score >= {THRESHOLD} END AS passed,
      CASE WHEN error_type IS NOT NULL THEN error_type WHEN NOT good THEN 'ValueError' END AS error_type FROM result""",
)
def reference_judgements(spark, sf):
    return _results(spark, sf).select(*KEYS, "reference_index", "status", "semantic_score", "passed", "error_type")


@R.add(
    "case_judgements",
    f"""WITH {_RESULT_SQL} SELECT paper_id, question_id, status, semantic_score, passed, matched_reference_index, matched_answer_type, error_message FROM judged""",
)
def case_judgements(spark, sf):
    return _judged(spark, sf).select(
        *KEYS, "status", "semantic_score", "passed", "matched_reference_index", "matched_answer_type", "error_message"
    )


@R.add(
    "below_threshold_cases",
    f"WITH {_RESULT_SQL} SELECT paper_id, question_id, case_ordinal, semantic_score FROM judged WHERE semantic_score < {THRESHOLD}",
)
def below_threshold_cases(spark, sf):
    return dataset.below_threshold(derive(spark, sf, SEMANTIC_CASES), _judged(spark, sf), THRESHOLD).select(
        *KEYS, "case_ordinal", "semantic_score"
    )


@R.add(
    "selection_digest",
    f"""WITH {_RESULT_SQL}, f AS (SELECT * FROM judged WHERE semantic_score < {THRESHOLD}),
    k AS (SELECT floor((row_number() OVER (ORDER BY case_ordinal) - 1) / 10000) AS b, case_ordinal, concat(paper_id, '/', question_id) AS k FROM f),
    d AS (SELECT b, count(*) AS n, sha256(CAST(to_json(list(k ORDER BY case_ordinal)) AS STRING)) AS d FROM k GROUP BY b)
    SELECT CAST(coalesce(sum(n), 0) AS BIGINT) AS selected_case_count,
      sha256(CAST(to_json(coalesce(list(d ORDER BY b), [])) AS STRING)) AS ordered_case_key_blocks_sha256 FROM d""",
)
def selection_digest(spark, sf):
    return dataset.ordered_key_digest(
        dataset.below_threshold(derive(spark, sf, SEMANTIC_CASES), _judged(spark, sf), THRESHOLD)
    )


_TRANSPORT_COLUMNS = [*semantic.COUNT_FIELDS, *semantic.SECONDS_FIELDS, "retry_after_used", *semantic.ERROR_FIELDS]
_LAST_ERROR = "arg_max({c}, reference_index) FILTER (final_provider_error_category IS NOT NULL) AS {c}"
TRANSPORT_SQL = f"""transport AS (SELECT paper_id, question_id, {", ".join(f"CAST(sum({c}) AS BIGINT) AS {c}" for c in semantic.COUNT_FIELDS)},
  {", ".join(f"round(sum({c}), 6) AS {c}" for c in semantic.SECONDS_FIELDS)}, bool_or(retry_after_used) AS retry_after_used,
  {", ".join(_LAST_ERROR.replace("{c}", c) for c in semantic.ERROR_FIELDS)} FROM outputs GROUP BY ALL)"""


@R.add("case_transport", f"WITH {_RESULT_SQL}, {TRANSPORT_SQL} SELECT paper_id, question_id, {', '.join(_TRANSPORT_COLUMNS)} FROM transport")
def case_transport(spark, sf):
    return semantic.case_transport(_results(spark, sf), KEYS)


_SEM_SQL = f"""SELECT count(*) AS selected_case_count, count(*) FILTER (generation_status = 'success') AS successful_generation_count,
  count(*) FILTER (generation_status <> 'success') AS generation_error_count, count(*) FILTER (status = 'success') AS successful_judgment_count,
  count(*) FILTER (status = 'judge_error') AS judge_error_count, count(semantic_score) AS non_null_evaluated_case_count,
  round(count(semantic_score) / count(*), 9) AS evaluation_coverage, round(avg(semantic_score), 9) AS mean_semantic_correctness,
  round(count(*) FILTER (passed) / count(semantic_score), 9) AS pass_rate,
  CASE WHEN count(semantic_score) = count(*) THEN round(avg(semantic_score), 9) END AS full_run_semantic_correctness FROM judged"""


def semantic_metrics_row(spark, sf):
    return semantic.run_metrics(derive(spark, sf, SEMANTIC_CASES), _judged(spark, sf), KEYS)


@R.add("semantic_metrics", f"WITH {_RESULT_SQL} {_SEM_SQL}")
def semantic_metrics(spark, sf):
    m = semantic_metrics_row(spark, sf)
    rounded = ("evaluation_coverage", "mean_semantic_correctness", "pass_rate", "full_run_semantic_correctness")
    return m.select(*[F.round(c, 9).alias(c) if c in rounded else F.col(c) for c in m.columns])


@R.add(
    "semantic_bands",
    f"""WITH {_RESULT_SQL} SELECT b.band, count(j.s) AS n FROM (VALUES ('0-1', -1, 0.1), ('2-4', 0.1, 0.4), ('5-6', 0.4, 0.6), ('7-8', 0.6, 0.8), ('9-10', 0.8, 9)) b(band, lo, hi)
    LEFT JOIN (SELECT CAST(round(semantic_score, 6) AS DECIMAL(9, 6)) AS s FROM judged WHERE semantic_score IS NOT NULL) j ON j.s > b.lo AND j.s <= b.hi GROUP BY b.band""",
)
def semantic_bands(spark, sf):
    return semantic.band_counts(_judged(spark, sf))


_HISTORY = """
SELECT CAST(user_id AS STRING) AS paper_id, CAST(date_trunc('hour', ts) AS STRING) AS question_id, event_id AS line_no,
  CASE WHEN event_type IN ('error', 'click') THEN 'judge_error' WHEN event_type = 'signup' THEN 'generation_error' ELSE 'success' END AS status,
  event_id % 5 AS provider_attempt_count, event_id % 4 AS retry_count, event_id % 3 AS rate_limit_response_count, event_id % 2 AS rate_limit_retry_count,
  event_id % 7 AS other_transient_retry_count, event_id % 11 AS schema_output_retry_count, value AS pacing_sleep_seconds, value / 4 AS retry_backoff_sleep_seconds
FROM {events}"""
_HISTORY_SQL = f"""history AS ({plain(_HISTORY)}),
chosen AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY paper_id, question_id ORDER BY
  CASE status WHEN 'success' THEN 2 WHEN 'generation_error' THEN 1 ELSE 0 END DESC, line_no DESC) AS rn FROM history) WHERE rn = 1)"""


def _history(spark, sf):
    rows = derive(spark, sf, _HISTORY)
    return rows, attempts.latest(rows, KEYS, "line_no", attempts.JUDGE_TIERS)


@R.add(
    "judge_reliability",
    f"""WITH {_HISTORY_SQL} SELECT CAST(sum(provider_attempt_count) AS BIGINT) AS total_provider_attempts, count(*) FILTER (retry_count > 0) AS cases_requiring_retry_count,
      {", ".join(f"CAST(sum({c}) AS BIGINT) AS total_{c}" for c in semantic.COUNT_FIELDS[1:])},
      {", ".join(f"round(sum({c}), 4) AS total_{c}" for c in semantic.SECONDS_FIELDS)}, count(*) AS telemetry_covered_selected_case_count,
      count(*) FILTER (status = 'judge_error') AS unresolved_judge_error_count, (SELECT count(*) FROM history WHERE status = 'judge_error') AS historical_judge_error_attempt_count FROM chosen""",
)
def judge_reliability(spark, sf):
    rows, chosen = _history(spark, sf)
    r = semantic.reliability(chosen, rows)
    seconds = [f"total_{c}" for c in semantic.SECONDS_FIELDS]
    return r.select(*[F.round(c, 4).alias(c) if c in seconds else F.col(c) for c in r.columns])


@R.add(
    "judge_attempt_counters",
    f"""WITH {_HISTORY_SQL} SELECT (SELECT count(*) FROM history) AS score_attempt_records, (SELECT count(*) FROM history WHERE status = 'judge_error') AS judge_error_attempt_count,
      count(*) FILTER (status IN ('success', 'generation_error')) AS completed_resume_keys, count(*) FILTER (status = 'judge_error') AS unresolved_judge_error_count,
      count(*) FILTER (status = 'success') AS successful_judgments FROM chosen""",
)
def judge_attempt_counters(spark, sf):
    rows, chosen = _history(spark, sf)
    return attempts.counters(rows, chosen)


@R.add(
    "reference_totals",
    f"""WITH {_RESULT_SQL} SELECT CAST(sum(successful_references) AS BIGINT) AS successful_reference_judgment_count, CAST(sum(failed_references) AS BIGINT) AS reference_judgment_error_count,
      CAST(sum(reference_count) FILTER (generation_status = 'success') AS BIGINT) AS expected_reference_judgment_count, count(*) FILTER (matched_reference_index > 0) AS non_first_winning_reference_count FROM judged""",
)
def reference_totals(spark, sf):
    return semantic.reference_totals(_judged(spark, sf))


@R.add("reference_count_distribution", f"WITH {_RESULT_SQL} SELECT reference_count, count(*) AS cases FROM judged GROUP BY ALL")
def reference_count_distribution(spark, sf):
    return semantic.reference_count_distribution(_judged(spark, sf))


@R.add(
    "matched_answer_types",
    f"""WITH {_RESULT_SQL} SELECT t.answer_type, count(j.paper_id) AS cases FROM (VALUES ('extractive'), ('abstractive'), ('boolean'), ('none')) t(answer_type)
    LEFT JOIN judged j ON j.matched_answer_type = t.answer_type GROUP BY ALL""",
)
def matched_answer_types(spark, sf):
    return semantic.matched_type_counts(_judged(spark, sf))


_FAILURES = """
SELECT event_id, CASE event_type WHEN 'signup' THEN 'output' WHEN 'view' THEN 'timeout' WHEN 'click' THEN 'status' WHEN 'error' THEN 'connection' ELSE 'other' END AS kind,
  CASE event_id % 7 WHEN 0 THEN 429 WHEN 1 THEN 503 WHEN 2 THEN 400 WHEN 3 THEN 422 WHEN 4 THEN 404 END AS status,
  CASE event_id % 5 WHEN 0 THEN ' Invalid-JSON ' WHEN 1 THEN 'other' END AS error_type,
  CASE event_id % 3 WHEN 0 THEN 'json validate  failed' WHEN 1 THEN ' ' END AS error_code FROM {events}"""


@R.add(
    "request_failure_categories",
    f"""SELECT event_id, category, category NOT IN ('permanent_http', 'permanent_error') AS retryable FROM (SELECT event_id,
      CASE WHEN kind = 'output' THEN 'schema_output' WHEN status = 429 THEN 'rate_limit' WHEN kind = 'timeout' THEN 'timeout' WHEN kind = 'connection' THEN 'connection'
        WHEN status BETWEEN 500 AND 599 THEN 'transient_http' WHEN status IN (400, 422) AND (event_id % 5 = 0 OR event_id % 3 = 0) THEN 'schema_output'
        WHEN status IS NOT NULL OR kind = 'status' THEN 'permanent_http' ELSE 'permanent_error' END AS category FROM ({plain(_FAILURES)}))""",
)
def request_failure_categories(spark, sf):
    rows = derive(spark, sf, _FAILURES)
    category = semantic.failure_category(F.col("kind"), F.col("status"), F.col("error_type"), F.col("error_code"))
    return rows.select("event_id", category.alias("category"), semantic.is_retryable(category).alias("retryable"))


# Cumulative counters of each user's event stream, one snapshot per event.
_SNAPSHOTS = """
SELECT user_id AS judge_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS snapshot_no,
  sum(CASE WHEN event_type = 'error' THEN 2 ELSE 1 END) OVER (PARTITION BY user_id ORDER BY event_id) AS attempts,
  sum(CASE WHEN event_type = 'error' THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY event_id) AS retries, event_type FROM {events}"""


def _snapshots(spark, sf):
    """Cumulative counters built with block-wise running totals."""
    from docquarry.functions import ordered

    rows = table(spark, sf, "events").select(F.col("user_id").alias("judge_id"), "event_id", "event_type")
    errors = F.col("event_type") == "error"
    amounts = {"snapshot_no": F.lit(1), "attempts": F.when(errors, 2).otherwise(1), "retries": errors.cast("int")}
    totals = {name: ordered.Total(amount, inclusive=True) for name, amount in amounts.items()}
    return ordered.running(rows, ["judge_id"], "event_id", totals, levels=2)


@R.add(
    "telemetry_deltas",
    f"""SELECT judge_id, snapshot_no, CAST(attempts - coalesce(lag(attempts) OVER w, 0) AS BIGINT) AS attempts_delta, CAST(retries - coalesce(lag(retries) OVER w, 0) AS BIGINT) AS retries_delta
    FROM ({plain(_SNAPSHOTS)}) WINDOW w AS (PARTITION BY judge_id ORDER BY snapshot_no)""",
)
def telemetry_deltas(spark, sf):
    return semantic.snapshot_deltas(_snapshots(spark, sf), ["judge_id"], "snapshot_no", ["attempts", "retries"])


@R.add(
    "failure_category_deltas",
    """SELECT conv_id AS judge_id, turn AS snapshot_no, role AS category, 1 AS total_delta FROM conversations WHERE role <> 'system'""",
)
def failure_category_deltas(spark, sf):
    """Messages per role so far are cumulative category totals at each turn."""
    from docquarry.functions import ordered

    turns = table(spark, sf, "conversations").select(F.col("conv_id").alias("judge_id"), F.col("turn").alias("snapshot_no"), "role")
    roles = ("user", "assistant")
    so_far = {r: ordered.Total((F.col("role") == r).cast("int"), inclusive=True) for r in roles}
    counted = ordered.running(turns, ["judge_id"], "snapshot_no", so_far)
    cells = F.array(*[F.struct(F.lit(r).alias("category"), F.col(r).alias("total")) for r in roles])
    totals = counted.select("judge_id", "snapshot_no", F.inline(cells))
    deltas = semantic.category_deltas(totals, ["judge_id"], "snapshot_no", "category", "total")
    return deltas.withColumn("total_delta", F.col("total_delta").cast("int"))


# --- checker comparison -----------------------------------------------------------------------------

_RAW_RESULTS = """
SELECT source AS paper_id, concat('q', CAST(d.doc_id AS STRING)) AS question_id, m.model_id,
  CASE WHEN m.model_id = 'A' THEN CASE quality WHEN 1 THEN 'high' ELSE 'low' END
    ELSE CASE WHEN d.doc_id % 9 = 0 THEN 'odd' WHEN toxic = 1 THEN 'medium' WHEN d.doc_id % 4 = 0 THEN 'low' ELSE 'high' END END AS relevance_label,
  CASE WHEN d.doc_id % 23 = 0 THEN CAST('NaN' AS DOUBLE) WHEN d.doc_id % 29 = 0 THEN CAST(1.5 AS DOUBLE) ELSE CAST(quality / 2.0 AS DOUBLE) END AS relevance_score,
  CASE WHEN d.doc_id % 31 = 0 THEN ' ' WHEN d.doc_id % 29 = 0 THEN 'token=abc failed' ELSE 'fits' END AS relevance_explanation,
  CASE WHEN d.doc_id % 6 = 0 THEN NULL WHEN d.doc_id % 37 = 0 THEN CAST(-1 AS DOUBLE) ELSE CAST(n_chars / 1000.0 AS DOUBLE) END AS relevance_latency,
  CASE WHEN m.model_id = 'A' THEN CASE toxic WHEN 1 THEN 'not_grounded' ELSE 'grounded' END
    ELSE CASE d.doc_id % 5 WHEN 0 THEN NULL WHEN 1 THEN 'partially_grounded' ELSE 'grounded' END END AS groundedness_label,
  'fits' AS groundedness_explanation, CASE WHEN d.doc_id % 4 = 0 THEN NULL ELSE CAST(n_chars / 2000.0 AS DOUBLE) END AS groundedness_latency
FROM {documents} d JOIN {labels} l ON l.doc_id = d.doc_id JOIN (VALUES ('A'), ('B')) AS m(model_id) ON m.model_id = 'A' OR l.quality = 1"""
_R_OK = """coalesce(relevance_label IN ('high', 'medium', 'low'), false) AND relevance_score IS NOT NULL AND isfinite(relevance_score) AND relevance_score BETWEEN 0 AND 1
  AND trim(relevance_explanation) <> '' AND coalesce(relevance_latency >= 0, true)"""
_G_OK = "coalesce(groundedness_label IN ('grounded', 'partially_grounded', 'not_grounded'), false)"
_ROWS_SQL = f"""raw AS ({plain(_RAW_RESULTS)}),
problem AS (SELECT *, CASE WHEN NOT ({_R_OK}) THEN CASE trim(relevance_explanation) WHEN '' THEN '{comparison.UNUSABLE['relevance']}'
    WHEN 'fits' THEN 'fits' ELSE 'token=<redacted> failed' END END AS rp, CASE WHEN NOT ({_G_OK}) THEN 'fits' END AS gp FROM raw),
rows_ AS (SELECT paper_id, question_id, model_id, relevance_label, coalesce(groundedness_label, 'unknown') AS groundedness_label, relevance_latency, groundedness_latency,
  CASE WHEN rp IS NULL THEN relevance_score END AS relevance_score, nullif(concat_ws('; ', rp, gp), '') AS error,
  CASE WHEN rp IS NULL AND gp IS NULL THEN 'success' ELSE 'error' END AS status FROM problem)"""


# The last one has no results.
MODELS = ("A", "B", "silent")


def _rows(spark, sf):
    return comparison.result_rows(derive(spark, sf, _RAW_RESULTS))


def _selected(spark, sf):
    return table(spark, sf, "documents").agg(F.count("*")).scalar()


@R.add(
    "checker_results",
    f"WITH {_ROWS_SQL} SELECT paper_id, question_id, model_id, status, error, relevance_label, groundedness_label, relevance_score FROM rows_",
)
def checker_results(spark, sf):
    return _rows(spark, sf).select(
        *KEYS, "model_id", "status", "error", "relevance_label", "groundedness_label", "relevance_score"
    )


@R.add(
    "checker_comparison",
    f"""WITH {_ROWS_SQL}, c AS (SELECT model_id, count(*) AS result_count, count(*) FILTER (status = 'success') AS successful_result_count,
      count(*) FILTER (status <> 'success') AS error_result_count, count(*) FILTER (relevance_label IN ('high', 'medium', 'low') AND relevance_score IS NOT NULL) AS relevance_valid_result_count,
      count(*) FILTER (groundedness_label <> 'unknown') AS groundedness_valid_result_count FROM rows_ GROUP BY model_id),
    f AS (SELECT model_id, coalesce(result_count, 0) AS result_count, coalesce(successful_result_count, 0) AS successful_result_count,
      coalesce(error_result_count, 0) AS error_result_count, coalesce(relevance_valid_result_count, 0) AS relevance_valid_result_count,
      coalesce(groundedness_valid_result_count, 0) AS groundedness_valid_result_count
      FROM (VALUES ('A'), ('B'), ('silent')) m(model_id) LEFT JOIN c USING (model_id))
    SELECT *, round(result_count / (SELECT count(*) FROM documents), 9) AS result_coverage, round(relevance_valid_result_count / (SELECT count(*) FROM documents), 9) AS relevance_valid_result_rate,
      round(groundedness_valid_result_count / (SELECT count(*) FROM documents), 9) AS groundedness_valid_result_rate FROM f""",
)
def checker_comparison(spark, sf):
    m = comparison.per_model(_rows(spark, sf), _selected(spark, sf), MODELS)
    return m.select(*[F.round(c, 9).alias(c) if c.endswith(("coverage", "rate")) else F.col(c) for c in m.columns])


@R.add(
    "checker_label_distribution",
    f"""WITH {_ROWS_SQL}, m AS (SELECT model_id FROM (VALUES ('A'), ('B'), ('silent')) v(model_id)), d AS (SELECT unnest(['high', 'medium', 'low', 'unknown', 'missing']) AS label)
    SELECT m.model_id, d.label, CASE WHEN d.label = 'missing' THEN greatest(0, (SELECT count(*) FROM documents) - (SELECT count(*) FROM rows_ r WHERE r.model_id = m.model_id))
      ELSE (SELECT count(*) FROM rows_ r WHERE r.model_id = m.model_id AND CASE WHEN r.relevance_label IN ('high', 'medium', 'low') THEN r.relevance_label ELSE 'unknown' END = d.label) END AS n FROM m, d""",
)
def checker_label_distribution(spark, sf):
    return comparison.label_distribution(
        _rows(spark, sf), "relevance_label", RELEVANCE_LABELS, _selected(spark, sf), MODELS
    )


_PAIR_SQL = """pair AS (SELECT a.paper_id, a.question_id, a.relevance_label AS lr, b.relevance_label AS rr, a.groundedness_label AS lg, b.groundedness_label AS rg
  FROM rows_ a JOIN rows_ b USING (paper_id, question_id) WHERE a.model_id = 'A' AND b.model_id = 'B')"""


def _pairs(spark, sf, column, labels):
    return comparison.paired(_rows(spark, sf), KEYS, ("A", "B"), column, labels)


@R.add(
    "checker_agreement",
    f"""WITH {_ROWS_SQL}, {_PAIR_SQL} SELECT count(*) AS eligible_case_count, count(*) FILTER (lr = rr) AS agreement_count,
      round(count(*) FILTER (lr = rr) / count(*), 9) AS agreement_rate FROM pair WHERE rr <> 'odd'""",
)
def checker_agreement(spark, sf):
    a = comparison.agreement(_pairs(spark, sf, "relevance_label", RELEVANCE_LABELS))
    return a.withColumn("agreement_rate", F.round("agreement_rate", 9))


@R.add(
    "checker_disagreements",
    f"WITH {_ROWS_SQL}, {_PAIR_SQL} SELECT paper_id, question_id, lg AS left_label, rg AS right_label FROM pair WHERE rg <> 'unknown' AND lg <> rg",
)
def checker_disagreements(spark, sf):
    return comparison.disagreements(_pairs(spark, sf, "groundedness_label", GROUNDEDNESS_LABELS))


@R.add(
    "checker_disagreement_cases",
    f"""WITH {_ROWS_SQL}, {_PAIR_SQL} SELECT paper_id, question_id FROM pair WHERE rr <> 'odd' AND lr <> rr
    UNION SELECT paper_id, question_id FROM pair WHERE rg <> 'unknown' AND lg <> rg""",
)
def checker_disagreement_cases(spark, sf):
    return comparison.disagreement_cases(
        _pairs(spark, sf, "relevance_label", RELEVANCE_LABELS),
        _pairs(spark, sf, "groundedness_label", GROUNDEDNESS_LABELS),
        keys=KEYS,
    )


@R.add(
    "checker_latency",
    f"""WITH {_ROWS_SQL}, l AS (SELECT model_id, 'relevance' AS part, relevance_latency AS v FROM rows_ UNION ALL SELECT model_id, 'groundedness', groundedness_latency FROM rows_
      UNION ALL SELECT model_id, 'combined', coalesce(relevance_latency, 0) + coalesce(groundedness_latency, 0) FROM rows_ WHERE coalesce(relevance_latency, groundedness_latency) IS NOT NULL)
    SELECT model_id, part, count(v) AS n, round(avg(v), 6) AS mean, round(median(v), 6) AS median, round(max(v), 6) AS maximum
    FROM (VALUES ('A'), ('B'), ('silent')) m(model_id) CROSS JOIN (VALUES ('relevance'), ('groundedness'), ('combined')) p(part)
    LEFT JOIN (SELECT * FROM l WHERE v >= 0) USING (model_id, part) GROUP BY ALL""",
)
def checker_latency(spark, sf):
    s = comparison.latency_summaries(_rows(spark, sf), MODELS)
    return s.select("model_id", "part", "n", *[F.round(c, 6).alias(c) for c in ("mean", "median", "maximum")])


@R.add(
    "model_order",
    """SELECT doc_id, k AS model_position, CASE WHEN doc_id % 2 = 0 THEN k + 1 ELSE 2 - k END AS order_position
    FROM documents JOIN (VALUES (0), (1)) m(k) ON k < 2""",
)
def model_order(spark, sf):
    rows = derive(spark, sf, "SELECT doc_id, k FROM {documents} JOIN (VALUES (0), (1)) AS m(k) ON k < 2")
    return rows.select(
        "doc_id", F.col("k").alias("model_position"), comparison.model_order(F.col("doc_id"), F.col("k"), 2).alias("order_position")
    )


@R.add(
    "comparison_run_status",
    f"""WITH {_ROWS_SQL} SELECT count(*) AS results, count(*) FILTER (status <> 'success') AS errors, 2 * (SELECT count(*) FROM documents) AS expected,
      CASE WHEN count(*) <> 2 * (SELECT count(*) FROM documents) THEN 'incomplete' WHEN count(*) FILTER (status <> 'success') > 0 THEN 'complete_with_errors' ELSE 'complete' END AS run_status FROM rows_""",
)
def comparison_run_status(spark, sf):
    return comparison.run_status(_rows(spark, sf), _selected(spark, sf) * 2)


# --- report ------------------------------------------------------------------------------------------


def _diagnostics(spark, sf):
    return report.case_diagnostics(matched_cases(spark, sf), KEYS)


_TRIAGE_SQL = f"""{_RESULT_SQL}, {MATCH_SQL}, ans AS ({plain(_ANSWERS)}),
flags AS (SELECT a.paper_id, a.question_id, a.case_ordinal, list_filter([
    CASE WHEN a.status = 'error' THEN 0 END, CASE WHEN j.status = 'judge_error' THEN 1 END, CASE WHEN j.status <> 'judge_error' AND j.passed = false THEN 2 END,
    CASE WHEN groundedness = 'not_grounded' THEN 3 END, CASE WHEN groundedness = 'partially_grounded' THEN 4 END, CASE WHEN groundedness = 'unknown' THEN 5 END,
    CASE WHEN relevance = 'low' THEN 6 END, CASE WHEN relevance = 'unknown' THEN 7 END], lambda x: x IS NOT NULL) AS codes
  FROM ans a LEFT JOIN judged j USING (paper_id, question_id) LEFT JOIN diag d USING (paper_id, question_id))"""


def _triage(spark, sf):
    judged = _judged(spark, sf).select(*KEYS, F.col("status").alias("judge_status"), "passed")
    answers = derive(spark, sf, _ANSWERS).select(*KEYS, "case_ordinal", "status")
    return report.triage(answers, judged, _diagnostics(spark, sf), KEYS)


@R.add(
    "case_issues",
    f"""WITH {_TRIAGE_SQL} SELECT paper_id, question_id, CAST(coalesce(list_min(codes), 99) AS INT) AS severity,
      array_to_string([[{", ".join(f"'{i}'" for i in report.ISSUES)}][c + 1] for c in codes], '|') AS issues FROM flags""",
)
def case_issues(spark, sf):
    return _triage(spark, sf).select(*KEYS, "severity", F.array_join("issues", "|").alias("issues"))


@R.add(
    "attention_list",
    f"WITH {_TRIAGE_SQL} SELECT paper_id, question_id, case_ordinal, CAST(list_min(codes) AS INT) AS severity FROM flags WHERE len(codes) > 0",
)
def attention_list(spark, sf):
    return report.attention(_triage(spark, sf)).drop("issues")


def _readiness_input(spark, sf):
    m = semantic_metrics_row(spark, sf)
    f1 = f1_metrics(spark, sf)
    matched = matched_cases(spark, sf)
    labels = _diagnostics(spark, sf)
    either = lambda x: (F.col("relevance") == x).cast("int") + (F.col("groundedness") == x).cast("int")
    return report.one_row(
        f1.select(
            F.lit(False).alias("is_subset"),
            F.col("evaluated_cases").alias("selected"),
            F.col("successful_predictions").alias("succeeded"),
            F.col("answer_f1").isNotNull().alias("f1_available"),
            F.round("answer_f1", 6).alias("answer_f1"),
        ),
        m.select(
            F.col("selected_case_count").alias("semantic_selected"),
            F.round("evaluation_coverage", 9).alias("semantic_coverage"),
            F.col("judge_error_count").alias("judge_errors"),
        ),
        matched.agg(
            F.count_if(F.col("log_match") == "matched").alias("log_matched"),
            F.count_if(F.col("log_match") == "duplicate").alias("log_duplicates"),
        ),
        labels.agg(
            F.sum(either("unknown")).alias("unknown_labels"), F.sum(either("missing")).alias("missing_labels")
        ),
    )


@R.add(
    "run_summary",
    f"""WITH {_RESULT_SQL}, {MATCH_SQL}, {_F1_SQL}, f AS ({F1_METRICS_SQL}), s AS ({_SEM_SQL})
    SELECT false AS is_subset, evaluated_cases AS selected, successful_predictions AS succeeded, true AS f1_available, round(answer_f1, 6) AS answer_f1,
      selected_case_count AS semantic_selected, evaluation_coverage AS semantic_coverage, judge_error_count AS judge_errors,
      (SELECT count(*) FROM matched WHERE log_rows = 1) AS log_matched, (SELECT count(*) FROM matched WHERE log_rows > 1) AS log_duplicates,
      CAST((SELECT count_if(relevance = 'unknown') + count_if(groundedness = 'unknown') FROM diag) AS BIGINT) AS unknown_labels,
      CAST((SELECT count_if(relevance = 'missing') + count_if(groundedness = 'missing') FROM diag) AS BIGINT) AS missing_labels, 'not_ready' AS readiness FROM f, s""",
)
def run_summary(spark, sf):
    return report.readiness(_readiness_input(spark, sf))

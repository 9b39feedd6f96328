"""Telemetry records, redaction and log analytics."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as T

from docquarry.functions import digest, redact
from docquarry.operators import report, rerank, telemetry
from docquarry.operators.checks import GROUNDEDNESS_LABELS, RELEVANCE_LABELS
from docquarry.session import scratch_dir, spread
from docquarry.sources import jsonl
from workload.ingestion import strip_sql, WS
from workload.retrieval import CHUNKS, PARAMS, hybrid_ctes, run_hybrid
from workload.tables import Registry, derive, plain, table

R = Registry()

# Every event is one logged request.
EVENT_LOGS = """
SELECT event_id, concat('u', CAST(user_id AS STRING)) AS conversation_id,
  CASE event_type WHEN 'signup' THEN 'High' WHEN 'view' THEN 'unknown' WHEN 'click' THEN 'retrieval-low'
    WHEN 'error' THEN 'Unknown' ELSE 'medium' END AS relevance_label,
  CASE event_id % 9 WHEN 0 THEN 'Error 429: tokens per day reached' WHEN 1 THEN 'HTTP 429 TPM limit for org_abc1'
    WHEN 2 THEN 'Invalid context-score count' WHEN 3 THEN 'could not parse JSON' WHEN 4 THEN 'Request timed out'
    WHEN 5 THEN 'Connection reset by ada@example.org' WHEN 6 THEN NULL WHEN 7 THEN 'see /home/ada/x, or C:\\\\temp\\\\y'
    ELSE props END AS relevance_explanation,
  CASE event_type WHEN 'signup' THEN 'grounded' WHEN 'view' THEN 'answer not grounded' WHEN 'click' THEN ' '
    WHEN 'error' THEN 'unknown' ELSE 'partially grounded' END AS groundedness_label,
  CASE event_id % 4 WHEN 0 THEN 'schema mismatch' WHEN 1 THEN 'Bearer abc.def-1 sent' WHEN 2 THEN 'connect error gsk_Zz9_8'
    ELSE 'fine' END AS groundedness_explanation,
  value AS total_seconds, CASE WHEN event_type = 'error' THEN NULL ELSE value / 2 END AS dense_seconds,
  value / 100 AS rerank_seconds, CAST(event_id % 1000 AS BIGINT) AS total_tokens
FROM {events}"""
# DuckDB literals keep backslashes as they are; Spark's read \\\\ as one.
EVENT_LOGS_SQL = plain(EVENT_LOGS).replace("\\\\", "\\")


def nested(flat):
    """Flat log columns as the nested request record."""
    none = F.lit(None).cast("double")
    return flat.select(
        *[c for c in ("event_id", "conversation_id") if c in flat.columns],
        F.struct(
            F.struct(
                "total_seconds",
                "dense_seconds",
                none.alias("bm25_seconds"),
                none.alias("fusion_seconds"),
                "rerank_seconds",
            ).alias("latency"),
            F.col("relevance_label").alias("retrieval_relevance"),
            "relevance_explanation",
            none.alias("retrieval_eval_latency"),
        ).alias("retrieval"),
        F.struct(
            "groundedness_label",
            "groundedness_explanation",
            (F.col("total_seconds") / 4).alias("groundedness_eval_latency"),
        ).alias("generation"),
        F.struct("total_tokens", F.col("rerank_seconds").alias("latency_seconds")).alias("llm_metrics"),
    )


def event_logs(spark, sf):
    return nested(derive(spark, sf, EVENT_LOGS))


# --- records ---------------------------------------------------------------------------


def _source_chunks(spark, sf):
    return derive(spark, sf, CHUNKS).select(
        "chunk_id",
        "doc_id",
        F.col("source").alias("source_name"),
        F.lit(1).alias("page"),
        F.lit("pdf").alias("file_type"),
        F.lit("pdf").alias("doc_type"),
        F.lit(None).cast("string").alias("section_header"),
        "text",
    )


def _preview(n):
    body = strip_sql("d.text")
    return f"CASE WHEN length({body}) <= {n} THEN {body} ELSE concat(substr({body}, 1, {n}), '... [truncated]') END"


@R.add(
    "final_source_rows",
    f"""WITH {hybrid_ctes()} SELECT query_id, CAST(rank AS INT) AS rank, chunk_id AS doc_id, source AS file_name, chunk_id, 1 AS page,
      round(distance, 6) AS distance, round(1 / (1 + distance), 6) AS similarity, round(fusion_score, 6) AS fusion_score,
      {_preview(500)} AS content_preview, 'pdf' AS file_type, 'pdf' AS doc_type, CAST(NULL AS STRING) AS section_header,
      round(rerank_score, 6) AS rerank_score FROM final f JOIN documents d ON CAST(d.doc_id AS STRING) = f.chunk_id""",
)
def final_source_rows(spark, sf):
    h = run_hybrid(spark, sf)
    return telemetry.source_rows(
        h.final,
        _source_chunks(spark, sf),
        telemetry.FINAL_PREVIEW,
        questions=h.questions,
        per_question=h.params.rerank_top_k,
    )


@R.add(
    "raw_source_rows",
    f"""WITH {hybrid_ctes()} SELECT query_id, CAST(fusion_rank AS INT) AS rank, chunk_id AS doc_id, source AS file_name, chunk_id, 1 AS page,
      round(distance, 6) AS distance, round(1 / (1 + distance), 6) AS similarity, round(fusion_score, 6) AS fusion_score,
      {_preview(300)} AS content_preview, 'pdf' AS file_type, 'pdf' AS doc_type, CAST(NULL AS STRING) AS section_header
    FROM fused f JOIN documents d ON CAST(d.doc_id AS STRING) = f.chunk_id""",
)
def raw_source_rows(spark, sf):
    h = run_hybrid(spark, sf)
    return telemetry.source_rows(
        h.fused.withColumnRenamed("fusion_rank", "rank"),
        _source_chunks(spark, sf),
        telemetry.RAW_PREVIEW,
        questions=h.questions,
        per_question=2 * h.params.top_n,
    )


@R.add(
    "request_records",
    f"""WITH {hybrid_ctes()} SELECT w.query_id, route, round(alpha, 4) AS fusion_alpha,
      (SELECT count(*) FROM fused f WHERE f.query_id = w.query_id) AS num_fusion_survivors,
      least((SELECT count(*) FROM fused f WHERE f.query_id = w.query_id), {PARAMS.rerank_candidates}) AS num_reranker_candidates,
      (SELECT chunk_id FROM fused f WHERE f.query_id = w.query_id AND fusion_rank = 1) AS first_raw_chunk,
      (SELECT chunk_id FROM final f WHERE f.query_id = w.query_id AND rank = 2) AS second_final_chunk,
      (SELECT round(max(CASE WHEN rank = 1 THEN rerank_score END) - max(CASE WHEN rank = 2 THEN rerank_score END), 6) FROM final f WHERE f.query_id = w.query_id) AS rerank_margin,
      (SELECT count(*) FROM final f WHERE f.query_id = w.query_id) AS num_final_sources FROM weighted w""",
)
def request_records(spark, sf):
    h = run_hybrid(spark, sf, share=True)
    chunks = _source_chunks(spark, sf)
    number = lambda v: F.lit(v).cast("double")
    requests = h.questions.select(
        F.lit("2024-01-01T00:00:00").alias("timestamp"),
        F.concat(F.lit("c"), F.col("query_id").cast("string")).alias("conversation_id"),
        "query_id",
        F.lit("multi").alias("kb_mode"),
        F.array(F.lit("all")).alias("active_doc_names"),
        F.col("question").alias("original_query"),
        F.col("question").alias("rewritten_query"),
        F.col("route").alias("retrieval_route"),
        F.col("alpha").alias("fusion_alpha"),
        F.lit(h.params.top_n).alias("retrieval_top_n"),
        F.lit(h.params.rerank_candidates).alias("rerank_candidate_n"),
        F.lit(h.params.rerank_top_k).alias("rerank_top_k"),
        F.lit(h.params.fusion_threshold).alias("fusion_threshold"),
        *[
            number(0.25).alias(f"{c}_latency")
            for c in ("retrieval", "dense", "bm25", "fusion", "rerank", "retrieval_eval", "groundedness_eval", "llm")
        ],
        F.lit("high").alias("retrieval_relevance"),
        number(0.9).alias("relevance_score"),
        F.lit("fits").alias("relevance_explanation"),
        F.lit("answer").alias("answer"),
        F.lit("grounded").alias("groundedness_label"),
        F.lit("fits").alias("groundedness_explanation"),
        F.lit(7).cast("long").alias("total_tokens"),
    )
    raw = telemetry.source_rows(
        h.fused.withColumnRenamed("fusion_rank", "rank"),
        chunks,
        telemetry.RAW_PREVIEW,
        questions=h.questions,
        per_question=2 * h.params.top_n,
    )
    final = telemetry.source_rows(
        h.final,
        chunks,
        telemetry.FINAL_PREVIEW,
        questions=h.questions,
        per_question=h.params.rerank_top_k,
    )
    records = telemetry.request_records(requests, raw, final, rerank.margin(h.final))
    at = lambda name, i: F.get(F.col(f"retrieval.{name}"), F.lit(i))["chunk_id"]
    long = lambda c: F.col(f"retrieval.{c}").cast("long").alias(c)
    return records.select(
        "query_id",
        F.col("retrieval.route").alias("route"),
        F.col("retrieval.fusion_alpha").alias("fusion_alpha"),
        long("num_fusion_survivors"),
        long("num_reranker_candidates"),
        at("raw_retrieval", 0).alias("first_raw_chunk"),
        at("final_sources", 1).alias("second_final_chunk"),
        F.col("retrieval.rerank_margin").alias("rerank_margin"),
        long("num_final_sources"),
    )


_LAT = telemetry._LATENCIES
_FLAT = f"""
SELECT event_id AS request_id, CAST(event_id AS STRING) AS timestamp,
  CASE event_id % 3 WHEN 0 THEN 'single' WHEN 1 THEN 'multi' ELSE 'other' END AS kb_mode,
  CASE event_id % 4 WHEN 0 THEN 'keyword' WHEN 1 THEN 'semantic' WHEN 2 THEN 'balanced' ELSE props END AS retrieval_route,
  value / 7 AS fusion_alpha, CAST(30 AS INT) AS retrieval_top_n, CAST(event_id % 40 AS INT) AS rerank_candidate_n,
  CAST(10 AS INT) AS rerank_top_k,
  CASE WHEN event_id % 50 = 7 THEN CAST('NaN' AS DOUBLE) WHEN event_id % 50 = 8 THEN CAST('Infinity' AS DOUBLE) ELSE value / 11 END AS fusion_threshold,
  event_id % 60 AS num_fusion_survivors, event_id % 11 AS num_final_sources,
  event_type AS retrieval_relevance, CASE WHEN event_type = 'error' THEN NULL ELSE value / 13 END AS relevance_score,
  CASE event_id % 5 WHEN 0 THEN 'grounded' WHEN 1 THEN 'not_grounded' ELSE event_type END AS groundedness_label,
  {", ".join(f"value / {p} AS {c}" for p, c in zip((17, 19, 23, 29, 31, 37, 41, 43), _LAT))},
  CASE WHEN event_id % 50 = 9 THEN NULL ELSE value END AS total_tokens
FROM {{events}}"""


def _keep(expr, name):
    return f"CASE WHEN NOT broken THEN {expr} END AS {name}"


@R.add(
    "privacy_events",
    f"""SELECT request_id, CASE WHEN broken THEN 'rag_telemetry_error' ELSE 'rag_request_completed' END AS event,
      {_keep('timestamp', 'timestamp')},
      {_keep("CASE WHEN kb_mode IN ('single', 'multi') THEN kb_mode ELSE 'unknown' END", 'kb_mode')},
      {_keep("CASE WHEN retrieval_route IN ('keyword', 'semantic', 'balanced') THEN retrieval_route ELSE 'unknown' END", 'retrieval_route')},
      {_keep('round(fusion_alpha, 4)', 'fusion_alpha')}, {_keep('CAST(retrieval_top_n AS BIGINT)', 'retrieval_top_n')},
      {_keep('CAST(rerank_candidate_n AS BIGINT)', 'rerank_candidate_n')}, {_keep('CAST(rerank_top_k AS BIGINT)', 'rerank_top_k')},
      {_keep('round(fusion_threshold, 4)', 'fusion_threshold')}, {_keep('num_fusion_survivors', 'num_fusion_survivors')},
      {_keep('least(num_fusion_survivors, rerank_candidate_n)', 'num_reranker_candidates')}, {_keep('num_final_sources', 'num_final_sources')},
      {_keep("'unknown'", 'retrieval_relevance')}, {_keep('round(relevance_score, 4)', 'relevance_score')},
      {_keep("CASE WHEN groundedness_label IN ('grounded', 'not_grounded') THEN groundedness_label ELSE 'unknown' END", 'groundedness_label')},
      {", ".join(_keep(f'round({c}, 4)', c) for c in _LAT)}, {_keep('CAST(trunc(total_tokens) AS BIGINT)', 'total_tokens')}
    FROM (SELECT *, NOT isfinite(fusion_threshold) AS broken FROM ({plain(_FLAT)}))""",
)
def privacy_events(spark, sf):
    return telemetry.privacy_events(derive(spark, sf, _FLAT))


_RUN = "SELECT DISTINCT concat('u', CAST(user_id AS STRING)) AS conversation_id FROM {events} WHERE event_type = 'purchase' AND value > 150"


@R.add(
    "run_log_rows",
    f"SELECT event_id, conversation_id FROM ({EVENT_LOGS_SQL}) WHERE conversation_id IN ({plain(_RUN)})",
)
def run_log_rows(spark, sf):
    logs = derive(spark, sf, EVENT_LOGS).select("event_id", "conversation_id")
    return telemetry.of_run(logs, derive(spark, sf, _RUN)).select("event_id", "conversation_id")


# --- redaction ------------------------------------------------------------------------------

# Each document with one secret of every kind behind it.
_SECRETS = """
SELECT doc_id, concat(text, ' key GSK_a-b_', CAST(doc_id AS STRING), '; bearer tok.en/', CAST(doc_id AS STRING),
  ' org_Team-', CAST(doc_id AS STRING), ', mail a.b+c@mail.example.org; https://console.groq.com/keys?id=', CAST(doc_id AS STRING),
  ' at D:/work/x y, then /home/u', CAST(doc_id AS STRING), '/notes; x/tmp/keep') AS text FROM {documents}"""
# RE2 has no look-behind and ASCII word boundaries only.
_W = r"\p{L}\p{N}_"
_LOG_RULES = (
    (rf"(^|[^{_W}])(?i:gsk_[a-z0-9_-]*[a-z0-9_])", r"\1<redacted>"),
    (rf"(^|[^{_W}])(?i:bearer)[{WS}]+[^{WS}]+", r"\1Bearer <redacted>"),
    (rf"(^|[^{_W}])(?i:org_[a-z0-9_-]*[a-z0-9_])", r"\1<redacted-organization>"),
    (rf"[{_W}][{_W}.+-]*@[{_W}.-]+\.[A-Za-z]{{2,}}", "<redacted-email>"),
    (rf"(?i)https?://(?:console\.)?groq\.com/[^{WS}]*", "<redacted-provider-url>"),
    (rf"(^|[^{_W}])[A-Za-z]:[\\/][^\r\n,;]+", r"\1<redacted-path>"),
    (rf"(^|[^{_W}])/(?:home|Users|tmp)/[^\r\n,;]+", r"\1<redacted-path>"),
)


def _rules_sql(x, rules):
    for pattern, replacement in rules:
        x = f"regexp_replace({x}, '{pattern}', '{replacement}', 'g')"
    return x


@R.add(
    "redacted_texts",
    f"SELECT doc_id, {_rules_sql('text', _LOG_RULES)} AS text FROM ({plain(_SECRETS)})",
)
def redacted_texts(spark, sf):
    return spread(derive(spark, sf, _SECRETS)).select(
        "doc_id", redact.log_explanation(F.col("text")).alias("text")
    )


_ERRORS = """
SELECT doc_id, concat(chr(10), text, chr(9), ' in /srv/app/x.py C:\\\\Users\\\\ada\\\\a b D:/k/l; api_key = s', CAST(doc_id AS STRING),
  ' Token:t1 authorization=Basic') AS text FROM {documents}"""
_ERROR_RULES = (
    (r"(?i)[A-Z]:\\Users\\[^\\" + WS + r"]+(?:\\[^" + WS + r",;]+)*", "<redacted-path>"),
    (r"(^|[^A-Za-z0-9])[A-Za-z]:[\\/][^" + WS + r",;]+", r"\1<redacted-path>"),
    (rf"(^|[^{_W}])(?i:gsk_[a-z0-9_-]*[a-z0-9_])", r"\1<redacted>"),
    (rf"(^|[^{_W}])(?i:bearer)[{WS}]+[^{WS}]+", r"\1Bearer <redacted>"),
    (rf"(^|[^{_W}])((?i:api[_-]?key|authorization|token))([{WS}]*[:=][{WS}]*)([^{WS}]+)", r"\1\2\3<redacted>"),
)


@R.add(
    "sanitized_errors",
    f"""SELECT doc_id, substr({_rules_sql(f"replace({strip_sql(f'''regexp_replace(text, '[{WS}]+', ' ', 'g')''')}, '/srv/app', '<repository_root>')", _ERROR_RULES)}, 1, 1000) AS error
    FROM ({plain(_ERRORS).replace(chr(92) * 2, chr(92))})""",
)
def sanitized_errors(spark, sf):
    return spread(derive(spark, sf, _ERRORS)).select(
        "doc_id", redact.error_message(F.col("text"), "/srv/app").alias("error")
    )


_CAUSE = """CASE WHEN contains(x, '429') AND (contains(x, 'tokens per day') OR contains(x, 'tpd')) THEN 'rate_limit_tpd'
  WHEN contains(x, '429') AND (contains(x, 'tokens per minute') OR contains(x, 'tpm')) THEN 'rate_limit_tpm'
  WHEN contains(x, 'invalid context-score') OR contains(x, 'invalid context score') OR contains(x, 'malformed') OR contains(x, 'schema')
    OR contains(x, 'could not parse') OR contains(x, 'parse failure') THEN 'malformed_output'
  WHEN contains(x, 'timeout') OR contains(x, 'timed out') THEN 'timeout'
  WHEN contains(x, 'connection') OR contains(x, 'connect error') THEN 'connection' ELSE 'other_failure' END"""


def cause_sql(column):
    return _CAUSE.replace("(x,", f"(lower(coalesce({column}, '')),")


def summary_sql(column):
    cause = cause_sql(column)
    return f"""CASE WHEN {cause} = 'malformed_output' AND contains(lower({column}), 'context-score') THEN 'Checker returned invalid context-score count.'
      ELSE concat('Checker request failed: ', {cause}, CASE WHEN {cause} LIKE 'rate_limit%' THEN ' (HTTP 429)' ELSE '' END, '.') END"""


def _clean_sql(label, column):
    return f"""CASE WHEN {column} IS NULL THEN NULL WHEN lower({label}) = 'unknown' THEN {summary_sql(column)}
      ELSE {_rules_sql(column, _LOG_RULES)} END AS {column}"""


@R.add(
    "sanitized_logs",
    f"""SELECT event_id, {_clean_sql('relevance_label', 'relevance_explanation')},
      {_clean_sql('groundedness_label', 'groundedness_explanation')} FROM ({EVENT_LOGS_SQL})""",
)
def sanitized_logs(spark, sf):
    return telemetry.sanitised(event_logs(spark, sf)).select(
        "event_id", "retrieval.relevance_explanation", "generation.groundedness_explanation"
    )


@R.add(
    "failure_causes",
    f"""SELECT event_id, {cause_sql('relevance_explanation')} AS cause, {summary_sql('relevance_explanation')} AS summary FROM ({EVENT_LOGS_SQL})""",
)
def failure_causes(spark, sf):
    return derive(spark, sf, EVENT_LOGS).select(
        "event_id",
        redact.failure_cause(F.col("relevance_explanation")).alias("cause"),
        redact.failure_summary(F.col("relevance_explanation")).alias("summary"),
    )


_AVAILABILITY = f"""WITH l AS (SELECT 'relevance' AS role, relevance_label AS label, relevance_explanation AS e FROM ({EVENT_LOGS_SQL})
      UNION ALL SELECT 'groundedness', groundedness_label, groundedness_explanation FROM ({EVENT_LOGS_SQL})),
    m AS (SELECT role, lower(label) = 'unknown' AS unknown, trim(label) <> '' AND lower(label) <> 'unknown' AS valid, {cause_sql('e')} AS cause FROM l),
    roles AS (SELECT unnest(['relevance', 'groundedness']) AS role),
    causes AS (SELECT unnest([{", ".join(f"'{c}'" for c in redact.CAUSES)}]) AS cause)
    SELECT role, 'valid' AS measure, (SELECT count(*) FROM m WHERE m.role = roles.role AND valid) AS n FROM roles
    UNION ALL SELECT role, 'unknown', (SELECT count(*) FROM m WHERE m.role = roles.role AND unknown) FROM roles
    UNION ALL SELECT role, 'unknown:' || cause, (SELECT count(*) FROM m WHERE m.role = roles.role AND m.cause = causes.cause AND unknown) FROM roles, causes"""


@R.add("checker_availability", _AVAILABILITY)
def checker_availability(spark, sf):
    return telemetry.availability(event_logs(spark, sf))


_MARKERS = ["C:\\Users", "Bearer ", "authorization:", "gsk_", "http://", "@", "token"]


@R.add(
    "unsafe_texts",
    f"""SELECT doc_id, marker FROM documents, (SELECT unnest([{", ".join("'" + m + "'" for m in _MARKERS)}]) AS marker)
    WHERE contains(lower(text), lower(marker))""",
)
def unsafe_texts(spark, sf):
    return report.unsafe_texts(table(spark, sf, "documents"), "doc_id", _MARKERS)


# --- matching and labels ----------------------------------------------------------------------

# Every document is a case; labelled documents have a log, toxic ones two.
CASE_LOGS = """
SELECT concat('c', CAST(doc_id AS STRING)) AS conversation_id,
  CASE WHEN doc_id % 10 = 3 THEN 'unknown' WHEN quality = 1 THEN 'High' ELSE 'is-low' END AS relevance_label,
  CASE WHEN doc_id % 7 = 2 THEN 'odd' WHEN quality = 1 THEN 'grounded' WHEN doc_id % 2 = 0 THEN 'Partially grounded' ELSE 'NOT-grounded' END AS groundedness_label,
  'e' AS relevance_explanation, 'e' AS groundedness_explanation, 1.5 AS total_seconds, 0.5 AS dense_seconds,
  0.25 AS rerank_seconds, CAST(doc_id AS BIGINT) AS total_tokens FROM {labels}"""
CASE_LOGS = CASE_LOGS + " UNION ALL " + CASE_LOGS.strip() + " WHERE toxic = 1"
CASES = """
SELECT source AS paper_id, concat('q', CAST(doc_id AS STRING)) AS question_id,
  concat('c', CAST(doc_id AS STRING)) AS conversation_id, doc_id AS case_ordinal FROM {documents}"""


def case_logs(spark, sf):
    flat = derive(spark, sf, CASE_LOGS)
    for c in ("total_seconds", "dense_seconds", "rerank_seconds"):
        flat = flat.withColumn(c, F.col(c).cast("double"))
    return nested(flat)


def matched_cases(spark, sf):
    return report.match_logs(derive(spark, sf, CASES), case_logs(spark, sf))


MATCH_SQL = f"""cases AS ({plain(CASES)}), logs AS ({plain(CASE_LOGS)}),
matched AS (SELECT c.paper_id, c.question_id, c.conversation_id, c.case_ordinal, count(l.conversation_id) AS log_rows,
  any_value(relevance_label) AS rl, any_value(groundedness_label) AS gl
  FROM cases c LEFT JOIN logs l USING (conversation_id) GROUP BY ALL),
diag AS (SELECT *, CASE WHEN log_rows <> 1 THEN 'missing' WHEN rl = 'High' THEN 'high' WHEN rl = 'is-low' THEN 'low' ELSE 'unknown' END AS relevance,
  CASE WHEN log_rows <> 1 THEN 'missing' WHEN gl = 'grounded' THEN 'grounded' WHEN gl = 'Partially grounded' THEN 'partially_grounded'
    WHEN gl = 'NOT-grounded' THEN 'not_grounded' ELSE 'unknown' END AS groundedness FROM matched)"""


@R.add(
    "log_matching",
    f"""WITH {MATCH_SQL} SELECT conversation_id, log_rows,
      CASE log_rows WHEN 1 THEN 'matched' WHEN 0 THEN 'missing' ELSE 'duplicate' END AS log_match FROM matched""",
)
def log_matching(spark, sf):
    return matched_cases(spark, sf).select("conversation_id", "log_rows", "log_match")


@R.add(
    "diagnostic_labels",
    f"""SELECT event_id, CASE event_type WHEN 'signup' THEN 'high' WHEN 'click' THEN 'low' WHEN 'purchase' THEN 'medium' ELSE 'unknown' END AS relevance,
      CASE event_type WHEN 'signup' THEN 'grounded' WHEN 'view' THEN 'not_grounded' WHEN 'purchase' THEN 'partially_grounded' ELSE 'unknown' END AS groundedness FROM events""",
)
def diagnostic_labels(spark, sf):
    return derive(spark, sf, EVENT_LOGS).select(
        "event_id",
        report.diagnostic_label(F.col("relevance_label"), RELEVANCE_LABELS).alias("relevance"),
        report.diagnostic_label(F.col("groundedness_label"), GROUNDEDNESS_LABELS).alias("groundedness"),
    )


_DOMAIN = "('high'), ('medium'), ('low'), ('unknown'), ('missing')"


@R.add(
    "diagnostic_distribution",
    f"""WITH {MATCH_SQL} SELECT v.label, count(d.relevance) AS n, round(count(d.relevance) / (SELECT count(*) FROM diag), 9) AS share
    FROM (VALUES {_DOMAIN}) v(label) LEFT JOIN diag d ON d.relevance = v.label GROUP BY v.label""",
)
def diagnostic_distribution(spark, sf):
    labels = report.case_diagnostics(matched_cases(spark, sf), ["paper_id", "question_id"])
    return report.label_distribution(labels, "relevance", RELEVANCE_LABELS).withColumn(
        "share", F.round("share", 9)
    )


# --- series ------------------------------------------------------------------------------------

_ANSWER_TIMES = "SELECT doc_id, n_chars / 1000.0 AS elapsed_seconds FROM {documents}"
_JUDGE_TIMES = "SELECT doc_id, CASE WHEN toxic = 1 THEN NULL ELSE (doc_id % 97) / 8.0 END AS elapsed_seconds FROM {labels}"
_SERIES_SQL = f"""log AS ({EVENT_LOGS_SQL}),
series AS (SELECT 'End-to-end answer' AS series, CAST(elapsed_seconds AS DOUBLE) AS value FROM ({plain(_ANSWER_TIMES)})
  UNION ALL SELECT 'Semantic judge', CAST(elapsed_seconds AS DOUBLE) FROM ({plain(_JUDGE_TIMES)})
  UNION ALL SELECT 'Total retrieval', total_seconds FROM log UNION ALL SELECT 'Dense retrieval', dense_seconds FROM log
  UNION ALL SELECT 'Reranking', rerank_seconds FROM log UNION ALL SELECT 'Generator', rerank_seconds FROM log
  UNION ALL SELECT 'Groundedness checker', total_seconds / 4 FROM log)"""


_SERIES_NAMES = (
    "'End-to-end answer', 'Total retrieval', 'Dense retrieval', 'BM25', 'Fusion', 'Reranking', 'Generator',"
    " 'Relevance checker', 'Groundedness checker', 'Semantic judge'"
)


def _series(spark, sf):
    return report.all_series(
        derive(spark, sf, _ANSWER_TIMES), event_logs(spark, sf), derive(spark, sf, _JUDGE_TIMES)
    )


@R.add(
    "latency_series",
    f"WITH {_SERIES_SQL} SELECT series, count(*) AS n, round(sum(value), 4) AS total FROM series WHERE value IS NOT NULL GROUP BY series",
)
def latency_series(spark, sf):
    return _series(spark, sf).groupBy("series").agg(
        F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total")
    )


@R.add(
    "latency_summary",
    f"""WITH {_SERIES_SQL} SELECT series, count(value) AS n, round(avg(value), 6) AS mean, round(median(value), 6) AS median,
      round(quantile_disc(value, 0.95), 6) AS p95, round(max(value), 6) AS maximum
    FROM (SELECT unnest([{_SERIES_NAMES}]) AS series) LEFT JOIN series USING (series) GROUP BY series""",
)
def latency_summary(spark, sf):
    s = report.series_summary(_series(spark, sf))
    return s.select("series", "n", *[F.round(c, 6).alias(c) for c in ("mean", "median", "p95", "maximum")])


@R.add(
    "invalid_series_values",
    """SELECT series, count(*) AS n FROM (SELECT 'Total retrieval' AS series, CASE WHEN event_id % 50 = 7 THEN -value
      WHEN event_id % 50 = 8 THEN CAST('NaN' AS DOUBLE) ELSE value END AS value FROM events) WHERE isnan(value) OR value < 0 GROUP BY series""",
)
def invalid_series_values(spark, sf):
    logs = derive(
        spark,
        sf,
        "SELECT 'Total retrieval' AS series, CASE WHEN event_id % 50 = 7 THEN -value WHEN event_id % 50 = 8 THEN CAST('NaN' AS DOUBLE) ELSE value END AS value FROM {events}",
    )
    return report.invalid_series_values(logs).groupBy("series").agg(F.count("*").alias("n"))


@R.add(
    "token_usage",
    f"""SELECT count(total_tokens) AS recorded_cases, CAST(sum(total_tokens) AS BIGINT) AS total_tokens, round(avg(total_tokens), 6) AS mean_tokens
    FROM ({EVENT_LOGS_SQL})""",
)
def token_usage(spark, sf):
    return report.token_usage(event_logs(spark, sf)).withColumn("mean_tokens", F.round("mean_tokens", 6))


@R.add(
    "context_digests",
    """SELECT doc_id, sha256(text) AS answer_digest,
      sha256(CAST(to_json({'groundedness': lang, 'relevance': text}) AS STRING)) AS context_digest,
      sha256(CAST(to_json([source, lang]) AS STRING)) AS list_digest FROM documents""",
)
def context_digests(spark, sf):
    return table(spark, sf, "documents").select(
        "doc_id",
        digest.sha256_text(F.col("text")).alias("answer_digest"),
        digest.sha256_fields(relevance=F.col("text"), groundedness=F.col("lang")).alias("context_digest"),
        digest.sha256_list(F.array("source", "lang")).alias("list_digest"),
    )


# --- files ------------------------------------------------------------------------------------------

_LINE = T.StructType(
    [
        T.StructField("event_id", T.LongType()),
        T.StructField("event_type", T.StringType()),
        T.StructField("value", T.DoubleType()),
    ]
)


def _write_lines(spark, sf, *, damaged: bool) -> str:
    """Events as JSON lines; optionally purchases are cut short, views carry a wrong type and errors are arrays."""
    path = scratch_dir(spark, "lines")
    events = table(spark, sf, "events")
    line = F.to_json(F.struct("event_id", "event_type", "value"))
    if damaged:
        line = (
            F.when(F.col("event_type") == "purchase", F.substring(line, 1, 12))
            .when(F.col("event_type") == "view", F.regexp_replace(line, '"value":[0-9.]+', '"value":true'))
            .when(F.col("event_type") == "signup", F.concat(line, F.lit("\n  ")))
            .when(F.col("event_type") == "error", F.concat(F.lit("["), line, F.lit(","), line, F.lit("]")))
            .otherwise(line)
        )
    events.select(line.alias("value")).write.text(path)
    return path


@R.add("json_lines_strict", "SELECT event_id, event_type, value FROM events")
def json_lines_strict(spark, sf):
    return jsonl.read_strict(spark, _write_lines(spark, sf, damaged=False), _LINE)


@R.add(
    "json_lines_lenient",
    "SELECT event_id, event_type, value FROM events WHERE event_type NOT IN ('purchase', 'view', 'error')",
)
def json_lines_lenient(spark, sf):
    return jsonl.well_formed(jsonl.read_lenient(spark, _write_lines(spark, sf, damaged=True), _LINE))


@R.add(
    "json_lines_malformed",
    "SELECT count(*) AS malformed_lines FROM events WHERE event_type IN ('purchase', 'view', 'error')",
)
def json_lines_malformed(spark, sf):
    lines = jsonl.malformed_lines(spark, _write_lines(spark, sf, damaged=True), _LINE)
    return lines.agg(F.count("*").alias("malformed_lines"))


@R.add(
    "appended_log",
    "SELECT event_id, event_type, value FROM events UNION ALL SELECT event_id, event_type, value FROM events WHERE event_type = 'error'",
)
def appended_log(spark, sf):
    path = scratch_dir(spark, "log")
    events = table(spark, sf, "events").select("event_id", "event_type", "value")
    jsonl.append(events, path)
    jsonl.append(events.filter("event_type = 'error'"), path)
    return jsonl.read_strict(spark, path, _LINE)


@R.add("replaced_artifact", "SELECT event_type, count(*) AS n FROM events GROUP BY event_type")
def replaced_artifact(spark, sf):
    path = scratch_dir(spark, "artifact")
    counts = table(spark, sf, "events").groupBy("event_type").agg(F.count("*").alias("n"))
    jsonl.write_artifact(counts.withColumn("n", F.col("n") + 1), path)
    jsonl.write_artifact(counts, path)
    return spark.read.schema("event_type string, n bigint").json(path)

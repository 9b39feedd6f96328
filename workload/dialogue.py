"""Conversations, prompts, checker outputs and admission."""

from __future__ import annotations

from pyspark.sql import functions as F

from docquarry.functions import text
from docquarry.functions.shipping import ship_per_question
from docquarry.operators import admission, checks, conversation, modelstage, prompts
from docquarry.params import AdmissionLimits
from workload.ingestion import strip_sql
from workload.retrieval import hybrid_ctes, run_hybrid, with_passage, CHUNKS
from workload.tables import Registry, derive, plain, table

R = Registry()
WS = text.WHITESPACE


def _turns(spark, sf):
    return table(spark, sf, "conversations")


@R.add(
    "question_numbers",
    """SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS question_no
    FROM conversations WHERE role = 'user'""",
)
def question_numbers(spark, sf):
    return conversation.question_numbers(_turns(spark, sf))


_SAID = "concat(upper(role[1]), role[2:], ': ', text)"


@R.add(
    "rewrite_history",
    f"""SELECT conv_id, turn, role, coalesce(array_to_string(list({_SAID}) OVER
      (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN 4 PRECEDING AND 1 PRECEDING), chr(10)), '') AS history FROM conversations""",
)
def rewrite_history(spark, sf):
    return conversation.rewrite_history(_turns(spark, sf))


@R.add(
    "answer_history",
    f"""SELECT conv_id, turn, role, coalesce(array_to_string(list({_SAID} || chr(10)) OVER
      (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN 6 PRECEDING AND 1 PRECEDING), ''), '') AS history FROM conversations""",
)
def answer_history(spark, sf):
    return conversation.answer_history(_turns(spark, sf))


_REWRITES = """
SELECT conv_id, turn, text AS question, CASE turn % 3 WHEN 0 THEN concat('  ', text, chr(10))
  WHEN 1 THEN ' ' ELSE NULL END AS rewritten FROM {conversations}"""


@R.add(
    "effective_questions",
    f"""SELECT conv_id, turn, CASE WHEN turn % 3 = 0 THEN {strip_sql('question')} ELSE question END AS question
    FROM ({plain(_REWRITES)})""",
)
def effective_questions(spark, sf):
    rows = derive(spark, sf, _REWRITES)
    return rows.select(
        "conv_id",
        "turn",
        conversation.effective_question(F.col("rewritten"), F.col("question")).alias("question"),
    )


# --- contexts and prompts ----------------------------------------------------------


def _sources(spark, sf):
    """Final sources with their passages; at most top-K rows per question."""
    h = run_hybrid(spark, sf)
    passages = with_passage(derive(spark, sf, CHUNKS)).select("chunk_id", "passage")
    small = ship_per_question(h.final, h.questions, h.params.rerank_top_k)
    return h, passages.join(small, "chunk_id").select("query_id", "rank", "passage")


_SOURCE_SQL = f"{hybrid_ctes()}, source_row AS (SELECT f.query_id, f.rank, p.passage FROM final f JOIN passage p USING (chunk_id))"


@R.add(
    "answer_contexts",
    f"""WITH {_SOURCE_SQL} SELECT query_id, string_agg(passage, chr(10) || chr(10) ORDER BY rank) AS context
    FROM source_row GROUP BY query_id""",
)
def answer_contexts(spark, sf):
    return prompts.contexts(_sources(spark, sf)[1])


@R.add(
    "checker_contexts",
    f"""WITH {_SOURCE_SQL} SELECT query_id,
      string_agg(concat('[Context ', rank, ']', chr(10), passage), chr(10) || chr(10) ORDER BY rank) AS context
    FROM source_row GROUP BY query_id""",
)
def checker_contexts(spark, sf):
    return prompts.contexts(_sources(spark, sf)[1], numbered=True)


_TEMPLATE = "H={history}\nC={context}\nQ={question}\nA:"


@R.add(
    "answer_prompts",
    f"""WITH {_SOURCE_SQL}, ctx AS (SELECT query_id, string_agg(passage, chr(10) || chr(10) ORDER BY rank) AS context
      FROM source_row GROUP BY query_id)
    SELECT query_id, concat('H=', chr(10), 'C=', coalesce(context, ''), chr(10), 'Q=', question, chr(10), 'A:') AS prompt
    FROM weighted LEFT JOIN ctx USING (query_id)""",
)
def answer_prompts(spark, sf):
    h, sources = _sources(spark, sf)
    return prompts.prompts(h.questions, prompts.contexts(sources), template=_TEMPLATE)


def _reading_model():
    """Deterministic stand-in: answers with the question's token count; refuses 'é'."""
    import pandas as pd

    def answer(batch):
        if batch["question"].str.contains("ç").any():
            raise ValueError("unsupported letter")
        counts = batch["question"].map(lambda q: len(q.split()))
        return pd.DataFrame(
            {
                "text": counts.map(str),
                "finish_reason": "stop",
                "choice_count": 1,
                "total_tokens": counts,
            }
        )

    return answer


@R.add(
    "model_stage_outputs",
    f"""SELECT conv_id, turn, CASE WHEN contains(text, 'ç') THEN NULL ELSE CAST(n AS STRING) END AS answer,
      CASE WHEN contains(text, 'ç') THEN NULL ELSE n END AS total_tokens,
      CASE WHEN contains(text, 'ç') THEN 'error' ELSE 'success' END AS status,
      CASE WHEN contains(text, 'ç') THEN 'ValueError: unsupported letter' END AS error
    FROM (SELECT *, len([t for t in regexp_split_to_array(text, '[{WS}]+') if t <> '']) AS n FROM conversations WHERE role = 'user')""",
)
def model_stage_outputs(spark, sf):
    asked = _turns(spark, sf).filter("role = 'user'").select("conv_id", "turn", F.col("text").alias("question"))
    return modelstage.run_model(asked, _reading_model, ["conv_id", "turn"]).select(
        "conv_id", "turn", F.col("text").alias("answer"), "total_tokens", "status", "error"
    )


# --- checker outputs -----------------------------------------------------------------

# Recorded checker responses of every malformed kind, built per document.
_CHECKED = """
SELECT d.doc_id, n AS doc_count,
  CASE k WHEN 1 THEN concat('HTTP 429', chr(10), ' tokens  per minute ', repeat('x', 600)) END AS request_error,
  CASE k WHEN 2 THEN 2 ELSE 1 END AS choice_count,
  CASE k WHEN 3 THEN 'length' ELSE 'stop' END AS finish_reason,
  CASE k WHEN 4 THEN ' ' WHEN 5 THEN '{{"label":' WHEN 6 THEN '[1,2]'
    WHEN 7 THEN concat('{{"scores":[true', substring(',1,1,1,1,1,1,1,1', 1, 2 * (n - 1)), '],"label":"high","explanation":"e"}}')
    WHEN 8 THEN concat('{{"scores":[', substring('1,1,1,1,1,1,1,1,1', 1, 2 * n + 1), '],"label":"high","explanation":"e"}}')
    WHEN 9 THEN concat('{{"scores":[', substring('3,1,1,1,1,1,1,1,1', 1, 2 * n - 1), '],"label":"high","explanation":"e"}}')
    WHEN 10 THEN concat('{{"scores":[', substring('2,1,1,1,1,1,1,1,1', 1, 2 * n - 1), '],"label":"great","explanation":"e"}}')
    WHEN 11 THEN concat('{{"scores":[', substring('2,1,1,1,1,1,1,1,1', 1, 2 * n - 1), '],"label":"low","explanation":" "}}')
    WHEN 12 THEN concat('{{"scores":[', substring('1.0,1,1,1,1,1,1,1,1', 1, 2 * n + 1), '],"label":"low","explanation":"e"}}')
    WHEN 13 THEN concat('{{"scores":[', substring('2,1,1,1,1,1,1,1,1', 1, 2 * n - 1), '],"label":7,"explanation":"e"}}')
    ELSE concat(' {{"scores":[', substring('2,0,1,2,1,0,2,1,1', 1, 2 * n - 1), '],"label":"',
      CASE coalesce(quality, 0) + coalesce(toxic, 0) WHEN 0 THEN 'low' WHEN 1 THEN 'medium' ELSE 'high' END, '","explanation":" fits ", "extra":null}} ') END AS content,
  d.n_chars / 1000.0 AS latency
FROM (SELECT doc_id, n_chars, CAST(doc_id % 8 AS INT) AS n, doc_id % 23 AS k FROM {documents}) d
LEFT JOIN {labels} l ON l.doc_id = d.doc_id"""


def _wording(w: checks.CheckerWording, kind: str) -> str:
    """Reason CASE shared by both checkers in SQL."""
    label_set = checks.RELEVANCE_LABELS if kind == "relevance" else checks.GROUNDEDNESS_LABELS
    labels = ", ".join(f"'{x}'" for x in label_set)
    collapsed = strip_sql(f"regexp_replace(request_error, '[{WS}]+', ' ', 'g')")
    scores = (
        f"""WHEN coalesce(json_type(content, '$.scores') <> 'ARRAY', true)
        OR json_array_length(content, '$.scores') <> doc_count
        OR len([s for s in CAST(json_extract(content, '$.scores[*]') AS JSON[]) if CAST(s AS STRING) NOT IN ('0', '1', '2')]) > 0
        THEN '{w.scores}'"""
        if kind == "relevance"
        else ""
    )
    return f"""CASE WHEN request_error IS NOT NULL THEN concat('{w.failed}', substr({collapsed}, 1, 500))
      WHEN choice_count <> 1 THEN '{w.choice_count}' WHEN finish_reason = 'length' THEN '{w.budget}'
      WHEN trim(content) = '' THEN '{w.empty}' WHEN NOT json_valid(content) THEN '{w.unparsed}malformed JSON'
      WHEN json_type(content) <> 'OBJECT' THEN '{w.failed}not a JSON object' {scores}
      WHEN coalesce(json_type(content, '$.label') <> 'VARCHAR' OR json_extract_string(content, '$.label') NOT IN ({labels}), true) THEN '{w.label}'
      WHEN coalesce(trim(json_extract_string(content, '$.explanation')) = '', true) THEN '{w.explanation}' END"""


@R.add(
    "relevance_checks",
    f"""WITH r AS (SELECT *, {_wording(checks.RELEVANCE, 'relevance')} AS reason FROM ({plain(_CHECKED).replace('{{', '{').replace('}}', '}')})),
    w AS (SELECT doc_id, CAST(json_extract(content, '$.scores') AS INT[]) AS s FROM r WHERE reason IS NULL AND doc_count > 0),
    v AS (SELECT doc_id, sum(s / 2.0 * wt) / sum(wt) AS score FROM (
      SELECT doc_id, unnest(s[1:5]) AS s, unnest([1.0, 0.8, 0.6, 0.4, 0.2][1:len(s)])::DOUBLE AS wt FROM w) GROUP BY doc_id)
    SELECT r.doc_id, CASE WHEN doc_count = 0 THEN 'low' WHEN reason IS NULL THEN json_extract_string(content, '$.label') ELSE 'unknown' END AS relevance_label,
      round(CASE WHEN doc_count = 0 THEN 0.0 ELSE v.score END, 9) AS relevance_score,
      CASE WHEN doc_count = 0 THEN 'No retrieved context was available.' WHEN reason IS NULL THEN trim(json_extract_string(content, '$.explanation')) ELSE reason END AS relevance_explanation,
      CASE WHEN doc_count > 0 THEN latency END AS relevance_latency
    FROM r LEFT JOIN v USING (doc_id)""",
)
def relevance_checks(spark, sf):
    rows = derive(spark, sf, _CHECKED).withColumn("latency", F.col("latency").cast("double"))
    return checks.relevance(rows).select(
        "doc_id",
        "relevance_label",
        F.round("relevance_score", 9).alias("relevance_score"),
        "relevance_explanation",
        "relevance_latency",
    )


_GROUNDED = """
SELECT d.doc_id, CASE WHEN k = 14 THEN ' ' ELSE text END AS context,
  CASE k WHEN 1 THEN concat('connect ', chr(9), 'error') END AS request_error,
  CASE k WHEN 2 THEN 0 ELSE 1 END AS choice_count,
  CASE k WHEN 3 THEN 'length' ELSE 'stop' END AS finish_reason,
  CASE k WHEN 4 THEN '' WHEN 5 THEN '{{"label"' WHEN 6 THEN '"text"'
    WHEN 7 THEN '{{"label":"fine","explanation":"e"}}' WHEN 8 THEN '{{"label":"grounded"}}'
    WHEN 9 THEN '{{"label":null,"explanation":"e"}}' WHEN 10 THEN '{{"label":"grounded","explanation":5}}'
    ELSE concat('{{"explanation":"so ", "label":"', CASE coalesce(quality, 0) + coalesce(toxic, 0) WHEN 0 THEN 'not_grounded'
      WHEN 1 THEN 'partially_grounded' ELSE 'grounded' END, '"}}') END AS content,
  d.n_chars / 500.0 AS latency
FROM (SELECT doc_id, text, n_chars, doc_id % 19 AS k FROM {documents}) d LEFT JOIN {labels} l ON l.doc_id = d.doc_id"""


@R.add(
    "groundedness_checks",
    f"""WITH r AS (SELECT *, {_wording(checks.GROUNDEDNESS, 'groundedness').replace(
      "coalesce(trim(json_extract_string(content, '$.explanation')) = '', true)",
      "coalesce(json_type(content, '$.explanation') <> 'VARCHAR' OR trim(json_extract_string(content, '$.explanation')) = '', true)")} AS reason
      FROM ({plain(_GROUNDED).replace('{{', '{').replace('}}', '}')}))
    SELECT doc_id, CASE WHEN trim(context) = '' THEN 'not_grounded' WHEN reason IS NULL THEN json_extract_string(content, '$.label') ELSE 'unknown' END AS groundedness_label,
      CASE WHEN trim(context) = '' THEN 'No retrieved context was available.' WHEN reason IS NULL THEN trim(json_extract_string(content, '$.explanation')) ELSE reason END AS groundedness_explanation,
      CASE WHEN trim(context) <> '' THEN latency END AS groundedness_latency FROM r""",
)
def groundedness_checks(spark, sf):
    rows = derive(spark, sf, _GROUNDED).withColumn("latency", F.col("latency").cast("double"))
    return checks.groundedness(rows).select(
        "doc_id", "groundedness_label", "groundedness_explanation", "groundedness_latency"
    )


_RESULTS = """
SELECT event_id, CASE event_id % 11 WHEN 1 THEN 'boom' END AS failure,
  CASE event_id % 7 WHEN 0 THEN 'high' WHEN 1 THEN 'medium' WHEN 2 THEN 'low' WHEN 3 THEN 'unknown' WHEN 4 THEN event_type WHEN 5 THEN NULL ELSE 'high' END AS label,
  CASE event_id % 5 WHEN 0 THEN 'much' WHEN 1 THEN NULL ELSE '0.5' END AS score,
  CASE event_id % 13 WHEN 3 THEN NULL ELSE props END AS explanation,
  CASE event_id % 17 WHEN 2 THEN 'soon' ELSE '1.25' END AS latency FROM {events}"""


@R.add(
    "checker_result_guard",
    f"""SELECT event_id, CASE WHEN ok THEN label ELSE 'unknown' END AS label, CASE WHEN ok THEN TRY_CAST(score AS DOUBLE) END AS score,
      CASE WHEN ok THEN explanation WHEN failure IS NOT NULL THEN '{checks.RELEVANCE.failed}' || failure ELSE '{checks.RELEVANCE.malformed}' END AS explanation,
      CASE WHEN ok THEN TRY_CAST(latency AS DOUBLE) END AS latency
    FROM (SELECT *, failure IS NULL AND coalesce(label IN ('high', 'medium', 'low', 'unknown'), false) AND explanation IS NOT NULL
      AND coalesce(score, '0') <> 'much' AND latency <> 'soon' AS ok FROM ({plain(_RESULTS)}))""",
)
def checker_result_guard(spark, sf):
    return checks.guard_result(
        derive(spark, sf, _RESULTS), checks.RELEVANCE_LABELS, checks.RELEVANCE, scored=True
    )


# --- answers ------------------------------------------------------------------------

_ANSWERS = """
SELECT c.conv_id, c.turn, CASE WHEN turn % 4 = 3 THEN '' ELSE text END AS answer,
  CASE turn % 5 WHEN 0 THEN 'high' WHEN 1 THEN 'medium' WHEN 2 THEN 'unknown' WHEN 3 THEN 'odd' ELSE 'low' END AS relevance,
  CASE turn % 4 WHEN 0 THEN 'grounded' WHEN 1 THEN 'odd' WHEN 2 THEN 'not_grounded' ELSE 'unknown' END AS groundedness,
  CASE WHEN conv_id % 3 = 0 THEN 'single' ELSE 'multi' END AS kb_mode,
  CASE WHEN conv_id % 2 = 0 THEN 'all' ELSE 'selected' END AS scope_mode,
  array('a.pdf', role) AS names FROM {conversations} c WHERE role <> 'user'"""
_ANSWERS_SQL = plain(_ANSWERS).replace("array('a.pdf', role)", "['a.pdf', role]")
_SUFFIX_SQL = """concat(chr(10), chr(10), '---', chr(10), chr(10), '**Answer diagnostics**', chr(10), chr(10), '- **Retrieval relevance:** ',
  CASE relevance WHEN 'high' THEN 'High' WHEN 'medium' THEN 'Medium' WHEN 'unknown' THEN 'Unknown' ELSE 'Low' END, chr(10), '- **Groundedness:** ',
  CASE groundedness WHEN 'grounded' THEN 'Grounded' WHEN 'not_grounded' THEN 'Not grounded' WHEN 'unknown' THEN 'Unknown' ELSE 'Partially grounded' END,
  CASE WHEN kb_mode = 'multi' THEN concat(chr(10), '- **Scope:** ', CASE WHEN scope_mode = 'all' THEN 'All indexed documents (2)'
    ELSE concat('Selected documents (a.pdf, ', role, ')') END) ELSE '' END)"""


def _decorated(spark, sf):
    rows = derive(spark, sf, _ANSWERS)
    suffix = conversation.diagnostics_suffix(
        *[F.col(c) for c in ("relevance", "groundedness", "kb_mode", "scope_mode", "names")]
    )
    return rows.select("conv_id", "turn", F.concat("answer", suffix).alias("raw_answer"))


@R.add(
    "decorated_answers",
    f"SELECT conv_id, turn, concat(answer, {_SUFFIX_SQL}) AS raw_answer FROM ({_ANSWERS_SQL.replace('AS names', 'AS names, role')})",
)
def decorated_answers(spark, sf):
    return _decorated(spark, sf)


# Both layouts, with trailing blanks, and look-alikes that must stay.
_DECORATED_TAIL = """CASE conv_id % 5 WHEN 0 THEN concat(' ', chr(10))
  WHEN 1 THEN concat(chr(10), chr(10), 'Retrieval relevance: 🟢 High', chr(13), chr(10), 'Groundedness: Not grounded', chr(10), '📚 Scope: all indexed documents (12)')
  WHEN 2 THEN concat(chr(10), chr(10), 'Retrieval relevance: Low', chr(10), 'Groundedness: ⚪ Unknown ', chr(9), chr(10), chr(10))
  WHEN 3 THEN concat(chr(10), chr(10), 'Retrieval relevance: High') ELSE '' END"""


@R.add(
    "classified_answers",
    f"""SELECT conv_id, turn, cleaned_answer, CASE WHEN {strip_sql('cleaned_answer')} = '' THEN 'error' ELSE 'success' END AS status,
      CASE WHEN {strip_sql('cleaned_answer')} = '' THEN '{conversation.EMPTY_ANSWER_ERROR}' END AS error
    FROM (SELECT conv_id, turn, CASE WHEN conv_id % 5 = 3 THEN concat(answer, {_DECORATED_TAIL}) ELSE answer END AS cleaned_answer FROM ({_ANSWERS_SQL.replace('AS names', 'AS names, role')}))""",
)
def classified_answers(spark, sf):
    rows = derive(spark, sf, _ANSWERS)
    suffix = conversation.diagnostics_suffix(
        *[F.col(c) for c in ("relevance", "groundedness", "kb_mode", "scope_mode", "names")]
    )
    raw = rows.select(
        "conv_id",
        "turn",
        F.concat(
            "answer",
            F.when(F.col("conv_id") % 5 % 4 == 0, suffix).otherwise(F.lit("")),
            F.expr(_DECORATED_TAIL),
        ).alias("raw_answer"),
    )
    return conversation.classify_answers(raw).drop("raw_answer")


_RESPONSES = """
SELECT event_id, CASE event_id % 6 WHEN 0 THEN NULL WHEN 1 THEN 2 ELSE 1 END AS choice_count,
  CASE event_id % 4 WHEN 0 THEN ' Length ' WHEN 1 THEN NULL ELSE 'stop' END AS finish_reason,
  CASE event_id % 5 WHEN 0 THEN '  ' WHEN 1 THEN NULL ELSE props END AS content FROM {events}"""


@R.add(
    "provider_answer_acceptance",
    f"""SELECT event_id, CASE WHEN choice_count IS NULL THEN '{conversation.NO_CHOICES}' WHEN choice_count <> 1 THEN '{conversation.CHOICE_COUNT}'
      WHEN lower(trim(finish_reason)) = 'length' THEN '{conversation.TRUNCATED}'
      WHEN coalesce(trim(content), '') = '' THEN '{conversation.NO_CONTENT}' END AS rejection FROM ({plain(_RESPONSES)})""",
)
def provider_answer_acceptance(spark, sf):
    rows = derive(spark, sf, _RESPONSES)
    return rows.select(
        "event_id",
        conversation.answer_rejection(
            F.col("choice_count"), F.col("finish_reason"), F.col("content")
        ).alias("rejection"),
    )


# --- admission ------------------------------------------------------------------------

_SESSIONS = """
SELECT user_id AS session_id, ts, event_id, CASE event_type WHEN 'error' THEN ' '
  WHEN 'signup' THEN repeat(props, 300) ELSE props END AS question FROM {events}"""
# Allowances spent earlier, some beyond today's limit.
_SPENT = "SELECT DISTINCT user_id AS session_id, user_id % 8 AS used FROM {events} WHERE user_id % 3 > 0"


@R.add(
    "question_admission",
    f"""WITH s AS (SELECT *, CASE WHEN trim(question) = '' THEN 'noop' WHEN length(trim(question)) > 2000 THEN 'too_long' ELSE 'valid' END AS state
      FROM ({plain(_SESSIONS)}))
    SELECT session_id, event_id, CASE WHEN state <> 'valid' THEN state
      WHEN row_number() OVER (PARTITION BY session_id, state ORDER BY ts, event_id) + coalesce(used, 0) <= 5 THEN 'admitted'
      ELSE 'over_limit' END AS admission FROM s LEFT JOIN ({plain(_SPENT)}) USING (session_id)""",
)
def question_admission(spark, sf):
    asked = derive(spark, sf, _SESSIONS)
    spent = derive(spark, sf, _SPENT)
    return admission.admit_questions(asked, ["ts", "event_id"], AdmissionLimits(), spent).select(
        "session_id", "event_id", "admission"
    )


# Each conversation is one upload batch; lengths are scaled up to file sizes.
_BATCH = """
SELECT concat('c', CAST(conv_id AS STRING)) AS kb_id, turn AS pos,
  concat('f', CAST(turn AS STRING), CASE WHEN conv_id % 9 = 5 THEN '.txt' ELSE '.pdf' END) AS path,
  CAST(length(text) AS BIGINT) * 26000 AS size_bytes,
  md5(CASE WHEN turn % 3 = 1 THEN role ELSE text END) AS fingerprint,
  600 AS chunk_size, 50 AS chunk_overlap FROM {conversations}"""
_HELD = """
SELECT concat('c', CAST(conv_id AS STRING)) AS kb_id, CAST(turn AS STRING) AS doc_id,
  CAST(length(text) AS BIGINT) * 26000 AS size_bytes, md5(text) AS fingerprint,
  600 AS chunk_size, 50 AS chunk_overlap FROM {conversations} WHERE role = 'assistant' AND conv_id % 2 = 0"""
_BASES = """
SELECT DISTINCT concat('c', CAST(conv_id AS STRING)) AS kb_id, CASE WHEN conv_id % 4 = 0 THEN 'single' ELSE 'multi' END AS mode,
  CASE WHEN conv_id % 7 = 0 THEN 'single' ELSE 'multi' END AS current_mode FROM {conversations}"""
_EARLIER = "SELECT concat('c', CAST(conv_id AS STRING)) AS kb_id, md5(concat(role, 'x')) AS fingerprint FROM {conversations} WHERE conv_id % 10 = 3"


@R.add(
    "upload_budget",
    f"""WITH f AS ({plain(_BATCH)}), h AS ({plain(_HELD)}), b AS ({plain(_BASES)}), p AS ({plain(_EARLIER)}),
    kept AS (SELECT h.* FROM h JOIN b USING (kb_id) WHERE b.mode = 'multi' AND b.current_mode = 'multi'),
    k AS (SELECT f.kb_id, fingerprint, min(pos) AS pos, arg_min(size_bytes, pos) AS size_bytes FROM f JOIN b USING (kb_id)
      WHERE b.mode = 'multi' OR f.pos = (SELECT min(pos) FROM f f2 WHERE f2.kb_id = f.kb_id) GROUP BY f.kb_id, fingerprint),
    new AS (SELECT k.* FROM k WHERE NOT EXISTS (SELECT 1 FROM kept WHERE kept.kb_id = k.kb_id AND kept.fingerprint = k.fingerprint)),
    t AS (SELECT b.*, (SELECT count(*) FROM kept WHERE kept.kb_id = b.kb_id) + (SELECT count(*) FROM new WHERE new.kb_id = b.kb_id) AS documents,
      CAST(coalesce((SELECT sum(size_bytes) FROM kept WHERE kept.kb_id = b.kb_id), 0) + coalesce((SELECT sum(size_bytes) FROM new WHERE new.kb_id = b.kb_id), 0) AS BIGINT) AS total_bytes,
      (SELECT arg_min(CASE WHEN path LIKE '%.txt' THEN '{admission.WRONG_TYPE}' ELSE '{admission.FILE_TOO_LARGE}' END, pos) FROM f
        WHERE f.kb_id = b.kb_id AND (path LIKE '%.txt' OR size_bytes > 10485760)) AS problem,
      EXISTS (SELECT 1 FROM p WHERE p.kb_id = b.kb_id AND NOT EXISTS (SELECT 1 FROM f WHERE f.kb_id = p.kb_id AND f.fingerprint = p.fingerprint)) AS removed FROM b)
    SELECT kb_id, documents, total_bytes, CASE WHEN problem IS NOT NULL THEN problem WHEN mode = 'multi' AND removed THEN NULL
      WHEN documents > 3 THEN '{admission.TOO_MANY_DOCUMENTS}' WHEN total_bytes > 20971520 THEN '{admission.TOO_MANY_BYTES}' END AS rejection FROM t""",
)
def upload_budget(spark, sf):
    return admission.check_uploads(
        derive(spark, sf, _BATCH),
        derive(spark, sf, _HELD),
        derive(spark, sf, _BASES),
        derive(spark, sf, _EARLIER),
    )

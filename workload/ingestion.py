"""Files, sections, chunks and knowledge-base bookkeeping."""

from __future__ import annotations

from pyspark.sql import functions as F

from docquarry.functions import text
from docquarry.operators import ingest
from docquarry.operators.chunking import chunk_column, chunk_rows
from docquarry.params import ChunkParams
from docquarry.session import spread
from workload.tables import Registry, derive, plain, table

R = Registry()
WS = text.WHITESPACE
PARAMS = ChunkParams(600, 50)


def strip_sql(x: str) -> str:
    return f"regexp_replace({x}, '^[{WS}]+|[{WS}]+$', '', 'g')"


def normalise_sql(x: str) -> str:
    unix = f"regexp_replace(coalesce({x}, ''), '\\r\\n?', chr(10), 'g')"
    return strip_sql(f"regexp_replace({unix}, '\\n{{3,}}', chr(10) || chr(10), 'g')")


def preview_sql(x: str, n: int) -> str:
    return f"CASE WHEN length({x}) <= {n} THEN {x} ELSE concat(substr({x}, 1, {n}), '... [truncated]') END"


# --- scans and files ---------------------------------------------------------


@R.add(
    "content_fingerprints",
    "SELECT doc_id, md5(text) AS fingerprint, sha256(text) AS sha256 FROM documents",
)
def content_fingerprints(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", F.col("text").alias("content"))
    return ingest.with_content_digest(ingest.with_fingerprint(docs)).select(
        "doc_id", "fingerprint", "sha256"
    )


# Page addresses stand in for upload paths.
_PATHS = """
SELECT page_id, concat(CASE page_id % 3 WHEN 0 THEN '/in/' WHEN 1 THEN '' ELSE 'a.b/' END,
  CASE page_id % 7 WHEN 0 THEN '.' ELSE 'f' END, CAST(page_id AS STRING),
  CASE page_id % 8 WHEN 0 THEN '.pdf' WHEN 1 THEN '.PDF' WHEN 2 THEN '.doc' WHEN 3 THEN '.docx'
    WHEN 4 THEN '.tar.Docx' WHEN 5 THEN '.txt' WHEN 6 THEN '' ELSE '.pdf.' END) AS path FROM {pages}"""
_EXT = "lower(regexp_extract(path, '[^/](\\.[^./]+)$', 1))"


@R.add(
    "supported_files",
    f"SELECT page_id, path, {_EXT} AS extension FROM ({plain(_PATHS)}) WHERE {_EXT} IN ('.pdf', '.doc', '.docx')",
)
def supported_files(spark, sf):
    accepted, _ = ingest.split_supported(derive(spark, sf, _PATHS))
    return accepted.select("page_id", "path", text.file_extension(F.col("path")).alias("extension"))


@R.add(
    "unsupported_file_errors",
    f"""SELECT page_id, path, concat(regexp_extract(path, '[^/]*$'), ': unsupported file type') AS error
    FROM ({plain(_PATHS)}) WHERE {_EXT} NOT IN ('.pdf', '.doc', '.docx')""",
)
def unsupported_file_errors(spark, sf):
    return ingest.split_supported(derive(spark, sf, _PATHS))[1]


# --- text rows ----------------------------------------------------------------


@R.add(
    "normalized_text",
    f"""SELECT doc_id, length(n) AS n_chars, md5(n) AS digest FROM (
      SELECT doc_id, {normalise_sql('x')} AS n FROM (SELECT doc_id,
        concat(chr(13), chr(10), ' ', replace(text, '. ', concat('.', chr(13), chr(10), chr(13), chr(10), chr(10), chr(13)))) AS x
        FROM documents))""",
)
def normalized_text(spark, sf):
    raw = table(spark, sf, "documents").select(
        "doc_id",
        F.expr(
            "concat(chr(13), chr(10), ' ', replace(text, '. ', concat('.', chr(13), chr(10), chr(13), chr(10), chr(10), chr(13))))"
        ).alias("x"),
    )
    clean = raw.select("doc_id", text.normalise_newlines(F.col("x")).alias("n"))
    return clean.select("doc_id", F.length("n").cast("long").alias("n_chars"), F.md5("n").alias("digest"))


# A conversation read as a word-processor file: system turns are headers.
_ELEMENTS = """
SELECT concat('conv', CAST(conv_id AS STRING), '.docx') AS path, turn AS pos,
  CASE WHEN role = 'system' THEN 'Title' WHEN turn % 5 = 4 THEN 'Header' ELSE 'NarrativeText' END AS kind,
  CASE WHEN turn % 7 = 3 THEN ' ' ELSE concat(' ', text, chr(10)) END AS text FROM {conversations}"""
_SECTION_SQL = f"""
el AS (SELECT path, pos, kind IN ('Title', 'Header') AS is_header, {strip_sql('text')} AS text
  FROM ({plain(_ELEMENTS)}) WHERE {strip_sql('text')} <> ''),
numbered AS (SELECT *, sum(CAST(is_header AS INT)) OVER (PARTITION BY path ORDER BY pos) AS section_no FROM el),
section AS (SELECT path, section_no, min(pos) FILTER (NOT is_header) AS first_pos,
  max(text) FILTER (is_header) AS section_header,
  {strip_sql("string_agg(text, chr(10) ORDER BY pos) FILTER (NOT is_header)")} AS text
  FROM numbered GROUP BY path, section_no HAVING count(*) FILTER (NOT is_header) > 0)"""


@R.add("element_sections", f"WITH {_SECTION_SQL} SELECT path, first_pos, section_header, text FROM section")
def element_sections(spark, sf):
    return ingest.section_rows(derive(spark, sf, _ELEMENTS), ["path"], "pos").drop("section_no")


# Section rows whose headers repeat: the role of each turn, NULL for users.
_ROLE_ROWS = """
SELECT concat('conv', CAST(conv_id AS STRING), '.docx') AS path, turn AS pos,
  CASE WHEN turn < 2 THEN NULL WHEN turn > 4 THEN 'tail' ELSE role END AS section_header,
  'section' AS doc_type, CAST(turn AS INT) AS page,
  CASE WHEN turn % 6 = 5 THEN '' ELSE text END AS text FROM {conversations}"""


@R.add(
    "merged_section_text",
    f"""WITH r AS ({plain(_ROLE_ROWS)}),
    c AS (SELECT *, CASE WHEN lag(pos) OVER w IS NOT NULL AND section_header IS DISTINCT FROM lag(section_header) OVER w
      THEN 1 ELSE 0 END AS changed FROM r WINDOW w AS (PARTITION BY path ORDER BY pos)),
    g AS (SELECT *, sum(changed) OVER (PARTITION BY path ORDER BY pos) AS group_no FROM c)
    SELECT path, CAST(group_no AS BIGINT) AS group_no, min(pos) AS pos, arg_min(doc_type, pos) AS doc_type,
      CAST(NULL AS INT) AS page, any_value(section_header) AS section_header,
      coalesce(string_agg(text, chr(10) || chr(10) ORDER BY pos) FILTER (text <> ''), '') AS text
    FROM g GROUP BY path, group_no""",
)
def merged_section_text(spark, sf):
    return ingest.word_groups(derive(spark, sf, _ROLE_ROWS), ["path"], "pos")


# One step per window; `start` and `stop` are 0-based character offsets.
def chunk_sql(rows: str, size: int, overlap: int) -> str:
    inside = f"substr(body, start + 2, {size})"
    back = f"length(regexp_extract({inside}, '^((?s:.*)[ \\n])', 1))"
    ahead = f"length(regexp_extract(substr(body, start + {size} + 1), '^([^ \\n]*)', 1))"
    return f"""RECURSIVE src AS ({rows}),
    step AS (
      SELECT doc_id, body, 0 AS start, 0 AS stop, 0 AS next, false AS last, -1 AS step_no FROM src WHERE body <> ''
      UNION ALL
      SELECT doc_id, body, start, stop,
        CASE WHEN stop - {overlap} > start THEN stop - {overlap} ELSE stop END,
        start + {size} >= length(body), step_no FROM (
        SELECT doc_id, body, start, step_no,
          CASE WHEN start + {size} >= length(body) THEN length(body)
            WHEN back > 0 THEN start + back ELSE start + {size} + ahead END AS stop FROM (
          SELECT doc_id, body, start, step_no, {back} AS back, {ahead} AS ahead
          FROM (SELECT doc_id, body, next AS start, step_no + 1 AS step_no FROM step WHERE NOT last AND next < length(body))))),
    piece AS (SELECT doc_id, step_no, start, stop, {strip_sql("substr(body, start + 1, stop - start)")} AS text
      FROM step WHERE step_no >= 0),
    chunk AS (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY step_no) - 1 AS chunk_index,
      start, stop, text FROM piece WHERE text <> '')"""


_DOC_ROWS = "SELECT doc_id, text FROM {documents}"
_NORMAL_DOCS = f"SELECT doc_id, {normalise_sql('text')} AS body FROM documents"


@R.add(
    "sliding_window_chunks",
    f"""WITH {chunk_sql(_NORMAL_DOCS, 600, 50)}
    SELECT doc_id, CAST(chunk_index AS INT) AS chunk_index, CAST(start AS INT) AS start, CAST(stop AS INT) AS stop, text FROM chunk""",
)
def sliding_window_chunks(spark, sf):
    return chunk_rows(spread(derive(spark, sf, _DOC_ROWS)), PARAMS)


@R.add(
    "sliding_window_chunks_raw_text",
    f"""WITH {chunk_sql("SELECT doc_id, text AS body FROM documents", 120, 40)}
    SELECT doc_id, count(*) AS chunks, CAST(sum(length(text)) AS BIGINT) AS chars FROM chunk GROUP BY doc_id""",
)
def sliding_window_chunks_raw_text(spark, sf):
    docs = spread(table(spark, sf, "documents")).select(
        "doc_id", F.inline(chunk_column(F.col("text"), ChunkParams(120, 40)))
    )
    return docs.groupBy("doc_id").agg(
        F.count("*").alias("chunks"), F.sum(F.length("text")).alias("chars")
    )


# --- whole files ---------------------------------------------------------------

# The documents of one source are the pages of one PDF file in upload order;
# a conversation is a word-processor file.
_FILE_PARTS = """
SELECT lang AS kb_id, concat('/up/', lang, '/', source, '.pdf') AS path, doc_id AS part,
  CAST(doc_id AS INT) AS page_index, CAST(NULL AS STRING) AS section_header, text FROM {documents}"""
_WORD_PARTS = """
SELECT 'talk' AS kb_id, concat('/up/talk/conv', CAST(conv_id AS STRING), '.docx') AS path, turn AS part,
  role AS section_header, text FROM {conversations}"""


def _file_rows(spark, sf):
    pages = ingest.page_rows(spread(derive(spark, sf, _FILE_PARTS)))
    words = (
        derive(spark, sf, _WORD_PARTS)
        .withColumn("source_name", text.file_name(F.col("path")))
        .withColumn("file_type", F.lit("docx"))
        .withColumn("doc_type", F.lit("section"))
        .withColumn("page", F.lit(None).cast("int"))
    )
    rows = pages.unionByName(words)
    return rows.withColumn("doc_id", ingest.document_id(F.col("kb_id"), F.col("path"), PARAMS))


def _files(spark, sf):
    """One row per file: its bytes are the concatenated digests of its parts."""
    rows = _file_rows(spark, sf)
    return rows.groupBy("kb_id", "path", "doc_id").agg(
        F.md5(F.array_join(F.array_sort(F.collect_set(F.md5("text"))), "")).alias("fingerprint")
    )


def _documents(spark, sf, chunks):
    return ingest.document_rows(_files(spark, sf), chunks, PARAMS)


_ID = "md5(concat_ws('|', kb_id, path, '600', '50'))"
_FILE_SQL = f"""
word_group AS (SELECT 'talk' AS kb_id, path, min(pos) AS part, CAST(NULL AS INT) AS page, any_value(role) AS section_header,
    'section' AS doc_type, 'docx' AS file_type, string_agg(text, chr(10) || chr(10) ORDER BY pos) AS text FROM (
  SELECT *, sum(changed) OVER (PARTITION BY path ORDER BY pos) AS g FROM (
    SELECT concat('/up/talk/conv', CAST(conv_id AS STRING), '.docx') AS path, turn AS pos, role, text,
      CASE WHEN role <> lag(role) OVER (PARTITION BY conv_id ORDER BY turn) THEN 1 ELSE 0 END AS changed FROM conversations))
  GROUP BY path, g),
file_row AS (
  SELECT kb_id, path, part, page_index + 1 AS page, section_header, 'pdf' AS doc_type, 'pdf' AS file_type, text
  FROM ({plain(_FILE_PARTS)})
  UNION ALL SELECT kb_id, path, part, page, section_header, doc_type, file_type, text FROM word_group),
keyed AS (SELECT concat(path, '#', CAST(part AS STRING)) AS row_key, *, {_ID} AS real_doc FROM file_row),
window_piece AS (SELECT doc_id AS row_key, chunk_index, text FROM chunk),
file_chunk AS (SELECT k.kb_id, k.path, k.real_doc AS doc_id, k.page, k.section_header, k.doc_type, k.file_type, w.text,
  row_number() OVER (PARTITION BY k.real_doc ORDER BY k.part, w.chunk_index) - 1 AS chunk_index
  FROM keyed k JOIN window_piece w USING (row_key))"""


def _file_chunk_ctes() -> str:
    rows = f"SELECT concat(path, '#', CAST(part AS STRING)) AS doc_id, {normalise_sql('text')} AS body FROM file_row"
    head, tail = _FILE_SQL.split("keyed AS (", 1)
    chunks = chunk_sql(rows, 600, 50).removeprefix("RECURSIVE ")
    return f"RECURSIVE {head} {chunks}, keyed AS ({tail}"


@R.add(
    "file_chunks",
    f"""WITH {_file_chunk_ctes()}
    SELECT doc_id, CAST(chunk_index AS INT) AS chunk_index, CAST(page AS INT) AS page, section_header, doc_type, md5(text) AS digest FROM file_chunk""",
)
def file_chunks(spark, sf):
    return ingest.chunk_files(_file_rows(spark, sf), PARAMS).select(
        "doc_id", "chunk_index", "page", "section_header", "doc_type", F.md5("text").alias("digest")
    )


_PART_DIGESTS = "md5(string_agg(DISTINCT md5(text), '' ORDER BY md5(text)))"
_FINGERPRINT_SQL = f"""
finger AS (SELECT kb_id, path, {_PART_DIGESTS} AS fingerprint FROM (
  SELECT kb_id, path, text FROM ({plain(_FILE_PARTS)})
  UNION ALL SELECT kb_id, path, text FROM ({plain(_WORD_PARTS)})) GROUP BY kb_id, path)"""


@R.add(
    "enriched_chunks",
    f"""WITH {_file_chunk_ctes()}, {_FINGERPRINT_SQL}
    SELECT c.kb_id, doc_id, concat(doc_id, '_', CAST(chunk_index AS STRING)) AS chunk_id, CAST(page AS INT) AS page,
      regexp_extract(path, '[^/]*$') AS source_name, file_type, doc_type, section_header,
      regexp_extract(path, '[^/]*$') AS filename, fingerprint, {preview_sql('text', 1000)} AS raw_content,
      concat_ws(chr(10), concat('Source: ', regexp_extract(path, '[^/]*$')), 'Section: ' || section_header,
        'Page: ' || CAST(page AS STRING), CASE WHEN doc_type <> 'pdf' THEN concat('Content Type: ', doc_type) END, text) AS passage
    FROM file_chunk c JOIN finger f USING (kb_id, path)""",
)
def enriched_chunks(spark, sf):
    chunks = ingest.chunk_files(_file_rows(spark, sf), PARAMS)
    facts = _files(spark, sf).select(
        "doc_id",
        text.file_name(F.col("path")).alias("file_name"),
        F.regexp_replace(text.file_extension(F.col("path")), r"^\.", "").alias("file_type"),
        "fingerprint",
    )
    full = ingest.enrich_chunks(chunks, facts)
    passage = text.structured_text(
        F.col("text"), F.col("source_name"), F.col("section_header"), F.col("page"), F.col("doc_type")
    )
    return full.withColumn("passage", passage).drop("text", "chunk_index")


@R.add(
    "portable_chunk_metadata",
    f"""WITH {_file_chunk_ctes()}
    SELECT concat(doc_id, '_', CAST(chunk_index AS STRING)) AS chunk_id, doc_id, CAST(page AS INT) AS page, doc_type, section_header,
      '{{"lang":"' || kb_id || '","pos":' || CAST(chunk_index AS STRING) || '}}' AS languages FROM file_chunk""",
)
def portable_chunk_metadata(spark, sf):
    chunks = ingest.chunk_files(_file_rows(spark, sf), PARAMS)
    extra = chunks.select(
        F.concat_ws("_", "doc_id", F.col("chunk_index").cast("string")).alias("chunk_id"),
        "doc_id",
        "page",
        "doc_type",
        "section_header",
        F.struct(F.col("kb_id").alias("lang"), F.col("chunk_index").alias("pos")).alias("languages"),
        F.lit("dropped").alias("structured_context"),
    )
    return ingest.portable_metadata(extra, nested=("languages",))


_DOCUMENT_SQL = f"""{_file_chunk_ctes()}, {_FINGERPRINT_SQL},
document AS (SELECT f.kb_id, {_ID} AS doc_id, regexp_extract(f.path, '[^/]*$') AS file_name, f.path AS file_path,
  lower(regexp_extract(f.path, '[^.]*$')) AS file_type, f.fingerprint,
  (SELECT count(*) FROM file_chunk c WHERE c.path = f.path) AS chunk_count, 600 AS chunk_size, 50 AS chunk_overlap FROM finger f)"""


@R.add("indexed_documents", f"WITH {_DOCUMENT_SQL} SELECT * FROM document")
def indexed_documents(spark, sf):
    return _documents(spark, sf, ingest.chunk_files(_file_rows(spark, sf), PARAMS))


@R.add(
    "knowledge_base_status",
    f"""WITH {_DOCUMENT_SQL} SELECT kb_id, count(*) AS documents_indexed, CAST(sum(chunk_count) AS BIGINT) AS total_chunks
    FROM document GROUP BY kb_id""",
)
def knowledge_base_status(spark, sf):
    return ingest.knowledge_base_status(indexed_documents(spark, sf))


_COUNTED = """
SELECT source AS kb_id, doc_id AS pos, concat('d', CAST(doc_id AS STRING), '.pdf') AS file_name, 'pdf' AS file_type,
  n_chars AS chunk_count, 600 AS chunk_size, 50 AS chunk_overlap FROM {documents}"""


@R.add(
    "document_status_lines",
    f"""SELECT kb_id, row_number() OVER (PARTITION BY kb_id ORDER BY pos) AS position,
      concat(file_name, ' | type=PDF | chunks=', chunk_count, ' | size=600 | overlap=50') AS line FROM ({plain(_COUNTED)})""",
)
def document_status_lines(spark, sf):
    return ingest.document_status_lines(derive(spark, sf, _COUNTED), "pos")


# --- uploads ----------------------------------------------------------------------

_UPLOADS = "SELECT lang AS kb_id, doc_id, concat(source, '/', CAST(doc_id AS STRING), '.pdf') AS path, md5(text) AS fingerprint FROM {documents}"
# Bytes of the labelled documents are indexed already, half of them with other settings.
_EXISTING = """
SELECT d.lang AS kb_id, md5(d.text) AS fingerprint, CASE WHEN l.toxic = 0 THEN 600 ELSE 500 END AS chunk_size, 50 AS chunk_overlap
FROM {documents} d JOIN {labels} l ON d.doc_id = l.doc_id"""


@R.add(
    "deduplicated_uploads",
    f"""WITH e AS ({plain(_EXISTING)}), u AS ({plain(_UPLOADS)})
    SELECT kb_id, fingerprint, min(doc_id) AS doc_id, arg_min(path, doc_id) AS path, 600 AS chunk_size, 50 AS chunk_overlap
    FROM u WHERE NOT EXISTS (SELECT 1 FROM e WHERE e.kb_id = u.kb_id AND e.fingerprint = u.fingerprint AND e.chunk_size = 600)
    GROUP BY kb_id, fingerprint""",
)
def deduplicated_uploads(spark, sf):
    return ingest.first_copies(
        derive(spark, sf, _UPLOADS), derive(spark, sf, _EXISTING), PARAMS, "doc_id"
    )


@R.add(
    "single_mode_uploads",
    f"""SELECT kb_id, min(doc_id) AS doc_id, arg_min(path, doc_id) AS path, arg_min(fingerprint, doc_id) AS fingerprint
    FROM ({plain(_UPLOADS)}) GROUP BY kb_id""",
)
def single_mode_uploads(spark, sf):
    return ingest.only_first_upload(derive(spark, sf, _UPLOADS), "doc_id")


_NOW = "SELECT source AS kb_id, md5(text) AS fingerprint FROM {documents} WHERE source NOT IN ('src3', 'src4')"
_THEN = """
SELECT d.source AS kb_id, md5(d.text) AS fingerprint FROM {documents} d JOIN {labels} l ON d.doc_id = l.doc_id WHERE l.quality = 1
UNION ALL SELECT 'src0' AS kb_id, md5(text) AS fingerprint FROM {benchmark}
UNION ALL SELECT 'src1' AS kb_id, md5(text) AS fingerprint FROM {benchmark}"""
_MODES = """
SELECT source AS kb_id, max(CASE WHEN source IN ('src0', 'src2', 'src7') THEN 'multi' WHEN source = 'src9' THEN 'odd' ELSE 'single' END) AS mode
FROM {documents} GROUP BY source"""


@R.add(
    "upload_actions",
    f"""WITH n AS (SELECT DISTINCT * FROM ({plain(_NOW)})), t AS (SELECT DISTINCT * FROM ({plain(_THEN)})),
    m AS (SELECT kb_id, CASE WHEN mode = 'multi' THEN 'multi' ELSE 'single' END AS mode FROM ({plain(_MODES)})),
    s AS (SELECT m.*, (SELECT count(*) FROM n WHERE n.kb_id = m.kb_id) AS current_files,
      (SELECT count(*) FROM t WHERE t.kb_id = m.kb_id AND NOT EXISTS (SELECT 1 FROM n WHERE n.kb_id = t.kb_id AND n.fingerprint = t.fingerprint)) AS removed_files,
      (SELECT count(*) FROM n WHERE n.kb_id = m.kb_id AND NOT EXISTS (SELECT 1 FROM t WHERE n.kb_id = t.kb_id AND n.fingerprint = t.fingerprint)) AS added_files FROM m)
    SELECT *, CASE WHEN current_files = 0 THEN 'reset' WHEN removed_files > 0 AND mode = 'multi' THEN 'reset'
      WHEN removed_files > 0 OR mode = 'single' THEN 'replace' ELSE 'append' END AS action FROM s""",
)
def upload_actions(spark, sf):
    return ingest.upload_actions(
        derive(spark, sf, _NOW), derive(spark, sf, _THEN), derive(spark, sf, _MODES)
    )


@R.add(
    "shown_ingest_errors",
    f"""SELECT * FROM (SELECT kb_id, CAST(row_number() OVER (PARTITION BY kb_id ORDER BY page_id) AS INT) AS position, error FROM (
      SELECT 'kb' || CAST(page_id % 4 AS STRING) AS kb_id, page_id, concat(regexp_extract(path, '[^/]*$'), ': unsupported file type') AS error
      FROM ({plain(_PATHS)}) WHERE {_EXT} NOT IN ('.pdf', '.doc', '.docx'))) WHERE position <= 5""",
)
def shown_ingest_errors(spark, sf):
    errors = ingest.split_supported(derive(spark, sf, _PATHS))[1]
    return ingest.shown_errors(
        errors.withColumn("kb_id", F.concat(F.lit("kb"), (F.col("page_id") % 4).cast("string"))), "page_id"
    )

"""From extracted pages and elements to enriched, de-duplicated chunks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docquarry.functions import ordered, text
from docquarry.operators.chunking import chunk_rows
from docquarry.params import ChunkParams

HEADER_KINDS = ("Title", "Header")

# Fixed value: the chunk metadata that is kept.
CHUNK_METADATA = (
    "chunk_id",
    "doc_id",
    "page",
    "source",
    "source_name",
    "file_type",
    "doc_type",
    "section_header",
    "fusion_score",
    "raw_content",
    "category_depth",
    "languages",
    "filename",
    "fingerprint",
)

MAX_SHOWN_ERRORS = 5
RAW_CONTENT_LIMIT = 1000


# --- files ---------------------------------------------------------------


def with_fingerprint(files: DataFrame, content: str = "content") -> DataFrame:
    """MD5 of the bytes as ``fingerprint``."""
    return files.withColumn("fingerprint", F.md5(F.col(content).cast("binary")))


def with_content_digest(files: DataFrame, content: str = "content") -> DataFrame:
    """SHA-256 of the bytes as ``sha256``."""
    return files.withColumn("sha256", F.sha2(F.col(content).cast("binary"), 256))


def split_supported(files: DataFrame, path: str = "path") -> tuple[DataFrame, DataFrame]:
    """(indexable files, error rows for the others)."""
    supported = text.is_supported_file(F.col(path))
    errors = files.filter(~supported).select(
        *[c for c in files.columns if c != path],
        F.col(path),
        F.concat(text.file_name(F.col(path)), F.lit(": unsupported file type")).alias("error"),
    )
    return files.filter(supported), errors


def document_id(kb_id: Column, path: Column, params: ChunkParams) -> Column:
    """Deterministic id: the same file with other chunk settings is a new document."""
    return F.md5(
        F.concat_ws("|", kb_id, path, F.lit(str(params.size)), F.lit(str(params.overlap)))
    )


# What makes two files the same document.
COPY_KEYS = ("kb_id", "fingerprint", "chunk_size", "chunk_overlap")


def first_copies(
    files: DataFrame, existing: DataFrame | None, params: ChunkParams, order: str
) -> DataFrame:
    """Files whose bytes are not indexed yet under these settings.

    The earliest copy of each fingerprint in the batch wins.  The choice is an
    aggregate with map-side combine, so thousands of copies cost one row each
    per map task.
    """
    rest = [c for c in files.columns if c not in ("kb_id", "fingerprint")]
    unique = (
        files.groupBy("kb_id", "fingerprint")
        .agg(F.min_by(F.struct(*rest), F.col(order)).alias("__file"))
        .select("kb_id", "fingerprint", "__file.*")
        .withColumn("chunk_size", F.lit(params.size))
        .withColumn("chunk_overlap", F.lit(params.overlap))
    )
    if existing is None:
        return unique
    return unique.join(existing.select(*COPY_KEYS).distinct(), list(COPY_KEYS), "left_anti")


def only_first_upload(files: DataFrame, order: str) -> DataFrame:
    """Single-document mode: one file per knowledge base replaces its content."""
    rest = [c for c in files.columns if c != "kb_id"]
    return (
        files.groupBy("kb_id")
        .agg(F.min_by(F.struct(*rest), F.col(order)).alias("__file"))
        .select("kb_id", "__file.*")
    )


def upload_actions(current: DataFrame, previous: DataFrame, modes: DataFrame) -> DataFrame:
    """What an upload does to each knowledge base.

    ``current``/``previous``: (kb_id, fingerprint); ``modes``: (kb_id, mode).
    An empty uploader resets; a removed file resets a multi-document base and
    replaces a single-document one; otherwise files are indexed.
    """
    now = current.select("kb_id", "fingerprint").distinct().withColumn("__now", F.lit(1))
    then = previous.select("kb_id", "fingerprint").distinct().withColumn("__then", F.lit(1))
    diff = (
        now.join(then, ["kb_id", "fingerprint"], "full_outer")
        .groupBy("kb_id")
        .agg(
            F.count("__now").alias("current_files"),
            F.count_if(F.col("__now").isNull()).alias("removed_files"),
            F.count_if(F.col("__then").isNull()).alias("added_files"),
        )
    )
    zero = F.lit(0)
    state = modes.join(diff, "kb_id", "left").select(
        "kb_id",
        F.when(F.col("mode").isin("single", "multi"), F.col("mode"))
        .otherwise(F.lit("single"))
        .alias("mode"),
        F.coalesce("current_files", zero).alias("current_files"),
        F.coalesce("removed_files", zero).alias("removed_files"),
        F.coalesce("added_files", zero).alias("added_files"),
    )
    action = (
        F.when(F.col("current_files") == 0, "reset")
        .when((F.col("removed_files") > 0) & (F.col("mode") == "multi"), "reset")
        .when(F.col("removed_files") > 0, "replace")
        .when(F.col("mode") == "single", "replace")
        .otherwise("append")
    )
    return state.withColumn("action", action)


# --- rows of text ---------------------------------------------------------


def page_rows(pages: DataFrame) -> DataFrame:
    """Extracted PDF pages (kb_id, path, page_index, text) with page metadata."""
    return (
        pages.withColumn("source_name", text.file_name(F.col("path")))
        .withColumn("file_type", F.lit("pdf"))
        .withColumn("doc_type", F.lit("pdf"))
        .withColumn("section_header", F.lit(None).cast("string"))
        .withColumn("page", (F.col("page_index") + 1).cast("int"))
        .drop("page_index")
    )


def section_rows(elements: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Merge the elements between two headers into one section row.

    ``elements`` has ``keys``, ``order``, ``kind`` and ``text``.
    """
    filled = elements.withColumn("text", text.strip(F.coalesce("text", F.lit("")))).filter(
        F.col("text") != ""
    )
    header = F.coalesce(F.col("kind").isin(*HEADER_KINDS), F.lit(False))
    marked = ordered.running_total(
        filled, keys, order, header.cast("int"), "section_no", inclusive=True
    )
    part = F.struct(F.col(order).alias("pos"), F.col("text"))
    grouped = marked.groupBy(*keys, "section_no").agg(
        F.max(F.when(header, F.col("text"))).alias("section_header"),
        F.min(F.when(~header, F.col(order))).alias("first_pos"),
        F.array_sort(F.collect_list(F.when(~header, part))).alias("__parts"),
    )
    return grouped.filter(F.size("__parts") > 0).select(
        *keys,
        "section_no",
        "first_pos",
        "section_header",
        text.strip(F.array_join(F.transform("__parts", lambda p: p["text"]), "\n")).alias("text"),
    )


def merge_adjacent_sections(rows: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Number the runs of consecutive rows that carry the same header.

    Two missing headers count as the same header.
    """
    runs = {"group_no": ordered.RunNumber(F.col("section_header"))}
    return ordered.running(rows, keys, order, runs)


def word_groups(rows: DataFrame, keys: list[str], order: str) -> DataFrame:
    """One row per run of equal headers; texts joined by an empty line, no page."""
    grouped = merge_adjacent_sections(rows, keys, order)
    part = F.struct(F.col(order).alias("pos"), F.col("text"))
    meta = [c for c in rows.columns if c not in (*keys, order, "text", "page")]
    return (
        grouped.groupBy(*keys, "group_no")
        .agg(
            F.min_by(F.struct(F.col(order), *meta), F.col(order)).alias("__first"),
            F.array_sort(F.collect_list(F.when(F.col("text") != "", part))).alias("__parts"),
        )
        .select(
            *keys,
            "group_no",
            "__first.*",
            F.lit(None).cast("int").alias("page"),
            F.array_join(F.transform("__parts", lambda p: p["text"]), "\n\n").alias("text"),
        )
    )


def is_paged(file_type: Column, path: Column) -> Column:
    return (F.lower(F.coalesce(file_type, F.lit(""))) == "pdf") | F.lower(path).endswith(".pdf")


def chunk_files(rows: DataFrame, params: ChunkParams) -> DataFrame:
    """Chunk page rows page by page and section rows by merged section.

    ``rows``: kb_id, doc_id, path, part, page, source_name, file_type,
    doc_type, section_header, text.  All rows of a file carry the same path and
    file type, so each row knows its document's route and nothing is joined.
    """
    paged = is_paged(F.col("file_type"), F.col("path"))
    words = word_groups(rows.filter(~paged), ["doc_id"], "part")
    return chunk_rows(rows.filter(paged).unionByName(words.select(*rows.columns)), params)


# --- chunks and documents ---------------------------------------------------


def enrich_chunks(chunks: DataFrame, documents: DataFrame) -> DataFrame:
    """Ids, file facts and a shortened copy of the text on every chunk.

    ``documents``: doc_id, file_name, file_type, fingerprint.  Values a chunk
    already carries win over the file's.
    """
    facts = documents.select(
        "doc_id",
        F.col("file_name").alias("__name"),
        F.col("file_type").alias("__type"),
        F.col("fingerprint").alias("__print"),
    )
    return chunks.join(facts, "doc_id").select(
        "kb_id",
        "doc_id",
        F.concat_ws("_", "doc_id", F.col("chunk_index").cast("string")).alias("chunk_id"),
        "chunk_index",
        "page",
        F.coalesce("source_name", "__name").alias("source_name"),
        F.coalesce("file_type", "__type").alias("file_type"),
        F.coalesce("doc_type", "__type").alias("doc_type"),
        "section_header",
        F.col("__name").alias("filename"),
        F.col("__print").alias("fingerprint"),
        text.preview(F.col("text"), RAW_CONTENT_LIMIT).alias("raw_content"),
        "text",
    )


def portable_metadata(chunks: DataFrame, nested: tuple[str, ...] = ()) -> DataFrame:
    """Keep the whitelisted columns; columns named in ``nested`` become JSON text."""
    return chunks.select(
        *[
            F.to_json(F.col(c)).alias(c) if c in nested else F.col(c)
            for c in CHUNK_METADATA
            if c in chunks.columns
        ]
    )


def metadata_json(chunks: DataFrame) -> DataFrame:
    """Whitelisted metadata as one JSON object per chunk, NULL keys dropped."""
    present = [c for c in CHUNK_METADATA if c in chunks.columns]
    return chunks.select("chunk_id", F.to_json(F.struct(*present)).alias("metadata"))


def document_rows(files: DataFrame, chunks: DataFrame, params: ChunkParams) -> DataFrame:
    """One row per indexed file with its chunk count (0 if it yielded none)."""
    counts = chunks.groupBy("doc_id").agg(F.count("*").alias("chunk_count"))
    return files.join(counts, "doc_id", "left").select(
        "kb_id",
        "doc_id",
        text.file_name(F.col("path")).alias("file_name"),
        F.col("path").alias("file_path"),
        F.regexp_replace(text.file_extension(F.col("path")), r"^\.", "").alias("file_type"),
        "fingerprint",
        F.coalesce("chunk_count", F.lit(0)).alias("chunk_count"),
        F.lit(params.size).alias("chunk_size"),
        F.lit(params.overlap).alias("chunk_overlap"),
    )


def knowledge_base_status(documents: DataFrame) -> DataFrame:
    return documents.groupBy("kb_id").agg(
        F.count("*").alias("documents_indexed"), F.sum("chunk_count").alias("total_chunks")
    )


def document_status_lines(documents: DataFrame, order: str) -> DataFrame:
    """The status line of each document, numbered in index order."""
    numbered = ordered.dense_rank_along(documents, ["kb_id"], order, "__i")
    return numbered.select(
        "kb_id",
        (F.col("__i") + 1).alias("position"),
        F.concat(
            F.col("file_name"),
            F.lit(" | type="),
            F.upper("file_type"),
            F.lit(" | chunks="),
            F.col("chunk_count").cast("string"),
            F.lit(" | size="),
            F.col("chunk_size").cast("string"),
            F.lit(" | overlap="),
            F.col("chunk_overlap").cast("string"),
        ).alias("line"),
    )


def shown_errors(errors: DataFrame, order: str, limit: int = MAX_SHOWN_ERRORS) -> DataFrame:
    """First ``limit`` errors per knowledge base; a bad file never stops the batch."""
    first = Window.partitionBy("kb_id").orderBy(order)
    return (
        errors.withColumn("position", F.row_number().over(first))
        .filter(F.col("position") <= limit)
        .select("kb_id", "position", "error")
    )

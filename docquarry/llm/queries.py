"""One query per corpus operator, and SQL to check it with where SQL can say it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docquarry.llm import (
    block_neighbours,
    decontaminate,
    exact_dedup,
    hard_negatives,
    language_id,
    licenses,
    line_dedup,
    prefix_trie,
    secret_scan,
    sentencepiece_fst,
    sharding,
    simhash,
    toxicity,
)
from docquarry.llm.common import scan
from docquarry.llm.vectors import is_searchable

QUERIES = {}
ORACLES = {}


def _query(name: str, sql: str | None = None):
    def register(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return register


@_query("op5_virtual_slot_shards")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_documents(scan(spark, sf_dir, "documents"), 40).select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("bytes").alias("law"),
        "shard",
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
        "virtual_slot",
        "next_shard",
        "map_version",
    )


@_query(
    "op6_bloom_exact_dedup",
    """
    SELECT doc_id,
           max(doc_id) OVER same AS keep_id,
           count(*) OVER same AS group_size,
           doc_id = max(doc_id) OVER same AS kept,
           sha256(coalesce(text, '')) AS text_sha256
    FROM documents
    WINDOW same AS (PARTITION BY coalesce(text, ''))
    """,
)
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.duplicate_classes(scan(spark, sf_dir, "documents"))


@_query(
    "op4_winnowed_contamination",
    r"""
    WITH doc_words AS (
        SELECT doc_id, regexp_extract_all(
            translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
            '[a-z0-9\x{80}-\x{10FFFF}]+') AS words
        FROM documents
    ), item_words AS (
        SELECT item_id, regexp_extract_all(
            translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
            '[a-z0-9\x{80}-\x{10FFFF}]+') AS words
        FROM benchmark
    ), windows AS (
        SELECT DISTINCT item_id, least(len(words), 10) AS size,
               array_to_string(words[i : i + least(len(words), 10) - 1], ' ') AS gram
        FROM item_words, range(1, greatest(len(words) - 9, 1) + 1) AS t(i)
        WHERE len(words) > 0
    ), sizes AS (SELECT DISTINCT size FROM windows),
    grams AS (
        SELECT doc_id, i, size, array_to_string(words[i : i + size - 1], ' ') AS gram
        FROM doc_words, sizes, range(1, len(words) - size + 2) AS t(i)
    ), hits AS (
        SELECT doc_id, i, size, item_id FROM grams JOIN windows USING (size, gram)
    ), hit_words AS (
        SELECT doc_id, count(DISTINCT i + k) AS n_hit FROM hits, range(size) AS t(k) GROUP BY doc_id
    ), hit_items AS (
        SELECT doc_id, count(DISTINCT item_id) AS n_items,
               string_agg(DISTINCT item_id::VARCHAR, ',' ORDER BY item_id::VARCHAR) AS names
        FROM hits GROUP BY doc_id
    )
    SELECT doc_id, len(words) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
           sha256(coalesce(names, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
    FROM doc_words LEFT JOIN hit_words USING (doc_id) LEFT JOIN hit_items USING (doc_id)
    """,
)
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.find_contamination(
        scan(spark, sf_dir, "documents").select("doc_id", "text"), scan(spark, sf_dir, "benchmark")
    )
    return found.select(
        "doc_id",
        "n_words",
        decontaminate.hit_words(F.col("spans")).alias("n_hit"),
        F.size("items").cast("bigint").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        (F.size("spans") > 0).alias("contaminated"),
    )


def held_out():
    """Documents kept back from language training."""
    return F.crc32(F.col("doc_id").cast("string")) % 4 == 2


@_query("op7_word_first_language")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = scan(spark, sf_dir, "documents")
    hidden = F.coalesce(held_out(), F.lit(False))
    model = language_id.train(docs.filter(~hidden))
    return language_id.identify(docs.select("doc_id", hidden.alias("held_out"), "text"), model).drop("text")


@_query("op2_markov_secrets")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = scan(spark, sf_dir, "documents").select("doc_id", "text")
    model = secret_scan.train(secret_scan.labelled_samples(docs))
    spans = F.col("spans")

    def number(kind):
        return F.size(secret_scan.of_kind(spans, kind)).cast("bigint").alias(f"n_{kind}")

    base = secret_scan.of_kind(spans, "assign", "access", "hex")
    return secret_scan.find_secrets(docs, model).select(
        "doc_id",
        number("assign"),
        number("access"),
        number("hex"),
        F.sha2(secret_scan.joined(base), 256).alias("base_sha256"),
        secret_scan.joined(spans).alias("spans"),
        number("markov"),
    )


PIECE_MODEL = "/opt/tokenizers/piece_bpe_32k.model"


@_query("op9_fst_sentencepiece")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = scan(spark, sf_dir, "documents").select("doc_id", "text")
    coded = sentencepiece_fst.encode_documents(docs, sentencepiece_fst.load_model(PIECE_MODEL))
    return coded.select(
        "doc_id",
        F.size("ids").cast("bigint").alias("n_ids"),
        F.sha2(F.array_join("ids", ","), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
        "round_trip",
    )


@_query("op1_bktree_simhash")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(scan(spark, sf_dir, "documents"))


@_query(
    "op8_set_join_line_dedup",
    r"""
    WITH lines AS (
        SELECT doc_id, len(string_split(text, chr(10))) AS n_lines, i AS line_no,
               list_distinct(list_filter(
                   regexp_split_to_array(lower(string_split(text, chr(10))[i + 1]), '[\x20\x09-\x0D]+'),
                   lambda w: w <> '')) AS words
        FROM documents, range(len(string_split(text, chr(10)))) AS t(i)
    ), sets AS (
        SELECT list_sort(words) AS words, len(words) AS size, min((doc_id, line_no)) AS place
        FROM lines WHERE len(words) > 0 GROUP BY ALL
    ), numbered AS (SELECT *, row_number() OVER (ORDER BY place) AS k FROM sets),
    counted AS (
        SELECT w, count(*) AS n FROM (SELECT unnest(words) AS w FROM numbered) GROUP BY w
    ), ranked AS (
        SELECT k, size, w, row_number() OVER (PARTITION BY k ORDER BY n, w) AS pos
        FROM (SELECT k, size, unnest(words) AS w FROM numbered) JOIN counted USING (w)
    ), heads AS (
        SELECT k, size, w FROM ranked WHERE pos <= size - ceil(size * 0.8) + 1
    ), pairs AS (
        SELECT DISTINCT b.k AS later, a.k AS earlier
        FROM heads a JOIN heads b ON a.w = b.w AND a.k < b.k
        WHERE least(a.size, b.size) * 100 >= greatest(a.size, b.size) * 80
    ), gone AS (
        SELECT DISTINCT later AS k
        FROM pairs JOIN numbered a ON a.k = earlier JOIN numbered b ON b.k = later
        WHERE len(list_intersect(a.words, b.words)) * 180 >= (a.size + b.size) * 80
    ), removed AS (
        SELECT l.doc_id, l.line_no
        FROM lines l JOIN numbered s ON list_sort(l.words) = s.words
        WHERE s.place <> (l.doc_id, l.line_no) OR s.k IN (SELECT k FROM gone)
    )
    SELECT d.doc_id, coalesce(len(string_split(d.text, chr(10))), 0) AS n_lines,
           count(r.line_no) AS n_removed,
           coalesce(list(r.line_no::INTEGER ORDER BY r.line_no) FILTER (r.line_no IS NOT NULL), []) AS removed
    FROM documents d LEFT JOIN removed r ON d.doc_id = r.doc_id
    GROUP BY d.doc_id, d.text
    """,
)
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.count_repeated(scan(spark, sf_dir, "documents"))


@_query("op10_toxicity_chain")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = scan(spark, sf_dir, "documents").select("doc_id", "text")
    categories = {"low_quality": 1 - F.col("quality"), "toxic": F.col("toxic")}
    chain = toxicity.train(docs, scan(spark, sf_dir, "labels"), categories)
    return toxicity.score(docs, chain).select(
        "doc_id",
        "p_low_quality",
        "p_toxic",
        (F.col("p_low_quality") >= 0.5).alias("low_quality"),
        (F.col("p_toxic") >= 0.5).alias("toxic"),
    )


def _licence_sql() -> str:
    """The licence scan in SQL, over the same template list."""
    rows = ", ".join(
        "({}, '{}', '{}', '{}', {})".format(
            n, t.name, t.kind, t.wording.replace("'", "''"), licenses.least_of(t.kind)
        )
        for n, t in enumerate(licenses.TEMPLATES)
    )
    return rf"""
    WITH files AS (
        SELECT doc_id,
               concat_ws('/', coalesce(source, 'none'), doc_id // 10000, doc_id // 100, doc_id) AS path,
               concat_ws('/', coalesce(source, 'none'), doc_id // 10000, doc_id // 100) AS dir,
               list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[^a-z0-9]+'), lambda w: w <> '') AS terms
        FROM documents
    ), templates(n, name, kind, wording, least) AS (VALUES {rows}),
    template_lists AS (SELECT *, regexp_extract_all(lower(wording), '[a-z0-9]+') AS terms FROM templates),
    template_words AS (
        SELECT n, o - 1 AS o, terms[o] AS term FROM template_lists, range(1, len(terms) + 1) AS t(o)
    ), words AS MATERIALIZED (
        SELECT doc_id, i - 1 AS i, terms[i] AS term FROM files, range(1, len(terms) + 1) AS t(i)
    ), weights AS MATERIALIZED (
        SELECT term, ln((1 + (SELECT count(*) FROM documents))::DOUBLE / (1 + count(DISTINCT doc_id))) + 1 AS idf
        FROM (SELECT term, doc_id FROM words UNION ALL SELECT term, NULL FROM template_words) GROUP BY term
    ), raw AS (
        SELECT n, term, count(*) * any_value(idf) AS w FROM template_words JOIN weights USING (term) GROUP BY n, term
    ), vectors AS MATERIALIZED (SELECT n, term, w / sqrt(sum(w * w) OVER (PARTITION BY n)) AS w FROM raw),
    anchors AS (
        SELECT n, term FROM templates JOIN vectors USING (n)
        QUALIFY sqrt(greatest(1 - coalesce(sum(w * w) OVER (
            PARTITION BY n ORDER BY w DESC, term ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0), 0))
            >= least - {licenses.SLACK}
    ), units AS (
        SELECT DISTINCT doc_id, n, greatest(i - o, 0) AS low, greatest(i - o, 0) + len(terms) - 1 AS high
        FROM anchors JOIN template_words USING (n, term) JOIN template_lists USING (n)
        JOIN words USING (term) WHERE kind <> 'whole'
        UNION ALL
        SELECT DISTINCT doc_id, n, 0, len(f.terms) - 1
        FROM anchors JOIN templates USING (n) JOIN words USING (term) JOIN files f USING (doc_id)
        WHERE kind = 'whole'
    ), counted AS (
        SELECT doc_id, n, low, term, count(*) AS tf
        FROM units JOIN words USING (doc_id) WHERE i BETWEEN low AND high GROUP BY ALL
    ), cosines AS (
        SELECT c.doc_id, c.n, c.low, sum(tf) AS size,
               round(sum(tf * idf * coalesce(v.w, 0)) / sqrt(sum(tf * idf * tf * idf)), 9) AS cosine
        FROM counted c JOIN weights USING (term) LEFT JOIN vectors v ON v.n = c.n AND v.term = c.term
        GROUP BY c.doc_id, c.n, c.low
    ), matches AS (
        SELECT c.*, name, kind, len(l.terms) AS length,
               kind = 'whole' OR (kind = 'title' AND low < {licenses.HEAD_TERMS}
                                  AND cosine >= {licenses.MIN_TITLE}) AS is_text
        FROM cosines c JOIN template_lists l USING (n) WHERE cosine >= least
    ), best AS (
        SELECT doc_id, name AS own, cosine, is_text FROM matches
        QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY is_text DESC, cosine DESC, length DESC, n) = 1
    ), covered AS (
        SELECT doc_id, count(DISTINCT low + k) AS licence_words
        FROM matches, range(size::BIGINT) AS t(k) WHERE kind <> 'whole' GROUP BY doc_id
    ), scanned AS (
        SELECT f.doc_id, path, dir, own, cosine,
               coalesce(is_text OR coalesce(licence_words, 0) >= len(terms) * 0.1, false) AS licence_file
        FROM files f LEFT JOIN best USING (doc_id) LEFT JOIN covered USING (doc_id)
    ), licensed AS (
        SELECT dir, first(own ORDER BY cosine DESC, path) AS licence FROM scanned WHERE licence_file GROUP BY dir
    ), near AS (
        SELECT doc_id, l.dir AS inherited_from, l.licence AS inherited
        FROM scanned s JOIN licensed l ON s.dir = l.dir OR starts_with(s.dir, l.dir || '/')
        QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY length(l.dir) DESC) = 1
    )
    SELECT doc_id, path, own, cosine, licence_file,
           CASE WHEN own IS NULL THEN inherited END AS inherited,
           CASE WHEN own IS NULL THEN inherited_from END AS inherited_from,
           coalesce(own, inherited) AS licence
    FROM scanned LEFT JOIN near USING (doc_id)
    """


@_query("op3_tfidf_licences", _licence_sql())
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    number = F.col("doc_id")
    path = F.concat_ws(
        "/",
        F.coalesce("source", F.lit("none")),
        F.expr("doc_id div 10000"),
        F.expr("doc_id div 100"),
        number,
    )
    return licenses.scan_licences(scan(spark, sf_dir, "documents"), path, min_share=0.1)


@_query(
    "op11_block_nearest_neighbours",
    """
    WITH rows AS (
        SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings
        WHERE len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
          AND len(list_filter(embedding, lambda x: x <> 0)) > 0
    ), pairs AS (
        SELECT q.vec_id AS query_id, c.vec_id, list_dot_product(q.v, c.v) AS score
        FROM rows q JOIN rows c ON q.vec_id <> c.vec_id
        WHERE q.vec_id % 20 = 0
    )
    SELECT query_id, (row_number() OVER best)::INTEGER AS rank, vec_id, score
    FROM pairs
    WINDOW best AS (PARTITION BY query_id ORDER BY score DESC, vec_id)
    QUALIFY row_number() OVER best <= 20
    """,
)
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    return block_neighbours.nearest_neighbours(scan(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0, 20)


# CRC-32 of the decimal digits of an id, bit by bit, as SQL.
_CRC_SQL = """
    bits AS (
        SELECT list_transform(range(256), lambda b: list_reduce(
            list_prepend(b, range(8)), lambda c, k: xor(c >> 1, 3988292384 * (c & 1)))) AS crc_table
    ), ids AS (SELECT DISTINCT conv_id FROM conversations WHERE conv_id IS NOT NULL),
    plans AS (
        SELECT conv_id, conv_id - conv_id % 100 AS base,
               xor(list_reduce(
                   list_prepend(4294967295::BIGINT, list_transform(string_split(conv_id::VARCHAR, ''), lambda s: ascii(s)::BIGINT)),
                   lambda c, b: xor(c >> 8, crc_table[(xor(c, b) & 255) + 1])), 4294967295) % 6 AS h
        FROM ids, bits
    )"""


@_query(
    "op12_contracted_prefix_trie",
    f"""
    WITH {_CRC_SQL},
    ordered AS (
        SELECT conv_id, {{'role': coalesce(role, ''), 'text': coalesce(text, '')}} AS t,
               row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS pos
        FROM conversations WHERE conv_id IS NOT NULL
    ), lists AS (SELECT conv_id, list(t ORDER BY pos) AS ts FROM ordered GROUP BY conv_id),
    rebuilt AS (
        SELECT p.conv_id, list_concat(coalesce(b.ts[1:h], []), o.ts[h + 1:]) AS ts
        FROM plans p JOIN lists o ON o.conv_id = p.conv_id LEFT JOIN lists b ON b.conv_id = p.base
    ), prefixes AS (
        SELECT conv_id, d, ts[1:d] AS prefix, d = len(ts) AS ends FROM rebuilt, range(len(ts) + 1) AS r(d)
    ), nodes AS (
        SELECT prefix, d, min(conv_id) AS conv_id, count(*) AS n_convs,
               string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (ends) AS names
        FROM prefixes GROUP BY prefix, d
    ), edges AS (
        SELECT n.prefix, p.conv_id AS parent_conv_id, p.prefix AS parent
        FROM nodes n JOIN nodes p ON n.d > 0 AND p.d = n.d - 1 AND p.prefix = n.prefix[1:n.d - 1]
    ), children AS (SELECT parent AS prefix, count(*) AS n_children FROM edges GROUP BY parent),
    below AS (
        SELECT u.prefix, count(*) FILTER (c.prefix IS NULL) AS n_leaves,
               sum((v.n_convs - 1) * CASE WHEN v.d > 0 THEN length(v.prefix[v.d].text) ELSE 0 END)::BIGINT AS saved_tokens
        FROM (SELECT n.*, n.prefix[1:k] AS top FROM nodes n, range(n.d + 1) AS r(k)) v
        JOIN nodes u ON u.prefix = v.top LEFT JOIN children c ON c.prefix = v.prefix
        GROUP BY u.prefix
    )
    SELECT n.conv_id, n.d AS depth, e.parent_conv_id, n.n_convs, coalesce(c.n_children, 0) AS n_children,
           b.n_leaves, b.saved_tokens, sha256(coalesce(n.names, '')) AS ends_sha256
    FROM nodes n LEFT JOIN edges e USING (prefix) LEFT JOIN children c USING (prefix) JOIN below b USING (prefix)
    """,
)
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    number = F.col("conv_id")
    return prefix_trie.conversation_trie(
        scan(spark, sf_dir, "conversations"), number - number % 100, F.crc32(number.cast("string")) % 6, 5
    )


@_query(
    "op13_lemp_hard_negatives",
    """
    WITH rows AS (
        SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
               list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS v
        FROM embeddings
        WHERE label IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    ), scored AS (
        SELECT a.vec_id AS anchor_id, r.vec_id, a.label = r.label AS same,
               list_dot_product(a.v::DOUBLE[], r.v::DOUBLE[])::BIGINT AS score
        FROM rows a JOIN rows r ON a.vec_id <> r.vec_id
        WHERE a.vec_id % 100 = 0
    ), positives AS (
        SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM scored WHERE same
        QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5
    )
    SELECT anchor_id, positive_id, (row_number() OVER best)::INTEGER AS rank, vec_id AS negative_id,
           positive_score, score AS negative_score
    FROM positives JOIN scored USING (anchor_id)
    WHERE NOT same AND 30 * positive_score <= 100 * score AND 100 * score <= 90 * positive_score
    WINDOW best AS (PARTITION BY anchor_id, positive_id ORDER BY score DESC, vec_id)
    QUALIFY row_number() OVER best <= 10
    """,
)
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    number, label = F.col("vec_id"), F.col("label")
    rows = (
        scan(spark, sf_dir, "embeddings")
        .filter(is_searchable(F.col("embedding"), zero=True))
        .select(
            "vec_id",
            F.when(number % 7 == 0, (label + 1) % 10).otherwise(label).alias("label"),
            F.transform("embedding", lambda x: F.floor(x.cast("double") * 256)).alias("embedding"),
        )
    )
    return hard_negatives.mine(rows, number % 100 == 0)

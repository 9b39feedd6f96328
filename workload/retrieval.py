"""Lexical, dense and hybrid retrieval."""

from __future__ import annotations

from pyspark.sql import functions as F

from docquarry.functions import text
from docquarry.operators import dense, fusion, index, lexical, lexical_store, rerank, routing, scope, vector_index
from docquarry.params import RetrievalParams
from docquarry.plans import hybrid
from docquarry.session import scratch_dir, spread
from workload.tables import Registry, derive, plain

R = Registry()

WS = text.WHITESPACE

# Documents as chunks of one knowledge base (the prefix of their source name, so
# one key holds every row), benchmark texts as questions.
CHUNKS = """
SELECT substr(source, 1, 3) AS kb_id, CAST(doc_id AS STRING) AS doc_id, CAST(doc_id AS STRING) AS chunk_id,
       doc_id AS ordinal, text, source
FROM {documents}"""
CHUNKS_BY_LANG = CHUNKS.replace("substr(source, 1, 3)", "lang")
QUESTIONS = "SELECT 'src' AS kb_id, item_id AS query_id, text AS question FROM {benchmark}"
# Each question may use the documents of one source.
SOURCE_SCOPE = """
SELECT b.item_id AS query_id, CAST(d.doc_id AS STRING) AS doc_id
FROM {benchmark} b JOIN {documents} d ON d.source = concat('src', CAST(b.item_id % 20 AS STRING))"""
VECTORS = """
SELECT 'src' AS kb_id, CAST(vec_id AS STRING) AS doc_id, CAST(vec_id AS STRING) AS chunk_id,
       vec_id AS ordinal, embedding, label
FROM {embeddings}"""
VECTOR_QUESTIONS = "SELECT 'src' AS kb_id, vec_id AS query_id, embedding, label FROM {embeddings}"
LABEL_SCOPE = """
SELECT q.vec_id AS query_id, CAST(d.vec_id AS STRING) AS doc_id
FROM {embeddings} q JOIN {embeddings} d ON q.label = d.label"""
# A benchmark text paired with the vector of the same number.
HYBRID_QUESTIONS = """
SELECT 'src' AS kb_id, b.item_id AS query_id, b.text AS question, v.embedding
FROM {benchmark} b JOIN {embeddings} v ON v.vec_id = b.item_id"""
PARAMS = RetrievalParams(top_n=30, rerank_candidates=30, rerank_top_k=10, fusion_threshold=0.15)


def with_passage(chunks):
    return chunks.withColumn(
        "passage",
        text.structured_text(
            F.col("text"), F.col("source"), F.lit(None).cast("string"),
            F.lit(None).cast("int"), F.lit("pdf"),
        ),
    )


# --- SQL ---------------------------------------------------------------------


def tok_ctes(chunks: str, questions: str | None = None) -> str:
    """chunk, posting(dl, tf), kb and term(idf); with questions also qterm."""
    sql = f"""
chunk AS ({plain(chunks)}),
word AS (SELECT kb_id, chunk_id, t FROM (
  SELECT kb_id, chunk_id, unnest(regexp_split_to_array(text, '[{WS}]+')) AS t FROM chunk) WHERE t <> ''),
len AS (SELECT c.kb_id, c.chunk_id, count(w.t) AS dl FROM chunk c LEFT JOIN word w
  ON c.kb_id = w.kb_id AND c.chunk_id = w.chunk_id GROUP BY ALL),
posting AS (SELECT kb_id, chunk_id, t AS term, count(*) AS tf FROM word GROUP BY ALL),
kb AS (SELECT kb_id, count(*) AS n, avg(dl) AS avgdl FROM len GROUP BY ALL),
rawterm AS (SELECT p.kb_id, p.term, count(*) AS df,
  ln(any_value(kb.n) - count(*) + 0.5) - ln(count(*) + 0.5) AS raw_idf
  FROM posting p JOIN kb USING (kb_id) GROUP BY p.kb_id, p.term),
term AS (SELECT kb_id, term, df, CASE WHEN raw_idf < 0
  THEN 0.25 * avg(raw_idf) OVER (PARTITION BY kb_id) ELSE raw_idf END AS idf FROM rawterm)"""
    if questions:
        sql += f""",
question AS ({plain(questions)}),
qterm AS (SELECT kb_id, query_id, t AS term, count(*) AS qtf FROM (
  SELECT kb_id, query_id, unnest(regexp_split_to_array(question, '[{WS}]+')) AS t FROM question)
  WHERE t <> '' GROUP BY ALL)"""
    return sql


def bm25_ctes(chunks: str, questions: str, top_n: int, scope_sql: str | None = None) -> str:
    allowed = (
        f"JOIN ({plain(scope_sql)}) s ON s.query_id = q.query_id AND s.doc_id = c.doc_id"
        if scope_sql
        else ""
    )
    return tok_ctes(chunks, questions) + f""",
hit AS (SELECT q.query_id, p.chunk_id,
  sum(q.qtf * t.idf * p.tf * 2.5 / (p.tf + 1.5 * (0.25 + 0.75 * len.dl / kb.avgdl))) AS s
  FROM qterm q JOIN term t ON q.kb_id = t.kb_id AND q.term = t.term
  JOIN posting p ON p.kb_id = t.kb_id AND p.term = t.term
  JOIN len ON len.kb_id = p.kb_id AND len.chunk_id = p.chunk_id
  JOIN kb ON kb.kb_id = p.kb_id GROUP BY ALL),
eligible AS (SELECT q.query_id, c.kb_id, c.doc_id, c.chunk_id, c.ordinal,
  round(coalesce(hit.s, 0), 10) AS score
  FROM question q JOIN chunk c ON q.kb_id = c.kb_id {allowed}
  LEFT JOIN hit ON hit.query_id = q.query_id AND hit.chunk_id = c.chunk_id),
kept AS (SELECT * FROM (SELECT *, row_number() OVER
  (PARTITION BY query_id ORDER BY score DESC, ordinal) AS rank FROM eligible) WHERE rank <= {top_n}),
lexical AS (SELECT *, CASE WHEN max(score) OVER w = min(score) OVER w THEN 1.0
  ELSE (score - min(score) OVER w) / (max(score) OVER w - min(score) OVER w) END AS bm25
  FROM kept WINDOW w AS (PARTITION BY query_id))"""


def dense_ctes(questions: str, top_n: int, scope_sql: str | None = None) -> str:
    allowed = (
        f"SEMI JOIN ({plain(scope_sql)}) s ON s.query_id = f.query_id AND s.doc_id = f.chunk_id"
        if scope_sql
        else ""
    )
    return f"""
vec AS (SELECT vec_id, CAST(vec_id AS STRING) AS chunk_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
qvec AS (SELECT query_id, CAST(embedding AS DOUBLE[]) AS e FROM ({plain(questions)})),
dist AS (SELECT q.query_id, v.chunk_id, v.vec_id AS ordinal,
  round(greatest(list_inner_product(q.e, q.e) + list_inner_product(v.e, v.e)
    - 2 * list_inner_product(q.e, v.e), 0), 10) AS distance FROM qvec q, vec v),
found AS (SELECT * FROM (SELECT *, row_number() OVER
  (PARTITION BY query_id ORDER BY distance, ordinal) AS rank FROM dist) WHERE rank <= {top_n}),
sim AS (SELECT f.*, 1 / (1 + distance) AS similarity FROM found f {allowed}),
dense AS (SELECT *, CASE WHEN max(similarity) OVER w = min(similarity) OVER w THEN 1.0
  ELSE (similarity - min(similarity) OVER w) / (max(similarity) OVER w - min(similarity) OVER w) END AS dense
  FROM sim WINDOW w AS (PARTITION BY query_id))"""


def route_expr(q: str, mode: str = "'auto'") -> str:
    s = f"regexp_replace({q}, '^[{WS}]+|[{WS}]+$', '', 'g')"
    toks = f"[t for t in regexp_split_to_array({s}, '[{WS}]+') if t <> '']"
    starters = "|".join(routing.SEMANTIC_STARTERS)
    signals = (
        f"(CAST(len({toks}) <= 4 AS INT) + CAST(regexp_matches({s}, '\\p{{Nd}}') AS INT)"
        f" + CAST(len([t for t in {toks} if regexp_matches(t, '\\p{{Lu}}') AND NOT"
        f" regexp_matches(t, '[\\p{{Ll}}\\p{{Lt}}]') AND length(t) >= 2]) > 0 AS INT)"
        f" + CAST(contains({s}, '\"') OR contains({s}, '''') AS INT))"
    )
    semantic = f"regexp_matches(lower({s}), '^({starters})( |$)')"
    return f"""CASE WHEN lower(trim({mode})) IN ('keyword', 'semantic', 'balanced') THEN lower(trim({mode}))
  WHEN {signals} >= 2 AND NOT {semantic} THEN 'keyword'
  WHEN {semantic} AND {signals} = 0 THEN 'semantic' ELSE 'balanced' END"""


def alpha_expr(route: str) -> str:
    return f"CASE {route} WHEN 'keyword' THEN 0.45 WHEN 'semantic' THEN 0.80 ELSE 0.65 END::DOUBLE"


def hybrid_ctes() -> str:
    return (
        bm25_ctes(CHUNKS, QUESTIONS, PARAMS.top_n)
        + ","
        + dense_ctes(HYBRID_QUESTIONS, PARAMS.top_n)
        + f""",
routed AS (SELECT query_id, question, {route_expr('question')} AS route FROM ({plain(HYBRID_QUESTIONS)})),
weighted AS (SELECT *, {alpha_expr('route')} AS alpha FROM routed),
both_sides AS (SELECT coalesce(d.query_id, l.query_id) AS query_id, coalesce(d.chunk_id, l.chunk_id) AS chunk_id,
  coalesce(d.distance, 1.0) AS distance, coalesce(d.dense, 0.0) AS dense, coalesce(l.bm25, 0.0) AS bm25
  FROM dense d FULL JOIN lexical l ON d.query_id = l.query_id AND d.chunk_id = l.chunk_id),
scored AS (SELECT b.*, round(w.alpha * b.dense + (1 - w.alpha) * b.bm25, 10) AS fusion_score
  FROM both_sides b JOIN weighted w USING (query_id)),
fused AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY fusion_score DESC, chunk_id) AS fusion_rank
  FROM scored WHERE fusion_score >= {PARAMS.fusion_threshold}),
passage AS (SELECT CAST(doc_id AS STRING) AS chunk_id, concat('Source: ', source, chr(10),
  regexp_replace(text, '^[{WS}]+|[{WS}]+$', '', 'g')) AS passage FROM documents),
pair AS (SELECT f.*, w.question, p.passage FROM fused f JOIN weighted w USING (query_id)
  JOIN passage p USING (chunk_id) WHERE f.fusion_rank <= {PARAMS.rerank_candidates}),
overlap AS (SELECT * EXCLUDE (question, passage), round(
  len(list_intersect(list_distinct(qt), pt)) / nullif(len(list_distinct(qt)), 0), 10) AS rerank_score FROM (
  SELECT *, [t for t in regexp_split_to_array(question, '[{WS}]+') if t <> ''] AS qt,
    [t for t in regexp_split_to_array(passage, '[{WS}]+') if t <> ''] AS pt FROM pair)),
final AS (SELECT * EXCLUDE (qt, pt) FROM (SELECT *, row_number() OVER
  (PARTITION BY query_id ORDER BY rerank_score DESC, fusion_rank) AS rank FROM overlap)
  WHERE rank <= {PARAMS.rerank_top_k})"""
    )


# --- queries ----------------------------------------------------------------------


@R.add(
    "tokenize_chunks",
    f"""SELECT doc_id, count(t) AS dl, count(DISTINCT t) AS terms,
      md5(coalesce(string_agg(t, ' ' ORDER BY i), '')) AS token_digest
    FROM (SELECT doc_id, unnest(s) AS t, generate_subscripts(s, 1) AS i FROM (
      SELECT doc_id, [t for t in regexp_split_to_array(text, '[{WS}]+') if t <> ''] AS s FROM documents))
    GROUP BY doc_id""",
)
def tokenize_chunks(spark, sf):
    docs = derive(spark, sf, "SELECT doc_id, text FROM {documents}")
    toks = docs.select("doc_id", text.tokens(F.col("text")).alias("t")).filter(F.size("t") > 0)
    return toks.select(
        "doc_id",
        F.size("t").cast("long").alias("dl"),
        F.size(F.array_distinct("t")).cast("long").alias("terms"),
        F.md5(F.array_join("t", " ")).alias("token_digest"),
    )


@R.add(
    "bm25_term_statistics",
    f"WITH {tok_ctes(CHUNKS_BY_LANG)} SELECT kb_id, term, df, round(idf, 6) AS idf FROM term",
)
def bm25_term_statistics(spark, sf):
    lex = index.build_lexical_index(spread(derive(spark, sf, CHUNKS_BY_LANG)))
    return lex.terms.withColumn("idf", F.round("idf", 6))


@R.add(
    "bm25_base_statistics",
    f"WITH {tok_ctes(CHUNKS_BY_LANG)} SELECT kb_id, n, round(avgdl, 6) AS avgdl FROM kb",
)
def bm25_base_statistics(spark, sf):
    lex = index.build_lexical_index(spread(derive(spark, sf, CHUNKS_BY_LANG)))
    return lex.stats.withColumn("avgdl", F.round("avgdl", 6))


@R.add(
    "bm25_scores",
    f"WITH {bm25_ctes(CHUNKS, QUESTIONS, 10)} SELECT query_id, chunk_id, round(round(s, 10), 6) AS score FROM hit",
)
def bm25_scores(spark, sf):
    lex = index.build_lexical_index(spread(derive(spark, sf, CHUNKS)))
    return lexical.score(derive(spark, sf, QUESTIONS), lex).select(
        "query_id", "chunk_id", F.round("score", 6).alias("score")
    )


_TOP = "query_id, chunk_id, round(score, 6) AS score, round(bm25, 6) AS bm25, CAST(rank AS INT) AS rank"


def _top(df):
    return df.select(
        "query_id", "chunk_id", F.round("score", 6).alias("score"), F.round("bm25", 6).alias("bm25"), "rank"
    )


@R.add("bm25_top_chunks", f"WITH {bm25_ctes(CHUNKS, QUESTIONS, 10)} SELECT {_TOP} FROM lexical")
def bm25_top_chunks(spark, sf):
    lex = index.build_lexical_index(spread(derive(spark, sf, CHUNKS)))
    return _top(lexical.top_chunks(derive(spark, sf, QUESTIONS), lex, 10))


@R.add(
    "bm25_top_chunks_in_scope",
    f"WITH {bm25_ctes(CHUNKS, QUESTIONS, 60, SOURCE_SCOPE)} SELECT {_TOP} FROM lexical",
)
def bm25_top_chunks_in_scope(spark, sf):
    lex = index.build_lexical_index(spread(derive(spark, sf, CHUNKS)))
    asked = derive(spark, sf, "SELECT item_id AS query_id, concat('src', CAST(item_id % 20 AS STRING)) AS `group` FROM {benchmark}")
    documents = derive(spark, sf, "SELECT CAST(doc_id AS STRING) AS doc_id, source AS `group` FROM {documents}")
    return _top(
        lexical.top_chunks(derive(spark, sf, QUESTIONS), lex, 60, scope=scope.by_group(asked, documents))
    )


@R.add("bm25_top_chunks_from_store", f"WITH {bm25_ctes(CHUNKS, QUESTIONS, 10)} SELECT {_TOP} FROM lexical")
def bm25_top_chunks_from_store(spark, sf):
    """Three uploads: stale texts and documents that go again, the present texts of most languages, the rest."""
    path = scratch_dir(spark, "lexical-store")
    # Nobody else reads this store, so earlier versions may go.
    settings = {"buckets": 16, "width": 256, "keep": 1}
    chunks = derive(spark, sf, CHUNKS_BY_LANG.replace("lang AS kb_id", "'src' AS kb_id, lang"))
    english = F.coalesce(F.col("lang") == "en", F.lit(False))
    stale = chunks.withColumn("text", F.when(english, F.concat(F.lit("stale "), "text")).otherwise(F.col("text")))
    gone = derive(
        spark,
        sf,
        """SELECT 'src' AS kb_id, concat('page', page_id) AS doc_id, concat('page', page_id) AS chunk_id,
        -1 - page_id AS ordinal, html AS text FROM {pages}""",
    )
    lexical_store.update(spark, path, stale.select(*gone.columns).unionByName(gone), **settings)
    lexical_store.update(spark, path, chunks.filter(english).select(*gone.columns), **settings)
    lexical_store.update(spark, path, removed=gone.select("kb_id", "doc_id"), **settings)
    questions = derive(spark, sf, QUESTIONS)
    lex = lexical_store.read(spark, path, questions, buckets=16)
    return _top(lexical.top_chunks(questions, lex, 10))


@R.add(
    "embedded_chunks",
    f"""WITH token AS (SELECT doc_id, unnest(regexp_split_to_array(text, '[{WS}]+')) AS t FROM documents),
    dim AS (SELECT doc_id, CAST(concat('0x', substr(md5(t), 1, 7)) AS INTEGER) % 64 AS i, count(*)::DOUBLE AS c FROM token WHERE t <> '' GROUP BY ALL)
    SELECT doc_id, i::INTEGER AS dimension, round(((c / sqrt(sum(c * c) OVER (PARTITION BY doc_id)))::FLOAT)::DOUBLE, 6) AS x FROM dim
    UNION ALL SELECT doc_id, NULL, NULL FROM documents WHERE text IS NULL""",
)
def embedded_chunks(spark, sf):
    """The components that are not 0 of every text's vector; one row for a text without a vector."""
    found = index.embed_texts(spread(derive(spark, sf, "SELECT doc_id, text FROM {documents}")))
    cells = found.select("doc_id", F.col("embedding").isNull().alias("none"), F.posexplode_outer("embedding").alias("dimension", "x"))
    return cells.filter((F.col("x") != 0) | F.col("none")).select(
        "doc_id", "dimension", F.round(F.col("x").cast("double"), 6).alias("x")
    )


_DENSE = "query_id, chunk_id, round(distance, 6) AS distance, round(1 / (1 + distance), 6) AS similarity, CAST(rank AS INT) AS rank"


@R.add("dense_top_chunks", f"WITH {dense_ctes(VECTOR_QUESTIONS, 10)} SELECT {_DENSE} FROM found")
def dense_top_chunks(spark, sf):
    found = dense.nearest(derive(spark, sf, VECTOR_QUESTIONS), derive(spark, sf, VECTORS), 10)
    return found.select(
        "query_id",
        "chunk_id",
        F.round("distance", 6).alias("distance"),
        F.round(dense.similarity(F.col("distance")), 6).alias("similarity"),
        "rank",
    )


@R.add("dense_top_chunks_by_grid", f"WITH {dense_ctes(VECTOR_QUESTIONS, 10)} SELECT {_DENSE} FROM found")
def dense_top_chunks_by_grid(spark, sf):
    found = dense.nearest(
        derive(spark, sf, VECTOR_QUESTIONS), derive(spark, sf, VECTORS), 10, max_shipped_values=1
    )
    return found.select(
        "query_id",
        "chunk_id",
        F.round("distance", 6).alias("distance"),
        F.round(dense.similarity(F.col("distance")), 6).alias("similarity"),
        "rank",
    )


# Searches of an index ask for every row whose id is divisible by 100, against all rows.
INDEX_QUESTIONS = f"{VECTOR_QUESTIONS} WHERE vec_id % 100 = 0"


def _vector_index(spark, sf):
    path = scratch_dir(spark, "vector-index")
    vector_index.write_vector_index(derive(spark, sf, VECTORS), path)
    return vector_index.read_vector_index(spark, path)


@R.add("dense_top_chunks_by_cells", f"WITH {dense_ctes(INDEX_QUESTIONS, 10)} SELECT {_DENSE} FROM found")
def dense_top_chunks_by_cells(spark, sf):
    found = vector_index.nearest_in_cells(derive(spark, sf, INDEX_QUESTIONS), _vector_index(spark, sf), 10)
    return found.select(
        "query_id",
        "chunk_id",
        F.round("distance", 6).alias("distance"),
        F.round(dense.similarity(F.col("distance")), 6).alias("similarity"),
        "rank",
    )


@R.add(
    "dense_recall_by_cells",
    f"""WITH {dense_ctes(INDEX_QUESTIONS, 10)} SELECT count(DISTINCT query_id) AS questions, count(*) AS wanted,
    true AS nine_tenths_reached FROM found""",
)
def dense_recall_by_cells(spark, sf):
    questions, indexed = derive(spark, sf, INDEX_QUESTIONS), _vector_index(spark, sf)
    probes = vector_index.probes_for(questions, indexed, 10)
    found = vector_index.nearest_in_cells(questions, indexed, 10, probes)
    exact = dense.nearest(questions, derive(spark, sf, VECTORS), 10)
    return vector_index.recall(found, exact).select(
        "questions", "wanted", (F.col("reached") >= 0.9 * F.col("wanted")).alias("nine_tenths_reached")
    )


@R.add(
    "dense_scores_in_scope",
    f"""WITH {dense_ctes(VECTOR_QUESTIONS, 30, LABEL_SCOPE)}
    SELECT query_id, chunk_id, round(similarity, 6) AS similarity, round(dense, 6) AS dense FROM dense""",
)
def dense_scores_in_scope(spark, sf):
    vectors = derive(spark, sf, VECTORS)
    questions = derive(spark, sf, VECTOR_QUESTIONS)
    found = dense.nearest(questions, vectors, 30)
    labels = scope.by_group(
        questions.withColumnRenamed("label", "group"), vectors.withColumnRenamed("label", "group")
    )
    kept = dense.scoped(found, vectors, labels, questions, 30)
    return dense.with_dense_score(kept).select(
        "query_id",
        "chunk_id",
        F.round("similarity", 6).alias("similarity"),
        F.round("dense", 6).alias("dense"),
    )


_ASKED = "SELECT conv_id, turn, text FROM {conversations} WHERE role = 'user' UNION ALL SELECT -1 - item_id, 0, text FROM {benchmark}"
_ROUTE_MODE = "CASE turn % 5 WHEN 1 THEN ' Keyword ' WHEN 2 THEN 'SEMANTIC' WHEN 3 THEN 'other' ELSE 'auto' END"


@R.add(
    "question_routes",
    f"""SELECT conv_id, turn, route, {alpha_expr('route')} AS alpha, manual_route FROM (
      SELECT conv_id, turn, {route_expr('text')} AS route, {route_expr('text', _ROUTE_MODE)} AS manual_route
      FROM ({plain(_ASKED)}))""",
)
def question_routes(spark, sf):
    asked = derive(spark, sf, _ASKED)
    return asked.select(
        "conv_id",
        "turn",
        routing.route(F.col("text")).alias("route"),
        routing.alpha(routing.route(F.col("text"))).alias("alpha"),
        routing.route(F.col("text"), F.expr(_ROUTE_MODE)).alias("manual_route"),
    )


def run_hybrid(spark, sf, share=False):
    return hybrid.retrieve(
        derive(spark, sf, HYBRID_QUESTIONS),
        with_passage(spread(derive(spark, sf, CHUNKS))),
        derive(spark, sf, VECTORS),
        PARAMS,
        share=share,
    )


_FUSED = """query_id, chunk_id, round(distance, 6) AS distance, round(fusion_score, 6) AS fusion_score,
  CAST(fusion_rank AS INT) AS fusion_rank"""


def _fused(df):
    return df.select(
        "query_id",
        "chunk_id",
        F.round("distance", 6).alias("distance"),
        F.round("fusion_score", 6).alias("fusion_score"),
        "fusion_rank",
    )


@R.add("hybrid_fused", f"WITH {hybrid_ctes()} SELECT {_FUSED} FROM fused")
def hybrid_fused(spark, sf):
    return _fused(run_hybrid(spark, sf).fused)


@R.add(
    "rerank_candidates",
    f"WITH {hybrid_ctes()} SELECT {_FUSED} FROM fused WHERE fusion_rank <= {PARAMS.rerank_candidates}",
)
def rerank_candidates(spark, sf):
    return _fused(fusion.candidates(run_hybrid(spark, sf).fused, PARAMS.rerank_candidates))


@R.add(
    "hybrid_final_sources",
    f"""WITH {hybrid_ctes()} SELECT query_id, chunk_id, round(distance, 6) AS distance,
    round(fusion_score, 6) AS fusion_score, round(rerank_score, 6) AS rerank_score, CAST(rank AS INT) AS rank FROM final""",
)
def hybrid_final_sources(spark, sf):
    return run_hybrid(spark, sf).final.select(
        "query_id",
        "chunk_id",
        F.round("distance", 6).alias("distance"),
        F.round("fusion_score", 6).alias("fusion_score"),
        F.round("rerank_score", 6).alias("rerank_score"),
        "rank",
    )


@R.add(
    "rerank_margin",
    f"""WITH {hybrid_ctes()} SELECT query_id, round(max(CASE WHEN rank = 1 THEN rerank_score END)
    - max(CASE WHEN rank = 2 THEN rerank_score END), 6) AS rerank_margin FROM final GROUP BY query_id""",
)
def rerank_margin(spark, sf):
    return rerank.margin(run_hybrid(spark, sf).final)


@R.add(
    "retrieval_stage_counts",
    f"""WITH {hybrid_ctes()} SELECT w.query_id,
      (SELECT count(*) FROM fused f WHERE f.query_id = w.query_id) AS num_fusion_survivors,
      least((SELECT count(*) FROM fused f WHERE f.query_id = w.query_id), {PARAMS.rerank_candidates}) AS num_reranker_candidates,
      (SELECT count(*) FROM final f WHERE f.query_id = w.query_id) AS num_final_sources FROM weighted w""",
)
def retrieval_stage_counts(spark, sf):
    h = run_hybrid(spark, sf, share=True)
    return fusion.stage_counts(h.questions, h.fused, h.final, h.params.rerank_candidates)


_REQUESTS = """
SELECT b.item_id AS query_id, s.lang AS kb_id,
  CASE b.item_id % 4 WHEN 0 THEN 'all' WHEN 1 THEN 'selected' WHEN 2 THEN 'unheard-of' ELSE 'selected' END AS scope_mode,
  CASE b.item_id % 4 WHEN 1 THEN s.names WHEN 2 THEN s.names ELSE NULL END AS selected
FROM {benchmark} b JOIN (
  SELECT lang, row_number() OVER (ORDER BY lang) - 1 AS k, count(*) OVER () AS langs, @NAMES AS names FROM {documents} GROUP BY lang
) s ON s.k = b.item_id % s.langs"""
_KB_DOCS = "SELECT lang AS kb_id, CAST(doc_id AS STRING) AS doc_id, source AS file_name, doc_id AS doc_order FROM {documents}"


_ACTIVE_SQL = f"""WITH req AS ({plain(_REQUESTS.replace("@NAMES", "list(DISTINCT source)"))}), docs AS ({plain(_KB_DOCS)}),
    named AS (SELECT kb_id, file_name, arg_max(doc_id, doc_order) AS doc_id FROM docs GROUP BY ALL)
    SELECT DISTINCT r.query_id, r.kb_id, d.doc_id FROM req r JOIN docs d ON r.kb_id = d.kb_id
    WHERE r.scope_mode <> 'selected'
    UNION SELECT DISTINCT r.query_id, r.kb_id, n.doc_id FROM req r JOIN named n ON r.kb_id = n.kb_id
    AND list_contains(r.selected, n.file_name) WHERE r.scope_mode = 'selected'"""


@R.add("active_documents", _ACTIVE_SQL)
def active_documents(spark, sf):
    # The selection lists distinct source names, whose number is the size of the name domain.
    requests = derive(spark, sf, _REQUESTS.replace("@NAMES", "collect_set(source)"))
    return scope.active_documents(requests, derive(spark, sf, _KB_DOCS), "doc_order")


_REQUEST_QUESTIONS = f"""SELECT r.kb_id, r.query_id, b.text AS question
FROM ({_REQUESTS}) r JOIN {{benchmark}} b ON b.item_id = r.query_id"""


@R.add(
    "bm25_top_chunks_of_requests",
    f"""WITH {bm25_ctes(CHUNKS_BY_LANG, _REQUEST_QUESTIONS.replace("@NAMES", "list(DISTINCT source)"), 25, _ACTIVE_SQL)}
    SELECT {_TOP} FROM lexical""",
)
def bm25_top_chunks_of_requests(spark, sf):
    """The request's scope: all, the named documents, or - in an unknown mode - all."""
    requests = derive(spark, sf, _REQUESTS.replace("@NAMES", "collect_set(source)"))
    questions = derive(spark, sf, _REQUEST_QUESTIONS.replace("@NAMES", "collect_set(source)"))
    allowed = scope.of_requests(requests, derive(spark, sf, _KB_DOCS), "doc_order")
    lex = index.build_lexical_index(spread(derive(spark, sf, CHUNKS_BY_LANG)))
    return _top(lexical.top_chunks(questions, lex, 25, scope=allowed))


@R.add(
    "retrieval_parameters",
    """SELECT event_id, greatest(1, k - 3) AS top_n, greatest(1, k % 12 - 2) AS top_k,
      greatest(greatest(1, k % 12 - 2), k % 7) AS candidates,
      greatest(0.0, least(1.0, (value - 5) / 10))::DOUBLE AS threshold
    FROM (SELECT event_id, value, CAST(json_extract_string(props, '$.k') AS INT) AS k FROM events)""",
)
def retrieval_parameters(spark, sf):
    from docquarry.operators.parameters import clamp

    events = derive(
        spark, sf, "SELECT event_id, value, CAST(get_json_object(props, '$.k') AS INT) AS k FROM {events}"
    )
    return events.select(
        "event_id",
        *clamp(F.col("k") - 3, F.col("k") % 12 - 2, F.col("k") % 7, (F.col("value") - 5) / 10),
    )

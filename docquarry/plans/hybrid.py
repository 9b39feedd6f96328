"""Many questions against many knowledge bases in one plan."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from docquarry.operators import dense, fusion, index, lexical, rerank, routing
from docquarry.operators.scope import Scope
from docquarry.params import Bm25Params, RetrievalParams
from docquarry.session import written


@dataclass(frozen=True)
class HybridResult:
    questions: DataFrame  # query_id, kb_id, question, route, alpha
    fused: DataFrame
    final: DataFrame
    params: RetrievalParams
    totals: dict[str, int] | None = None  # rows of each stage, where the results were written


def retrieve(
    questions: DataFrame,
    chunks: DataFrame,
    vectors: DataFrame,
    params: RetrievalParams = RetrievalParams(),
    *,
    scope: Scope | DataFrame | None = None,
    share: bool = False,
    lexical_index: index.LexicalIndex | None = None,
    scorer=rerank.token_overlap,
    bm25: Bm25Params = Bm25Params(),
) -> HybridResult:
    """Route, run both branches, fuse, cap and rerank.

    ``questions``: kb_id, query_id, question, embedding; ``chunks``: kb_id,
    doc_id, chunk_id, ordinal, text, passage; ``vectors``: kb_id, doc_id,
    chunk_id, ordinal, embedding.  The scope narrows the lexical branch before
    its top-N and the dense branch after it.  With ``share`` the fused and the final rows are written
    once, for results of which several parts are used, and the rows of each stage are counted on the way.
    """
    p = params.clamped()
    routed = questions.withColumn("route", routing.route(F.col("question"), p.mode)).withColumn(
        "alpha", routing.alpha(F.col("route"))
    )
    lexicon = lexical_index or index.build_lexical_index(chunks, bm25)
    by_words = lexical.top_chunks(routed, lexicon, p.top_n, scope=scope, params=bm25)
    found = dense.scoped(
        dense.nearest(routed, vectors, p.top_n), vectors, scope, routed, p.top_n
    )
    by_vector = dense.with_dense_score(found)
    fused = fusion.fuse(by_vector, by_words, routed, threshold=p.fusion_threshold)
    seen = Observation("fused")
    if share:
        reached = F.count_if(F.col("fusion_rank") <= p.rerank_candidates)
        fused = written(fused.observe(seen, F.count("*").alias("survivors"), reached.alias("candidates")), "fused")
    final = rerank.rerank(
        fusion.candidates(fused, p.rerank_candidates),
        routed,
        chunks,
        p.rerank_top_k,
        scorer,
        per_question=p.rerank_candidates,
    )
    if not share:
        return HybridResult(routed, fused, final, p)
    last = Observation("final")
    final = written(final.observe(last, F.count("*").alias("final_sources")), "final")
    return HybridResult(routed, fused, final, p, {**seen.get, **last.get})

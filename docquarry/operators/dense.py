"""Exact nearest vectors by squared Euclidean distance."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docquarry.functions.shipping import ship_per_question
from docquarry.operators.lexical import normalise
from docquarry.operators.scope import Scope, as_scope

DISTANCE_DIGITS = 10
# Values of question vectors and result lists that a task may hold.
MAX_SHIPPED_VALUES = 4_000_000
GRID_BLOCK_ROWS = 50_000
# Cells of a distance matrix computed at once.
_MATRIX_CELLS = 4_000_000

_OUT = "query_id long, chunk_id string, ordinal long, distance double"


def similarity(distance: Column) -> Column:
    return F.lit(1.0) / (F.lit(1.0) + distance)


def _matrix(vectors: pd.Series) -> np.ndarray:
    return np.stack(vectors.to_numpy()).astype(np.float64)


def _first_cells(dist: np.ndarray, count: int) -> np.ndarray:
    """Columns of the ``count`` smallest values of every row, smallest first, ties by column; NaN is last."""
    count = min(count, dist.shape[1])
    worst = np.partition(dist, count - 1, axis=1)[:, count - 1 : count]
    # Not "at most", so that a row whose values are not numbers keeps its place.
    row, column = np.nonzero(~(dist > worst))
    order = np.lexsort((dist[row, column], row))
    row, column = row[order], column[order]
    first = np.searchsorted(row, np.arange(len(dist)))
    return column[first[:, None] + np.arange(count)]


def _nearest(queries: np.ndarray, rows: pd.DataFrame, top_n: int) -> list[np.ndarray]:
    """[distance, ordinal, chunk id] matrices of the best rows for every question."""
    # Rows in ordinal order break ties by ordinal.
    rows = rows.sort_values("ordinal", kind="stable")
    vectors = _matrix(rows["embedding"])
    norms = (vectors**2).sum(axis=1)
    parts = []
    step = max(1, _MATRIX_CELLS // len(rows))
    for at in range(0, len(queries), step):
        block = queries[at : at + step]
        dist = (block**2).sum(axis=1)[:, None] + norms[None, :] - 2.0 * block @ vectors.T
        dist = np.round(np.maximum(dist, 0.0), DISTANCE_DIGITS)
        # Only the chosen cells are kept, never a view of the whole block.
        best = _first_cells(dist, top_n)
        parts.append((np.take_along_axis(dist, best, axis=1), best))
    picked = np.concatenate([b for _, b in parts])
    return [
        np.concatenate([d for d, _ in parts]),
        rows["ordinal"].to_numpy()[picked],
        rows["chunk_id"].to_numpy()[picked],
    ]


def _merge(old: list[np.ndarray] | None, new: list[np.ndarray], top_n: int) -> list[np.ndarray]:
    """Best rows of two candidate sets, per question."""
    if old is None:
        return new
    both = [np.concatenate(pair, axis=1) for pair in zip(old, new)]
    order = np.lexsort((both[1], both[0]), axis=1)[:, :top_n]
    return [np.take_along_axis(m, order, axis=1) for m in both]


def _as_rows(query_ids: np.ndarray, found: list[np.ndarray]) -> pd.DataFrame:
    distance, ordinal, chunk = found
    return pd.DataFrame(
        {
            "query_id": np.repeat(query_ids, distance.shape[1]),
            "chunk_id": chunk.ravel(),
            "ordinal": ordinal.ravel(),
            "distance": distance.ravel(),
        }
    )


def _by_shipping(questions: DataFrame, vectors: DataFrame, top_n: int) -> DataFrame:
    """Send a bounded question matrix to the vectors; no vector moves.

    A task keeps one list of N per question over all of its batches.
    """
    local = questions.select("kb_id", "query_id", "embedding").toPandas()
    groups = {
        kb: (part["query_id"].to_numpy(), _matrix(part["embedding"]))
        for kb, part in local.groupby("kb_id")
    }
    shipped = vectors.sparkSession.sparkContext.broadcast(groups)

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        best: dict = {}
        for batch in batches:
            for kb, rows in batch.groupby("kb_id"):
                asked = shipped.value.get(kb)
                if asked is not None:
                    best[kb] = _merge(best.get(kb), _nearest(asked[1], rows, top_n), top_n)
        for kb, found in best.items():
            yield _as_rows(shipped.value[kb][0], found)

    return vectors.select("kb_id", "chunk_id", "ordinal", "embedding").mapInPandas(scan, _OUT)


def _by_grid(
    questions: DataFrame, vectors: DataFrame, top_n: int, counts: tuple[int, int]
) -> DataFrame:
    """Block matrix product: every (question block, vector block) pair is one group.

    Blocks are cut by hashed id, so their size is bounded whatever the size of
    a knowledge base; each side is repeated once per block of the other.
    """
    q_blocks = max(1, -(-counts[0] // GRID_BLOCK_ROWS))
    v_blocks = max(1, -(-counts[1] // GRID_BLOCK_ROWS))
    left = questions.select(
        "kb_id",
        "query_id",
        "embedding",
        F.pmod(F.xxhash64("query_id"), F.lit(q_blocks)).alias("qb"),
        F.explode(F.sequence(F.lit(0).cast("long"), F.lit(v_blocks - 1).cast("long"))).alias("vb"),
    )
    right = vectors.select(
        "kb_id",
        "chunk_id",
        "ordinal",
        "embedding",
        F.pmod(F.xxhash64("chunk_id"), F.lit(v_blocks)).alias("vb"),
        F.explode(F.sequence(F.lit(0).cast("long"), F.lit(q_blocks - 1).cast("long"))).alias("qb"),
    )

    def pair(asked: pd.DataFrame, rows: pd.DataFrame) -> pd.DataFrame:
        if asked.empty or rows.empty:
            return pd.DataFrame(columns=["query_id", "chunk_id", "ordinal", "distance"])
        found = _nearest(_matrix(asked["embedding"]), rows, top_n)
        return _as_rows(asked["query_id"].to_numpy(), found)

    return (
        left.groupBy("kb_id", "qb", "vb")
        .cogroup(right.groupBy("kb_id", "qb", "vb"))
        .applyInPandas(pair, _OUT)
    )


def nearest(
    questions: DataFrame,
    vectors: DataFrame,
    top_n: int,
    *,
    max_shipped_values: int = MAX_SHIPPED_VALUES,
) -> DataFrame:
    """Top-N chunks of the whole base: (query_id, chunk_id, ordinal, distance, rank).

    ``questions``: kb_id, query_id, embedding; ``vectors``: kb_id, chunk_id,
    ordinal, embedding.  Both ways keep a local top-N per block before the
    final ranking, so the shuffle is N rows per question and block.  Rows without a
    vector take no part on either side.
    """
    top_n = max(1, int(top_n))
    questions = questions.filter(F.col("embedding").isNotNull())
    vectors = vectors.filter(F.col("embedding").isNotNull())
    width = questions.agg(F.max(F.size("embedding"))).first()[0] or 1
    # A question costs its vector and its list of N; counting stops at the bound.
    bound = max(1, max_shipped_values // (max(1, width) + 3 * top_n))
    asked = questions.select("query_id").limit(bound + 1).count()
    if asked <= bound:
        candidates = _by_shipping(questions, vectors, top_n)
    else:
        candidates = _by_grid(
            questions, vectors, top_n, (questions.count(), vectors.count())
        )
    best = Window.partitionBy("query_id").orderBy("distance", "ordinal")
    return candidates.withColumn("rank", F.row_number().over(best)).filter(
        F.col("rank") <= top_n
    )


def scoped(
    found: DataFrame, vectors: DataFrame, scope: Scope | DataFrame | None, questions: DataFrame, top_n: int
) -> DataFrame:
    """Drop rows outside the scope *after* the top-N, so a scope can shorten the list.

    ``vectors`` names the document of each chunk.
    """
    scope = as_scope(scope)
    if scope is None:
        return found
    small = ship_per_question(found, questions, top_n)
    return scope.allowed(vectors.select("chunk_id", "doc_id").join(small, "chunk_id"))


def with_dense_score(found: DataFrame) -> DataFrame:
    """Similarity and its min-max form; the last row of a repeated chunk counts."""
    rest = [c for c in found.columns if c not in ("query_id", "chunk_id")]
    unique = (
        found.groupBy("query_id", "chunk_id")
        .agg(F.max_by(F.struct(*rest), F.col("rank")).alias("__row"))
        .select("query_id", "chunk_id", "__row.*")
        .withColumn("similarity", similarity(F.col("distance")))
    )
    return normalise(unique, "similarity", "dense")

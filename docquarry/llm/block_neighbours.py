"""Nearest neighbours by largest inner product, as a join of blocks of two matrices.

Queries and candidates are dealt into blocks of bounded bytes; a task gets one block of each.  It
rounds both to 8-bit integers with one scale a vector, so a tile of the product is a product of
small whole numbers.  With ``x = x' + r`` the true product differs from the rounded one by at most
``|q'||r_c| + |r_q||c|``.  Pairs whose upper bound reaches the query's k-th best lower bound survive,
are computed again in double precision, component after component, and enter the query's heap.  The
heaps of a query's tiles are then merged.  No pair is left out, so the result is exact.

Cases: rows without an id, NULL and zero vectors and vectors with a NULL or non-finite component
take no part.  A shorter vector counts as filled up with zeros.  Rows that share an id are one row with
the best of their vectors, on both sides; a query never finds its own id.  Ties go to the
smaller id.  Copies of a vector take ``k + 1`` places of a block at most, as more cannot be found.
An empty table and a table without queries give no rows.  Other columns are not read.
"""

from __future__ import annotations

import heapq

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docquarry.llm.common import settle
from docquarry.llm.vectors import as_matrix, block_count, is_searchable, smallest_of_equal, tiles, widened

BLOCK_BYTES = 16 << 20
# Pairs of one product inside a tile.
STEP_QUERIES, STEP_ROWS = 256, 4096
_FOUND = "query_id bigint, vec_id bigint, score double"


class Rounded:
    """Rows as 8-bit integers times a scale, with the lengths of the rounded rows and of what is lost.

    ``unit`` is the greatest length of the rows; lengths and scales are in that unit.
    """

    def __init__(self, rows: np.ndarray):
        self.rows = rows.astype(np.float64, copy=False)
        scale = np.abs(self.rows).max(axis=1, initial=0) / 127
        safe = np.where(scale > 0, scale, 1)
        codes = np.clip(np.rint(self.rows / safe[:, None]), -127, 127)
        near = codes * safe[:, None]
        length = np.sqrt((self.rows**2).sum(axis=1))
        self.unit = max(float(length.max(initial=0)), 1e-300)
        # Products of 8-bit numbers are whole in single precision up to 1,040 components.
        self.kind = np.float32 if rows.shape[1] <= 1040 else np.float64
        self.codes = codes.astype(np.int8).astype(self.kind)
        self.scale = (safe / self.unit).astype(self.kind)
        self.length = (length / self.unit).astype(self.kind)
        self.near = (np.sqrt((near**2).sum(axis=1)) / self.unit).astype(self.kind)
        self.lost = (np.sqrt(((self.rows - near) ** 2).sum(axis=1)) / self.unit).astype(self.kind)


def bounds(q: Rounded, a: slice, c: Rounded, b: slice) -> tuple[np.ndarray, np.ndarray]:
    """The rounded products of a tile and how far the true ones may lie from them, in units."""
    near = (q.codes[a] @ c.codes[b].T) * q.scale[a, None] * c.scale[None, b]
    # The last two terms cover the rounding of these sums themselves.
    off = q.near[a, None] * c.lost[None, b] + (q.lost[a, None] + np.float32(2e-6) * q.length[a, None]) * c.length[None, b]
    return near, off * np.float32(1.00001) + np.float32(1e-30)


def products(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Row by row, summed in the order of the components, so that equal vectors give equal sums."""
    total = np.zeros(len(left))
    for j in range(left.shape[1]):
        total += left[:, j] * right[:, j]
    return total


class Nearest:
    """The ``k`` best (score, id) of one query so far, each id with its best score."""

    def __init__(self, k: int):
        self.k, self.heap, self.best = k, [], {}

    def push(self, score: float, name: int) -> None:
        held = self.best.get(name)
        if held is not None:
            if score > held:
                self.heap[self.heap.index((held, -name))] = (score, -name)
                heapq.heapify(self.heap)
                self.best[name] = score
        elif len(self.heap) < self.k:
            heapq.heappush(self.heap, (score, -name))
            self.best[name] = score
        elif (score, -name) > self.heap[0]:
            out = heapq.heapreplace(self.heap, (score, -name))
            del self.best[-out[1]]
            self.best[name] = score

    @property
    def floor(self) -> float:
        return self.heap[0][0] if len(self.heap) == self.k else -np.inf


def search_tile(q_ids: np.ndarray, q_rows: np.ndarray, c_ids: np.ndarray, c_rows: np.ndarray, k: int) -> list[Nearest]:
    """A heap for each query row over all candidate rows of the tile."""
    width = max(q_rows.shape[1], c_rows.shape[1])
    kept = smallest_of_equal(c_rows, c_ids, k + 1)
    kept = kept[np.argsort(c_ids[kept], kind="stable")]
    c_ids = c_ids[kept]
    q, c = Rounded(widened(q_rows, width)), Rounded(widened(c_rows[kept], width))
    unit = q.unit * c.unit
    spare = len(c_ids) - len(np.unique(c_ids))
    heaps = [Nearest(k) for _ in q_ids]
    for i in range(0, len(q_ids), STEP_QUERIES):
        a = slice(i, i + STEP_QUERIES)
        for j in range(0, len(c_ids), STEP_ROWS):
            b = slice(j, j + STEP_ROWS)
            near, off = bounds(q, a, c, b)
            own = q_ids[a, None] == c_ids[None, b]
            floor = np.array([h.floor for h in heaps[a]]) / unit
            first = k + spare
            if np.isneginf(floor).any() and near.shape[1] - 1 > first:
                low = np.where(own, -np.inf, near - off)
                floor = np.maximum(floor, np.partition(low, -first, axis=1)[:, -first])
            # A little lower, as the division of the exact floor rounds as well.
            high = np.where(np.isneginf(floor), -np.inf, floor - np.abs(floor) * 1e-6)
            x, y = np.nonzero((near + off >= high[:, None]) & ~own)
            for p in range(0, len(x), 1 << 18):
                u, v = x[p : p + (1 << 18)] + i, y[p : p + (1 << 18)] + j
                for n, name, score in zip(u.tolist(), c_ids[v].tolist(), products(q.rows[u], c.rows[v]).tolist()):
                    heaps[n].push(score, name)
    return heaps


def _tile(k: int):
    def search(asked: pa.Table, rows: pa.Table) -> pa.Table:
        out: dict[str, list] = {"query_id": [], "vec_id": [], "score": []}
        if asked.num_rows and rows.num_rows:
            q_ids = asked["id"].to_numpy()
            heaps = search_tile(
                q_ids, as_matrix(asked["vector"], np.float64), rows["id"].to_numpy(), as_matrix(rows["vector"], np.float64), k
            )
            for query, heap in zip(q_ids.tolist(), heaps):
                for score, name in heap.heap:
                    out["query_id"].append(query)
                    out["vec_id"].append(-name)
                    out["score"].append(score)
        return pa.table(out, schema=pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.float64())]))

    return search


def nearest_neighbours(
    vectors: DataFrame,
    is_query: Column,
    k: int,
    *,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    block_bytes: int = BLOCK_BYTES,
) -> DataFrame:
    """(query_id, rank, vec_id, score): the ``k`` nearest other rows of each row that ``is_query`` holds for."""
    vector = F.col(f"`{vector_col}`")
    rows = settle(
        vectors.filter(F.col(f"`{id_col}`").isNotNull() & is_searchable(vector))
        .select(
            F.col(f"`{id_col}`").cast("bigint").alias("id"),
            vector.alias("vector"),
            F.coalesce(is_query, F.lit(False)).alias("asks"),
        )
        # A row that repeats id and vector is one row; then no block can grow by copies of one row.
        .distinct(),
        "vectors",
    )
    count = rows.agg(F.count("*"), F.count_if("asks"), F.coalesce(F.max(F.size("vector")), F.lit(1))).first()
    cores = vectors.sparkSession.sparkContext.defaultParallelism
    q_blocks = block_count(count[1], count[1] * count[2], block_bytes)
    c_blocks = block_count(count[0], count[0] * count[2], block_bytes, -(-2 * cores // q_blocks))

    def block(number: int, seed: int) -> Column:
        return F.pmod(F.xxhash64(F.lit(seed), "id", "vector"), F.lit(number))

    asked = tiles(rows.filter("asks").select("id", "vector", block(q_blocks, 1).alias("q")), "q", "c", c_blocks)
    found = tiles(rows.select("id", "vector", block(c_blocks, 2).alias("c")), "c", "q", q_blocks)
    heaps = asked.groupBy("q", "c").cogroup(found.groupBy("q", "c")).applyInArrow(_tile(k), _FOUND)
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return (
        heaps.repartition("query_id")
        .groupBy("query_id", "vec_id")
        .agg(F.max("score").alias("score"))
        .withColumn("rank", F.row_number().over(best))
        .filter(F.col("rank") <= k)
        .select("query_id", "rank", "vec_id", "score")
    )

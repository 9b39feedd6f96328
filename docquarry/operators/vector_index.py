"""Inverted-file index of vectors: cells of near vectors as partitions of a table.

Centres come from k-means over a bounded sample; every vector is filed under its nearest centre, with its
distance from it.  A search visits a question's nearest cells only.  It is exact if asked to: a cell
cannot hold a vector nearer than the distance to its centre less its radius, so all cells are visited that
this bound lets compete with the question's N-th best vector of the first ones.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from docquarry.operators import dense
from docquarry.session import ensure_checkpoint_dir

# Rows that the centres are fitted on, and how many cells (and values of centres) there may be.
MAX_FIT_ROWS = 50_000
MAX_CELLS = 4_096
MAX_CENTRE_VALUES = 4_000_000
# Cells that an exact search visits before it knows its bound.
FIRST_PROBES = 4
# Questions that the number of probes is measured on.
CALIBRATION_QUESTIONS = 1_000
# Share of a squared distance that rounding may cost.
_SLACK = 1e-9

_OUT = "query_id long, chunk_id string, ordinal long, distance double, cell int"


@dataclass(frozen=True)
class VectorIndex:
    """rows(kb_id, doc_id, chunk_id, ordinal, embedding, reach, cell), cells(cell, centre, n, radius)."""

    rows: DataFrame
    cells: DataFrame


def _hash_sample(rows: DataFrame, key: str, bound: int) -> DataFrame:
    """About ``bound`` rows, chosen by a hash of ``key`` alone."""
    share = min(1.0, bound / max(1, rows.count()))
    return rows.filter(F.pmod(F.xxhash64(F.lit(11), key), F.lit(1 << 20)) < math.ceil(share * (1 << 20)))


def fit_centres(vectors: DataFrame, cells: int | None = None, *, max_fit_rows: int = MAX_FIT_ROWS) -> np.ndarray:
    """Centres by k-means over about ``max_fit_rows`` rows; by default the root of the number of rows."""
    vectors = vectors.filter(F.col("embedding").isNotNull())
    facts = vectors.agg(F.count("*"), F.max(F.size("embedding"))).first()
    if not facts[0]:
        return np.zeros((0, 0))
    most = max(1, min(MAX_CELLS, MAX_CENTRE_VALUES // max(1, facts[1])))
    k = max(1, min(most, cells or round(math.sqrt(facts[0]))))
    sample = _hash_sample(vectors, "chunk_id", max_fit_rows).select(array_to_vector("embedding").alias("features"))
    if k == 1 or sample.limit(2).count() < 2:
        mean = vectors.select(F.posexplode("embedding").alias("i", "x")).groupBy("i").agg(F.avg("x").alias("x"))
        return np.array([[r["x"] for r in mean.orderBy("i").collect()]])
    model = KMeans(k=k, seed=7, maxIter=10, featuresCol="features").fit(sample)
    return np.stack(model.clusterCenters())


def _gaps(vectors: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """Distance of every vector to every centre."""
    squares = (vectors**2).sum(axis=1)[:, None] + (centres**2).sum(axis=1)[None, :] - 2 * vectors @ centres.T
    return np.sqrt(np.maximum(squares, 0))


def file_vectors(vectors: DataFrame, centres: np.ndarray) -> DataFrame:
    """Every row that has a vector, with its ``cell`` and its distance ``reach`` from the centre."""
    shipped = vectors.sparkSession.sparkContext.broadcast(centres)

    @F.pandas_udf("cell int, reach double")
    def nearest(batch: pd.Series) -> pd.DataFrame:
        rows = dense._matrix(batch)
        cell = _gaps(rows, shipped.value).argmin(axis=1)
        # Not by the product form: a radius must not be too small.
        reach = np.sqrt(((rows - shipped.value[cell]) ** 2).sum(axis=1))
        return pd.DataFrame({"cell": cell.astype(np.int32), "reach": reach})

    return (
        vectors.filter(F.col("embedding").isNotNull())
        .select("kb_id", "doc_id", "chunk_id", "ordinal", "embedding", nearest("embedding").alias("__at"))
        .select("kb_id", "doc_id", "chunk_id", "ordinal", "embedding", "__at.reach", "__at.cell")
    )


def _append(rows: DataFrame, path: str) -> None:
    # AQE splits a large cell over many writers.
    rows.hint("rebalance", "cell").write.mode("append").partitionBy("cell").parquet(f"{path}/rows")


def write_vector_index(vectors: DataFrame, path: str, cells: int | None = None) -> None:
    """Fit centres on a bounded sample and file every vector; ``vectors``: kb_id, doc_id, chunk_id, ordinal, embedding."""
    centres = fit_centres(vectors, cells)
    table = [(n, [float(x) for x in centre]) for n, centre in enumerate(centres)]
    spark = vectors.sparkSession
    spark.createDataFrame(table, "cell int, centre array<double>").coalesce(1).write.parquet(f"{path}/centres")
    _append(file_vectors(vectors, centres) if len(centres) else _nothing(vectors), path)


def _nothing(vectors: DataFrame) -> DataFrame:
    empty = vectors.select("kb_id", "doc_id", "chunk_id", "ordinal", "embedding").limit(0)
    return empty.withColumns({"reach": F.lit(0.0), "cell": F.lit(0)})


def add_vectors(vectors: DataFrame, path: str) -> None:
    """File further vectors under the centres there are; radii grow with them, so exact searches stay exact."""
    centres = _centres(vectors.sparkSession.read.parquet(f"{path}/centres"))
    _append(file_vectors(vectors, centres), path)


def read_vector_index(spark: SparkSession, path: str) -> VectorIndex:
    centres = spark.read.parquet(f"{path}/centres")
    schema = "kb_id string, doc_id string, chunk_id string, ordinal long, embedding array<float>, reach double, cell int"
    rows = spark.read.schema(schema).parquet(f"{path}/rows")
    filed = rows.groupBy("cell").agg(F.count("*").alias("n"), F.max("reach").alias("radius"))
    return VectorIndex(rows, filed.join(centres, "cell"))


def _centres(table: DataFrame) -> np.ndarray:
    """At most MAX_CENTRE_VALUES numbers."""
    found = table.select("cell", "centre").orderBy("cell").collect()
    return np.array([r["centre"] for r in found])


def visits(questions: DataFrame, index: VectorIndex, first: int, last: int | None = None) -> DataFrame:
    """(kb_id, query_id, embedding, cell, place, bound): a question's cells by nearness of the centre.

    ``place`` counts from 1; ``bound`` is the least squared distance that a vector of the cell may have.
    """
    cells = index.cells.orderBy("cell").collect()
    names = np.array([c["cell"] for c in cells], dtype=np.int32)
    centres = np.array([c["centre"] for c in cells])
    radii = np.array([c["radius"] for c in cells])
    shipped = questions.sparkSession.sparkContext.broadcast((names, centres, radii))

    @F.pandas_udf("array<struct<cell:int,place:int,bound:double>>")
    def ordered(batch: pd.Series) -> pd.Series:
        names, centres, radii = shipped.value
        gaps = _gaps(dense._matrix(batch), centres)
        order = np.argsort(gaps, axis=1, kind="stable")[:, first:last]
        out = []
        for row, places in zip(gaps, order):
            near = np.maximum(row[places] * (1 - _SLACK) - radii[places] * (1 + _SLACK) - 1e-7, 0) ** 2
            out.append([{"cell": int(names[c]), "place": first + n + 1, "bound": float(b)} for n, (c, b) in enumerate(zip(places, near))])
        return pd.Series(out)

    asked = questions.filter(F.col("embedding").isNotNull()).select("kb_id", "query_id", "embedding")
    if not len(names):
        return asked.select("*", *[F.lit(0).cast(t).alias(c) for c, t in (("cell", "int"), ("place", "int"), ("bound", "double"))]).limit(0)
    return asked.withColumn("__cells", ordered("embedding")).select("kb_id", "query_id", "embedding", F.inline("__cells"))


def _searched(visited: DataFrame, index: VectorIndex, top_n: int, block_rows: int) -> DataFrame:
    """The best rows of each visited cell, N of a question and block at most.

    Both sides of a cell are cut into blocks by hashed id, so that a cell with a great part of all vectors
    or questions is many tasks.
    """
    ensure_checkpoint_dir(visited.sparkSession)
    asked = visited.select("cell").groupBy("cell").agg(F.count("*").alias("asked"))
    # A row a cell, at most MAX_CELLS.
    sizes = (
        index.cells.select("cell", "n")
        .join(asked, "cell")
        .select("cell", *[F.ceil(F.col(c) / block_rows).cast("int").alias(b) for c, b in (("n", "v_blocks"), ("asked", "q_blocks"))])
        .checkpoint()
    )
    wanted = [r["cell"] for r in sizes.select("cell").collect()]
    rows = index.rows.filter(F.col("cell").isin(wanted))

    def block(key: str, number: str):
        return F.pmod(F.xxhash64(key), F.col(number)).cast("int")

    def every(number: str):
        return F.explode(F.sequence(F.lit(0), F.col(number) - 1))

    left = visited.join(F.broadcast(sizes), "cell").select(
        "kb_id", "query_id", "embedding", "cell", block("query_id", "q_blocks").alias("qb"), every("v_blocks").alias("vb")
    )
    right = rows.join(F.broadcast(sizes), "cell").select(
        "kb_id", "chunk_id", "ordinal", "embedding", "cell", block("chunk_id", "v_blocks").alias("vb"), every("q_blocks").alias("qb")
    )

    def pair(key: tuple, asked: pd.DataFrame, rows: pd.DataFrame) -> pd.DataFrame:
        if asked.empty or rows.empty:
            return pd.DataFrame(columns=["query_id", "chunk_id", "ordinal", "distance", "cell"])
        found = dense._nearest(dense._matrix(asked["embedding"]), rows, top_n)
        return dense._as_rows(asked["query_id"].to_numpy(), found).assign(cell=np.int32(key[1]))

    groups = ["kb_id", "cell", "qb", "vb"]
    return left.groupBy(*groups).cogroup(right.groupBy(*groups)).applyInPandas(pair, _OUT)


def _ranked(found: DataFrame, top_n: int) -> DataFrame:
    best = Window.partitionBy("query_id").orderBy("distance", "ordinal")
    return found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= top_n)


def nearest_in_cells(
    questions: DataFrame,
    index: VectorIndex,
    top_n: int,
    probes: int | None = None,
    *,
    block_rows: int = dense.GRID_BLOCK_ROWS,
) -> DataFrame:
    """(query_id, chunk_id, ordinal, distance, cell, rank), as ``dense.nearest``.

    With ``probes``, the best of that many nearest cells (see :func:`probes_for`).  Without, the same
    rows as ``dense.nearest``: the first cells give each question a bound, then the rest of the cells that may
    hold something as near are searched; a question with fewer than N rows so far visits all.
    """
    top_n = max(1, int(top_n))
    if probes is not None:
        return _ranked(_searched(visits(questions, index, 0, max(1, probes)), index, top_n, block_rows), top_n)
    ensure_checkpoint_dir(questions.sparkSession)
    first = _ranked(_searched(visits(questions, index, 0, FIRST_PROBES), index, top_n, block_rows), top_n).checkpoint()
    known = first.filter(F.col("rank") == top_n).select("query_id", F.col("distance").alias("worst"))
    rest = (
        visits(questions, index, FIRST_PROBES)
        .join(known, "query_id", "left")
        # Distances are compared as rounded.
        .filter(F.col("worst").isNull() | (F.col("bound") <= F.col("worst") + 10.0 ** -(dense.DISTANCE_DIGITS - 1)))
        .drop("worst")
        .checkpoint()
    )
    more = _searched(rest, index, top_n, block_rows)
    return _ranked(first.drop("rank").unionByName(more), top_n)


def probes_for(
    questions: DataFrame, index: VectorIndex, top_n: int, recall: float = 0.95, *, max_questions: int = CALIBRATION_QUESTIONS
) -> int:
    """Fewest cells to visit so that this share of true neighbours is found, by about ``max_questions`` questions.

    The exact search tells the cell of every true neighbour; its place among the question's cells is
    the number of visits that it takes.
    """
    asked = _hash_sample(questions, "query_id", max_questions)
    found = nearest_in_cells(asked, index, top_n).select("query_id", "cell")
    places = visits(asked, index, 0).select("query_id", "cell", "place").join(found, ["query_id", "cell"])
    # A row a place, at most MAX_CELLS.
    counts = sorted((r["place"], r["count"]) for r in places.groupBy("place").count().collect())
    total, so_far = sum(n for _, n in counts), 0
    for place, n in counts:
        so_far += n
        if so_far >= recall * total:
            return place
    return 1


def recall(found: DataFrame, exact: DataFrame) -> DataFrame:
    """One row (questions, wanted, reached): how many true neighbours were found."""
    hit = found.select("query_id", "chunk_id", F.lit(1).alias("__hit"))
    joined = exact.select("query_id", "chunk_id").join(hit, ["query_id", "chunk_id"], "left")
    return joined.agg(
        F.countDistinct("query_id").alias("questions"), F.count("*").alias("wanted"), F.count("__hit").alias("reached")
    )

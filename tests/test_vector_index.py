"""The inverted-file vector index against the exact search."""

import random

import pytest
from pyspark.sql import functions as F

from docquarry.operators import dense, vector_index

VECTORS = "kb_id string, doc_id string, chunk_id string, ordinal long, embedding array<float>"
QUESTIONS = "kb_id string, query_id long, embedding array<float>"


def clustered(seed, count, groups=6, width=5):
    """Vectors around a few points, one of them with half of the rows, some of them copies."""
    rng = random.Random(seed)
    points = [[rng.gauss(0, 6) for _ in range(width)] for _ in range(groups)]
    out = []
    for n in range(count):
        point = points[0] if n % 2 else rng.choice(points)
        out.append([x + rng.gauss(0, 1) for x in point] if n % 7 else [round(x) + 0.0 for x in point])
    return out


@pytest.fixture(scope="module")
def tables(spark):
    rows = [("ab"[n % 9 == 0], f"d{n}", f"c{n}", n, v) for n, v in enumerate(clustered(1, 300))]
    vectors = spark.createDataFrame([*rows, ("a", "d", "none", 999, None)], VECTORS)
    asked = [("ab"[n % 3 == 0], n, v) for n, v in enumerate(clustered(2, 40))] + [("a", 99, None), ("unknown", 98, [0.0] * 5)]
    return vectors, spark.createDataFrame(asked, QUESTIONS)


def found(df):
    return sorted((r["query_id"], r["rank"], r["chunk_id"], round(r["distance"], 8)) for r in df.collect())


@pytest.mark.parametrize("top_n,block_rows", [(5, 10_000), (5, 7), (60, 11)])
def test_exact_search_equals_nearest(spark, tables, tmp_path, top_n, block_rows):
    vectors, questions = tables
    path = str(tmp_path / "index")
    vector_index.write_vector_index(vectors.filter("ordinal < 200 or embedding is null"), path, 12)
    vector_index.add_vectors(vectors.filter("ordinal >= 200"), path)
    indexed = vector_index.read_vector_index(spark, path)
    assert indexed.rows.count() == 300
    got = vector_index.nearest_in_cells(questions, indexed, top_n, block_rows=block_rows)
    assert found(got) == found(dense.nearest(questions, vectors, top_n))


def test_few_cells_reach_the_recall_they_were_chosen_for(spark, tables, tmp_path):
    vectors, questions = tables
    path = str(tmp_path / "index")
    vector_index.write_vector_index(vectors, path, 16)
    indexed = vector_index.read_vector_index(spark, path)
    exact = dense.nearest(questions, vectors, 5)
    probes = vector_index.probes_for(questions, indexed, 5, 0.9)
    row = vector_index.recall(vector_index.nearest_in_cells(questions, indexed, 5, probes), exact).first()
    assert row["reached"] >= 0.9 * row["wanted"] and probes < indexed.cells.count()
    # Fewer visits look at fewer rows, every one of them filed under a visited cell.
    one = vector_index.visits(questions, indexed, 0, 1)
    assert one.groupBy("query_id").count().agg(F.max("count")).first()[0] == 1


def test_no_vectors_and_one_vector(spark, tables, tmp_path):
    vectors, questions = tables
    for name, some, count in (("none", vectors.limit(0), 0), ("one", vectors.filter("ordinal = 1"), 1)):
        path = str(tmp_path / name)
        vector_index.write_vector_index(some, path)
        indexed = vector_index.read_vector_index(spark, path)
        assert found(vector_index.nearest_in_cells(questions, indexed, 3)) == found(dense.nearest(questions, some, 3))
        assert indexed.rows.count() == count

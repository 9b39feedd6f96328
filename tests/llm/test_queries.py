"""The corpus queries against their SQL on the smallest tables."""

import os

import pytest

from docquarry.llm import queries
from workload import check

SF = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(SF), reason="test tables not present")
@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_query(spark, name):
    con = check.connect(SF)
    status, note, _, _ = check.compare(spark, con, name, queries.QUERIES[name], queries.ORACLES.get(name), SF)
    assert status in ("ok", "rows"), note


def test_held_out_language_accuracy(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang")
    found = queries.op7(spark, SF).filter("held_out").join(docs, "doc_id").collect()
    assert sum(r.lang == r.lang_pred for r in found) >= 0.95 * len(found)


def test_toxic_documents_are_found(spark):
    """Every document was scored by a model that saw a third of the labels at least."""
    sf = "/root/testdata/sf0.01"
    if not os.path.isdir(sf):
        pytest.skip("test tables not present")
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    rows = queries.op10(spark, sf).join(labels.select("doc_id", labels["toxic"].alias("known")), "doc_id").collect()
    right = sum(r.toxic == bool(r.known) for r in rows)
    assert right >= 0.97 * len(rows)

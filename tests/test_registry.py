"""Queries against their SQL on the smallest tables, and contract checks."""

import os

import pytest

import __spark_entry__ as entry
from workload import check
from workload.catalog import REGISTRY

SF = "/root/testdata/sf0.001"
SAMPLE = [
    "hybrid_final_sources",
    "bm25_top_chunks_in_scope",
    "dense_scores_in_scope",
    "file_chunks",
    "question_admission",
    "answer_f1_metrics",
    "case_judgements",
    "latency_summary",
    "reference_evaluation_rules",
]


def test_every_query_has_sql():
    own, sql = set(REGISTRY.queries), set(REGISTRY.oracles)
    assert own == sql
    assert own <= set(entry.queries()) and sql <= set(entry.oracle_sql())
    assert len(entry.queries()) > 120


@pytest.mark.skipif(not os.path.isdir(SF), reason="test tables not present")
@pytest.mark.parametrize("name", SAMPLE)
def test_query_equals_sql(spark, name):
    con = check.connect(SF)
    status, note, _, _ = check.compare(spark, con, name, entry.queries()[name], entry.oracle_sql()[name], SF)
    assert status == "ok", note


@pytest.mark.skipif(not os.path.isdir(SF), reason="test tables not present")
def test_partitioning_does_not_change_results(spark, rows):
    query = entry.queries()["hybrid_final_sources"]
    before = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        spark.conf.set("spark.sql.shuffle.partitions", "1")
        one = rows(query(spark, SF))
        spark.conf.set("spark.sql.shuffle.partitions", "7")
        seven = rows(query(spark, SF))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert one == seven and one

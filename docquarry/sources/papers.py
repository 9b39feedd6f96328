"""Question-answer papers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docquarry import schemas
from docquarry.sources.json_arrays import read_elements


def read_papers(spark: SparkSession, path: str) -> DataFrame:
    """Source dataset; only the columns named here are scanned."""
    return spark.read.schema(schemas.papers()).parquet(path).select("id", "qas", "full_text")


def read_saved_papers(spark: SparkSession, path: str) -> DataFrame:
    """Saved papers from one or many JSON array files.

    ``file`` and ``paper_ordinal`` (position in the file) give their order.  Papers are read one at a
    time, so a file may be large.  A file without a list, an empty list and a paper that does not fit the
    schema fail the job.
    """
    paper = F.from_json("value", schemas.SAVED_PAPER_DDL, {"mode": "FAILFAST"})
    return read_elements(spark, path).select(
        "file", F.col("ordinal").alias("paper_ordinal"), paper.alias("__p")
    ).select("file", "paper_ordinal", "__p.*")

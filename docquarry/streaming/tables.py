"""Tables written one micro-batch at a time."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession


def batch_rows(spark: SparkSession, path: str, batch_id: int) -> DataFrame | None:
    """What a batch wrote; None if it wrote no rows."""
    try:
        return spark.read.parquet(f"{path}/batch={batch_id}")
    except AnalysisException as error:
        if error.getCondition() in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            return None
        raise


def replace_batch(rows: DataFrame, path: str, batch_id: int) -> None:
    """Write a batch to its own partition, so a retry replaces it."""
    rows.write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

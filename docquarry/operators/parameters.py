"""Floor and ceiling rules for per-question retrieval settings."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def clamp(top_n: Column, top_k: Column, candidates: Column, threshold: Column) -> list[Column]:
    """Columns top_n >= 1, top_k >= 1, candidates >= top_k, threshold in [0, 1]."""
    kept = F.greatest(F.lit(1), top_k.cast("int"))
    return [
        F.greatest(F.lit(1), top_n.cast("int")).alias("top_n"),
        kept.alias("top_k"),
        F.greatest(kept, candidates.cast("int")).alias("candidates"),
        F.greatest(F.lit(0.0), F.least(F.lit(1.0), threshold)).alias("threshold"),
    ]

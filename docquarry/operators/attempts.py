"""Resolution of append-only attempt histories."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

ANSWER_TIERS = ("success",)
JUDGE_TIERS = ("success", "generation_error")


def latest(
    attempts: DataFrame,
    keys: Sequence[str],
    order: str,
    tiers: Sequence[str] = ANSWER_TIERS,
    status: str = "status",
) -> DataFrame:
    """The deciding attempt per key: last of the best status tier, else the last.

    An aggregate with map-side combine, so a key with very many attempts never
    gathers in one task.  ``order`` is the file order, not the attempt number.
    Adds ``first_seen`` (the key's place in the file) and ``attempt_count``.
    """
    tier = F.lit(0)
    for rank, name in enumerate(reversed(tiers), start=1):
        tier = F.when(F.col(status) == name, rank).otherwise(tier)
    rest = [c for c in attempts.columns if c not in keys]
    return (
        attempts.groupBy(*keys)
        .agg(
            F.max_by(F.struct(*rest), F.struct(tier, F.col(order))).alias("__row"),
            F.min(order).alias("first_seen"),
            F.count("*").alias("attempt_count"),
        )
        .select(*keys, "__row.*", "first_seen", "attempt_count")
    )


def duplicate_count(resolved: DataFrame) -> DataFrame:
    """Attempts beyond the first, over all keys."""
    return resolved.agg(
        F.coalesce(F.sum(F.col("attempt_count") - 1), F.lit(0)).alias("duplicate_attempts")
    )


def inconsistent_keys(attempts: DataFrame, keys: Sequence[str], fixed: Sequence[str]) -> DataFrame:
    """Keys whose ``fixed`` columns changed between attempts."""
    seen = F.xxhash64(*fixed)
    return (
        attempts.groupBy(*keys)
        .agg(F.min(seen).alias("__lo"), F.max(seen).alias("__hi"))
        .filter(F.col("__lo") != F.col("__hi"))
        .select(*keys)
    )


def counters(attempts: DataFrame, resolved: DataFrame) -> DataFrame:
    """Attempt totals of a judge history as one row."""
    every = attempts.agg(
        F.count("*").alias("score_attempt_records"),
        F.count_if(F.col("status") == "judge_error").alias("judge_error_attempt_count"),
    )
    final = resolved.agg(
        F.count_if(F.col("status").isin("success", "generation_error")).alias(
            "completed_resume_keys"
        ),
        F.count_if(F.col("status") == "judge_error").alias("unresolved_judge_error_count"),
        F.count_if(F.col("status") == "success").alias("successful_judgments"),
    )
    return every.join(final)

"""Broadcasts whose size is proven before the plan is built."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MAX_SHIPPED_ROWS = 500_000
MAX_SHIPPED_BYTES = 64 << 20


def ship_per_question(
    rows: DataFrame, questions: DataFrame, per_question: int, max_rows: int = MAX_SHIPPED_ROWS
) -> DataFrame:
    """Broadcast ``rows`` if questions x ``per_question`` stays within the bound.

    ``rows`` must hold at most ``per_question`` rows per question.  Questions
    are counted up to the bound only.  Within it, a join with a whole table of
    texts or vectors leaves that table where it is; beyond it Catalyst plans a
    shuffle join.
    """
    most = max_rows // max(1, per_question)
    fits = questions.select("query_id").limit(most + 1).count() <= most
    return F.broadcast(rows) if fits else rows


def ship_texts(rows: DataFrame, body: str, max_bytes: int = MAX_SHIPPED_BYTES) -> DataFrame:
    """Broadcast ``rows`` if their texts, with 64 bytes a row for the rest, stay within the bound."""
    size = rows.agg(F.sum(F.coalesce(F.octet_length(body), F.lit(0)) + 64)).first()[0] or 0
    return F.broadcast(rows) if size <= max_bytes else rows

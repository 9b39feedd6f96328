"""Token multisets inside a row, without exploding and regrouping.

A sorted token array holds equal tokens side by side, so counts are the
lengths of its runs.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_RUNS = "array<struct<term:string,tf:bigint>>"
# Joins a token with its occurrence number; tokens never contain whitespace.
_MARK = " "


def with_token_counts(df: DataFrame, tokens: Column, name: str) -> DataFrame:
    """Adds ``name``: array of (term, tf), one entry per distinct token."""
    ordered = df.withColumn("__sorted", F.sort_array(tokens))
    here = F.col("__sorted")
    last = F.filter(
        F.sequence(F.lit(0), F.size(here) - 1),
        lambda i: ~F.get(here, i).eqNullSafe(F.get(here, i + 1)),
    )
    marked = ordered.withColumn("__ends", F.when(F.size(here) > 0, last))
    ends = F.col("__ends")
    runs = F.transform(
        ends,
        lambda end, k: F.struct(
            F.get(here, end).alias("term"),
            (end - F.coalesce(F.get(ends, k - 1), F.lit(-1))).cast("long").alias("tf"),
        ),
    )
    return marked.withColumn(name, F.coalesce(runs, F.array().cast(_RUNS))).drop("__sorted", "__ends")


def numbered(counts: Column) -> Column:
    """Array with one distinct entry per occurrence: term plus its number."""
    return F.flatten(
        F.transform(
            counts,
            lambda c: F.transform(
                F.sequence(F.lit(1).cast("long"), c["tf"]),
                lambda k: F.concat(c["term"], F.lit(_MARK), k.cast("string")),
            ),
        )
    )


def overlap(left: Column, right: Column) -> Column:
    """Size of the multiset intersection of two :func:`numbered` arrays."""
    return F.size(F.array_intersect(left, right))

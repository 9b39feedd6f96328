"""Zero-filled distributions over fixed domains."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def domain_counts(
    df: DataFrame,
    value: Column,
    domain: Sequence[str],
    *,
    keys: Sequence[str] = (),
    other: str | None = None,
    name: str = "label",
    count: str = "n",
) -> DataFrame:
    """One row per domain value (and key), 0 included.

    Conditional counts combine map-side into one row per key, so no domain join
    and no hot value.  ``other`` collects NULL and values outside the domain.
    """
    matches = [(d, value == d) for d in domain]
    if other is not None:
        matches.append((other, ~F.coalesce(value.isin(*domain), F.lit(False))))
    wide = df.groupBy(*keys).agg(
        *[F.count_if(F.coalesce(c, F.lit(False))).alias(f"__{i}") for i, (_, c) in enumerate(matches)]
    )
    cells = F.array(
        *[
            F.struct(F.lit(d).alias(name), F.col(f"__{i}").alias(count))
            for i, (d, _) in enumerate(matches)
        ]
    )
    return wide.select(*keys, F.inline(cells))


def for_each(listed: DataFrame, counted: DataFrame, zeros: Sequence[str]) -> DataFrame:
    """``counted`` for every listed key: absent ones have 0 in ``zeros`` and NULL elsewhere.

    ``listed`` holds the key columns, few and distinct; keys that are not listed are left out.
    """
    keys = listed.columns
    joined = listed.join(counted, keys, "left")
    return joined.select(
        *[F.coalesce(c, F.lit(0).cast("long")).alias(c) if c in zeros else F.col(c) for c in counted.columns]
    )


def is_finite(value: Column) -> Column:
    """False for NULL, NaN and infinities."""
    return F.coalesce(~F.isnan(value) & (F.abs(value) < float("inf")), F.lit(False))


def listed(spark: SparkSession, names: Sequence[str], column: str) -> DataFrame:
    """One row a name, as literals: the plan knows its size and nothing is read."""
    values = F.array(*[F.lit(n) for n in names]).cast("array<string>")
    return spark.range(1).select(F.explode(values).alias(column))

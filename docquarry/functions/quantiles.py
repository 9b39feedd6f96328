"""Exact rank statistics without gathering a series in one task."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docquarry.session import ensure_checkpoint_dir

# Distinct values of one series that a task may sort.
MAX_SORTED = 100_000
# A value is numbered by exponent and mantissa.  Each pass looks at the leading bits of the numbers that
# are left: first exponent and 6 bits of the mantissa, then 16 bits more, until a number is a value.
_SHIFTS = (46, 30, 14, 0)


def _number(value: Column) -> Column:
    """Whole number that grows with a non-negative double; neighbouring doubles may share one."""
    exponent = F.floor(F.log2(value))
    mantissa = F.floor(value / F.pow(F.lit(2.0), exponent) * F.lit(float(1 << 52)))
    code = exponent * F.lit(1 << 52) + mantissa - F.lit(1 << 52)
    return F.when(value <= 0, F.lit(-(1 << 63) + 1)).otherwise(code.cast("long"))


def _narrowed(left: DataFrame, group: Sequence[str], keys: Sequence[str], ranks: DataFrame, shift: int) -> DataFrame:
    """The bin of each rank among the values left for it: (keys, name, rank, start, bin, values).

    ``start`` counts the rows below the bin, ``values`` the distinct values in it.  A ``group`` is a key, or a
    key's rank once each rank has values of its own.
    """
    upto = Window.partitionBy(*group).orderBy("bin").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    bins = (
        left.groupBy(*group, "start", F.shiftright("__code", shift).alias("bin"))
        .agg(F.sum("__n").alias("__rows"), F.count("*").alias("values"))
        .withColumn("__end", F.col("start") + F.sum("__rows").over(upto))
        .withColumn("start", F.col("__end") - F.col("__rows"))
    )
    return (
        ranks.select(*keys, "name", "rank")
        .join(bins, list(group))
        .filter((F.col("rank") > F.col("start")) & (F.col("rank") <= F.col("__end")))
        .select(*keys, "name", "rank", "start", "bin", "values")
    )


def _in_bin(distinct: DataFrame, targets: DataFrame, keys: Sequence[str], shift: int) -> DataFrame:
    """Distinct values in the bins of the ranks, once for each rank."""
    return distinct.withColumn("bin", F.shiftright("__code", shift)).join(targets, [*keys, "bin"]).drop("bin", "values")


def collapsed(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """(keys, __v, __n, __code): each value once with its number of rows, written to the checkpoint folder."""
    ensure_checkpoint_dir(df.sparkSession)
    distinct = df.groupBy(*keys, F.col(value).alias("__v")).agg(F.count("*").alias("__n"))
    return distinct.withColumn("__code", _number(F.col("__v"))).checkpoint()


def candidates(distinct: DataFrame, keys: Sequence[str], ranks: DataFrame, max_sorted: int = MAX_SORTED) -> DataFrame:
    """(keys, name, rank, start, __v, __n): for each rank at most ``max_sorted`` values, one of which has it.

    Bins are refined while one holds more values; the last bins hold one value, or two neighbouring doubles.
    """
    left, group = distinct.withColumn("start", F.lit(0).cast("long")), list(keys)
    for shift in _SHIFTS:
        # A row for each key and name.
        targets = _narrowed(left, group, keys, ranks, shift).checkpoint()
        left, group = _in_bin(distinct, targets, keys, shift), [*keys, "name"]
        if (targets.agg(F.max("values")).first()[0] or 0) <= max_sorted:
            break
    return left


def ranked_values(
    df: DataFrame, keys: Sequence[str], value: str, ranks: DataFrame, *, max_sorted: int = MAX_SORTED
) -> DataFrame:
    """Value at each requested 1-based rank: (keys, name, value).

    ``ranks`` has ``keys``, ``name`` and ``rank``; ``df`` holds non-negative values.  Equal values
    collapse in a map-side combine, histograms narrow each rank down to few values, and only those are sorted.
    """
    return _ranked(collapsed(df, keys, value), keys, ranks, max_sorted)


def _ranked(distinct: DataFrame, keys: Sequence[str], ranks: DataFrame, max_sorted: int) -> DataFrame:
    inside = Window.partitionBy(*keys, "name").orderBy("__v").rowsBetween(
        Window.unboundedPreceding, Window.currentRow
    )
    return (
        candidates(distinct, keys, ranks, max_sorted)
        .withColumn("__cum", F.col("start") + F.sum("__n").over(inside))
        .filter(
            (F.col("rank") <= F.col("__cum"))
            & (F.col("rank") > F.col("__cum") - F.col("__n"))
        )
        .select(*keys, "name", F.col("__v").alias("value"))
    )


def summarise(df: DataFrame, keys: Sequence[str], value: str, *, max_sorted: int = MAX_SORTED) -> DataFrame:
    """count, mean, midpoint median, nearest-rank p95 and maximum per key.

    NULL values are skipped by the caller; a key without values has no row.  The rows are read once.
    """
    distinct = collapsed(df.select(*keys, value), keys, value)
    base = distinct.groupBy(*keys).agg(
        F.sum("__n").alias("n"),
        (F.sum(F.col("__v") * F.col("__n")) / F.sum("__n")).alias("mean"),
        F.max("__v").alias("maximum"),
    )
    half = F.col("n") / 2
    wanted = F.array(
        F.struct(F.lit("lo").alias("name"), F.floor((F.col("n") + 1) / 2).alias("rank")),
        F.struct(F.lit("hi").alias("name"), (F.floor(half) + 1).alias("rank")),
        F.struct(
            F.lit("p95").alias("name"),
            F.greatest(F.lit(1), F.ceil(F.lit(0.95) * F.col("n"))).alias("rank"),
        ),
    )
    picked = _ranked(distinct, keys, base.select(*keys, F.inline(wanted)), max_sorted)
    flat = picked.groupBy(*keys).agg(
        F.avg(F.when(F.col("name").isin("lo", "hi"), F.col("value"))).alias("median"),
        F.max(F.when(F.col("name") == "p95", F.col("value"))).alias("p95"),
    )
    return base.join(flat, list(keys)).select(*keys, "n", "mean", "median", "p95", "maximum")

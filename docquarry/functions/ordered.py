"""Running values along an ordinal that survive very large groups.

A plain window sorts one whole group in one task.  Here each group is cut into
blocks of ``block`` consecutive ordinals, small per-block summaries carry state
across blocks, and the row-level window only ever sees one block.  Results are
identical to the plain window.  The ordinal must be an integer that is unique
within the group.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BLOCK = 65_536
_BLK = "__block"


def _blocked(df: DataFrame, order: str, block: int) -> DataFrame:
    return df.withColumn(_BLK, F.floor(F.col(order) / F.lit(block)))


def _attach(df: DataFrame, carry: DataFrame, keys: Sequence[str]) -> DataFrame:
    on = [*keys, _BLK]
    return df.join(carry, on, "left")


@dataclass(frozen=True)
class Total:
    """Sum of ``amount`` over earlier rows, and this one if ``inclusive``."""

    amount: Column
    inclusive: bool = False


@dataclass(frozen=True)
class Latest:
    """Last non-null ``value`` of earlier rows, and this one if ``inclusive``."""

    value: Column
    inclusive: bool = True


@dataclass(frozen=True)
class RunNumber:
    """How often ``value`` changed up to this row; NULL equals NULL."""

    value: Column


def running(
    df: DataFrame,
    keys: Sequence[str],
    order: str,
    values: dict[str, Total | Latest | RunNumber],
    *,
    block: int = BLOCK,
    levels: int = 1,
) -> DataFrame:
    """Several running values in one go: the rows are read twice, once for the blocks' summaries.

    Summaries of a group are combined in the order of its blocks by one window.  Where ordinals are sparse a
    group may have very many blocks; with more ``levels`` the summaries are cut into blocks in turn, 65,536
    ordinals a level, so that no window sorts more than one of them.
    """
    on = [*keys, _BLK]
    names = {name: f"__{levels}_{i}" for i, name in enumerate(values)}

    def input_of(name: str) -> Column:
        spec = values[name]
        if isinstance(spec, RunNumber):
            # Boxed, so that a missing predecessor differs from a NULL value.
            return F.struct(spec.value.alias("v"))
        return spec.amount if isinstance(spec, Total) else spec.value

    base = _blocked(df, order, block).withColumns({names[n]: input_of(n) for n in values})
    inside = Window.partitionBy(*on).orderBy(order)

    def changed(name: str) -> Column:
        before = F.lag(names[name]).over(inside)
        return (before.isNotNull() & ~before.eqNullSafe(F.col(names[name]))).cast("long")

    runs = [n for n, spec in values.items() if isinstance(spec, RunNumber)]
    flags = {f"{names[n]}c": changed(n) for n in runs}
    summary = base.select(*on, order, *names.values())
    summary = (summary.withColumns(flags) if flags else summary).groupBy(*on)
    parts = []
    for name, spec in values.items():
        c = names[name]
        if isinstance(spec, Total):
            parts.append(F.sum(c).alias(c))
        elif isinstance(spec, Latest):
            # Rows without a value come first, so the maximum is the last set value.
            parts.append(F.max(F.when(F.col(c).isNotNull(), F.struct(F.col(order), F.col(c).alias("v")))).alias(c))
        else:
            parts += [
                F.sum(f"{c}c").alias(f"{c}c"),
                F.min_by(c, order).alias(f"{c}a"),
                F.max_by(c, order).alias(f"{c}z"),
            ]
    carry = _carried(summary.agg(*parts), keys, values, names, block, levels)
    rows = base.join(carry, on, "left")
    rows = rows.withColumns(flags) if flags else rows
    upto = inside.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    earlier = inside.rowsBetween(Window.unboundedPreceding, -1)
    out = {}
    for name, spec in values.items():
        c = names[name]
        if isinstance(spec, RunNumber):
            out[name] = F.col(f"{c}k") + F.sum(f"{c}c").over(upto)
        elif isinstance(spec, Total):
            local = F.sum(c).over(upto if spec.inclusive else earlier)
            out[name] = F.col(f"{c}k") + F.coalesce(local, F.lit(0))
        else:
            local = F.last(c, ignorenulls=True).over(upto if spec.inclusive else earlier)
            out[name] = F.coalesce(local, F.col(f"{c}k"))
    return rows.select(*df.columns, *[v.alias(n) for n, v in out.items()])


def _carried(
    summary: DataFrame, keys: Sequence[str], values: dict, names: dict[str, str], block: int, levels: int
) -> DataFrame:
    """(keys, block, one column a value): what the earlier blocks of a group bring to each block."""

    def along(df: DataFrame, specs: dict[str, Total | Latest]) -> DataFrame:
        if not specs:
            return df
        if levels > 1:
            # A block's number is the ordinal of the next level.
            number = f"__{levels}_block"
            outer = running(df.withColumnRenamed(_BLK, number), keys, number, specs, block=block, levels=levels - 1)
            return outer.withColumnRenamed(number, _BLK)
        before = Window.partitionBy(*keys).orderBy(_BLK).rowsBetween(Window.unboundedPreceding, -1)
        return df.withColumns(
            {
                n: F.coalesce(F.sum(s.amount).over(before), F.lit(0))
                if isinstance(s, Total)
                else F.last(s.value, ignorenulls=True).over(before)
                for n, s in specs.items()
            }
        )

    first: dict[str, Total | Latest] = {}
    for name, spec in values.items():
        c = names[name]
        if isinstance(spec, Total):
            first[f"{c}k"] = Total(F.coalesce(F.col(c), F.lit(0)))
        elif isinstance(spec, Latest):
            first[f"{c}k"] = Latest(F.col(f"{c}.v"), inclusive=False)
        else:
            first[f"{c}p"] = Latest(F.col(f"{c}z"), inclusive=False)
    carried = along(summary, first)
    runs = [names[n] for n, spec in values.items() if isinstance(spec, RunNumber)]
    border = {
        f"{c}b": (F.col(f"{c}p").isNotNull() & ~F.col(f"{c}p").eqNullSafe(F.col(f"{c}a"))).cast("long") for c in runs
    }
    if runs:
        carried = along(
            carried.withColumns(border), {f"{c}t": Total(F.col(f"{c}c") + F.col(f"{c}b")) for c in runs}
        )
    kept = [
        (F.col(f"{c}t") + F.col(f"{c}b")).alias(f"{c}k") if c in runs else F.col(f"{c}k") for c in names.values()
    ]
    return carried.select(*keys, _BLK, *kept)


def running_total(
    df: DataFrame,
    keys: Sequence[str],
    order: str,
    amount: Column,
    name: str,
    *,
    inclusive: bool = False,
    block: int = BLOCK,
    levels: int = 1,
) -> DataFrame:
    """Sum of ``amount`` over earlier rows (and this one if ``inclusive``)."""
    return running(df, keys, order, {name: Total(amount, inclusive)}, block=block, levels=levels)


def dense_rank_along(
    df: DataFrame, keys: Sequence[str], order: str, name: str, *, block: int = BLOCK, levels: int = 1
) -> DataFrame:
    """0-based position of each row within its group."""
    return running_total(df, keys, order, F.lit(1), name, block=block, levels=levels)


def fill_forward(
    df: DataFrame,
    keys: Sequence[str],
    order: str,
    value: Column,
    name: str,
    *,
    block: int = BLOCK,
) -> DataFrame:
    """Latest non-null ``value`` at or before each row."""
    return running(df, keys, order, {name: Latest(value)}, block=block)


def recent_values(
    df: DataFrame,
    keys: Sequence[str],
    order: str,
    value: Column,
    count: int,
    name: str,
    *,
    block: int = BLOCK,
) -> DataFrame:
    """Array of the last ``count`` values strictly before each row, oldest first."""
    df = _blocked(df.withColumn("__value", value), order, block)
    newest = Window.partitionBy(*keys, _BLK).orderBy(F.col(order).desc())
    tail = (
        df.select(*keys, _BLK, order, "__value")
        .withColumn("__rn", F.row_number().over(newest))
        .filter(F.col("__rn") <= count)
        .groupBy(*keys, _BLK)
        .agg(
            F.array_sort(F.collect_list(F.struct(F.col(order), F.col("__value")))).alias(
                "__tail"
            )
        )
    )
    # Every block holds at least one row, so `count` earlier blocks suffice.
    earlier = Window.partitionBy(*keys).orderBy(_BLK).rowsBetween(-count, -1)
    carry = tail.select(
        *keys, _BLK, F.flatten(F.collect_list("__tail").over(earlier)).alias("__carry")
    )
    inside = Window.partitionBy(*keys, _BLK).orderBy(order).rowsBetween(-count, -1)
    local = F.collect_list(F.struct(F.col(order), F.col("__value"))).over(inside)
    both = F.concat(F.coalesce(F.col("__carry"), F.array()), local)
    kept = F.slice(both, F.greatest(F.lit(1), F.size(both) - count + 1), count)
    return (
        _attach(df, carry, keys)
        .withColumn(name, F.transform(kept, lambda x: x["__value"]))
        .drop("__value", "__carry", _BLK)
    )


def previous_value(
    df: DataFrame,
    keys: Sequence[str],
    order: str,
    value: Column,
    name: str,
    *,
    block: int = BLOCK,
) -> DataFrame:
    """Array holding the preceding row's value (empty on the first row).

    The array tells "no preceding row" apart from "preceding value is NULL".
    """
    boxed = F.struct(value.alias("v"))
    return recent_values(df, keys, order, boxed, 1, name, block=block).withColumn(
        name, F.transform(F.col(name), lambda x: x["v"])
    )

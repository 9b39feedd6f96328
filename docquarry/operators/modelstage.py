"""Batched calls of a caller-supplied model."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import types as T

# A model takes the input rows of one batch and returns one row per input with
# any of: text, finish_reason, choice_count, total_tokens.
Model = Callable[[pd.DataFrame], pd.DataFrame]

_OUTPUT = (
    ("text", T.StringType()),
    ("finish_reason", T.StringType()),
    ("choice_count", T.IntegerType()),
    ("total_tokens", T.LongType()),
    ("latency_seconds", T.DoubleType()),
    ("status", T.StringType()),
    ("error", T.StringType()),
)


def run_model(rows: DataFrame, make_model: Callable[[], Model], keys: list[str]) -> DataFrame:
    """``keys`` plus the model's output per row; failures become error rows.

    The model is built once per task.  When a whole batch fails, its rows are
    tried one by one so that only the failing ones carry an error.
    """
    schema = T.StructType(
        [rows.schema[k] for k in keys] + [T.StructField(n, t) for n, t in _OUTPUT]
    )

    def call(model: Model, part: pd.DataFrame) -> pd.DataFrame:
        started = time.perf_counter()
        result = model(part).reset_index(drop=True)
        spent = (time.perf_counter() - started) / max(1, len(part))
        return result.assign(latency_seconds=spent, status="success", error=None)

    def attempt(model: Model, part: pd.DataFrame) -> pd.DataFrame:
        try:
            return call(model, part)
        except Exception as error:
            if len(part) > 1:
                singles = [attempt(model, part.iloc[[i]]) for i in range(len(part))]
                return pd.concat(singles, ignore_index=True)
            return pd.DataFrame([{"status": "error", "error": f"{type(error).__name__}: {error}"}])

    def stage(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = make_model()
        for batch in batches:
            result = attempt(model, batch).reindex(columns=[n for n, _ in _OUTPUT]).astype(object)
            result = result.where(result.notna(), None)
            for column in ("choice_count", "total_tokens"):
                result[column] = pd.array(result[column], dtype="Int64")
            result["latency_seconds"] = result["latency_seconds"].astype(float)
            yield pd.concat([batch[keys].reset_index(drop=True), result], axis=1)

    return rows.mapInPandas(stage, schema)

"""Toxicity by a classifier chain.

The categories, label columns with 0 or 1, are predicted one after the other by linear
(logistic) models over words and word beginnings.  Each later model also gets the earlier
categories' probabilities.  In training those come from out-of-fold models, which
have not seen the row, so that a later model learns from errors as they will be;
in prediction they come from the models of all rows.

The chain is fitted on at most about ``MAX_LABELLED`` labelled documents, chosen by a hash of
the id (the documented bound).  Per category, the ``MAX_FEATURES`` features most
associated with it are kept, counted by Spark over the sample.  One fold's fit is one task
over the bounded sample; the fits of a category run side by side.

Defined cases: NULL and empty texts have no features and get the base rate of the
training rows; a category of one class only gives its smoothed rate; without
labelled rows every probability is 0.5 and no document is flagged; repeated labels of an
id count as 1 if any is; a NULL label counts as not labelled.  Input columns named like a result are replaced by it.
"""

from __future__ import annotations

import re

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docquarry.llm.common import attach, rank_sample, settle

MAX_LABELLED = 10_000
MAX_FEATURES = 256
MIN_DOCUMENTS = 5
FOLDS = 3
RIDGE = 1.0
NEWTON_STEPS = 12
BEGINNINGS = (4, 5)

_WORD = re.compile(r"[^\W\d_]+")


def features(text: str | None) -> set[str]:
    """Words, and beginnings of longer words marked with ``*``, of a whole text."""
    words = set(_WORD.findall(text.lower())) if text else set()
    starts = {f"{w[:n]}*" for n in BEGINNINGS for w in words if len(w) > n}
    return words | starts


def logistic(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Weights, the intercept last, of ridge logistic regression by Newton steps."""
    design = np.hstack([x, np.ones((len(x), 1))])
    rate = (y.sum() + 0.5) / (len(y) + 1.0)
    weights = np.zeros(design.shape[1])
    weights[-1] = np.log(rate / (1 - rate))
    if y.min() == y.max():
        return weights
    penalty = np.full(len(weights), RIDGE)
    penalty[-1] = 1e-6
    for _ in range(NEWTON_STEPS):
        p = probability(design @ weights)
        slope = design.T @ (y - p) - penalty * weights
        curve = (design * (p * (1 - p))[:, None]).T @ design + np.diag(penalty)
        step = np.linalg.solve(curve, slope)
        weights = weights + step
        if np.abs(step).max() < 1e-6:
            break
    return weights


def probability(score):
    return 1.0 / (1.0 + np.exp(-np.clip(score, -30.0, 30.0)))


class Chain:
    """Fitted models in order; ``index`` numbers the features."""

    def __init__(self, categories: list[str], index: dict[str, int], weights: list[np.ndarray]):
        self.categories = categories
        self.index = index
        self.weights = weights

    def columns(self, text: str | None) -> list[int]:
        index = self.index
        return sorted(index[f] for f in features(text) if f in index)

    def predict(self, text: str | None) -> list[float]:
        if not self.weights:
            return [0.5] * len(self.categories)
        at, found = self.columns(text), []
        for weights in self.weights:
            score = weights[at].sum() + weights[-1]
            score += sum(w * p for w, p in zip(weights[len(self.index) : -1], found))
            found.append(float(probability(score)))
        return found


def labelled_sample(
    docs: DataFrame, labels: DataFrame, categories: dict[str, Column], id_col: str, text_col: str, bound: int
) -> DataFrame:
    """(id, y, fold, features): the bounded labelled sample; texts of other rows are not moved."""
    values = [c.cast("double").alias(f"y{i}") for i, c in enumerate(categories.values())]
    known = labels.select(F.col(id_col).alias("id"), *values).groupBy("id").agg(
        *[F.max(f"y{i}").alias(f"y{i}") for i in range(len(values))]
    )
    known = known.na.drop()
    chosen = rank_sample(known, F.col("id"), bound, known.count())

    def look(column: pa.Array) -> pa.Array:
        return pa.array([sorted(features(t.as_py())) for t in column], pa.list_(pa.string()))

    text = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return text.join(F.broadcast(chosen), "id").select(
        "id",
        F.array(*[f"y{i}" for i in range(len(values))]).alias("y"),
        F.pmod(F.xxhash64("id", F.lit(1)), F.lit(FOLDS)).cast("int").alias("fold"),
        F.arrow_udf(look, "array<string>")("text").alias("features"),
    )


def chosen_features(sample: DataFrame, categories: int, bound: int = MAX_FEATURES) -> list[str]:
    """The features most associated with each category, by the phi coefficient."""
    ones = [F.sum(F.col("y")[i]).alias(f"s{i}") for i in range(categories)]
    total = sample.agg(F.count("*").alias("n"), *ones).first()
    counted = settle(
        sample.select("y", F.explode("features").alias("feature"))
        .groupBy("feature")
        .agg(F.count("*").alias("n"), *ones)
        .filter(F.col("n") >= MIN_DOCUMENTS),
        "toxicity-features",
    )
    kept: set[str] = set()
    for i in range(categories):
        n, s = float(total["n"]), float(total[f"s{i}"] or 0.0)
        if not 0 < s < n:
            continue
        spread = F.sqrt(F.col("n") * (n - F.col("n")) * F.lit(s * (n - s)))
        phi = F.abs(F.col(f"s{i}") * n - F.col("n") * s) / spread
        best = counted.filter(F.col("n") < n).orderBy(F.round(phi, 9).desc(), "feature").limit(bound)
        kept |= {r["feature"] for r in best.select("feature").collect()}
    return sorted(kept)


def train(
    docs: DataFrame,
    labels: DataFrame,
    categories: dict[str, Column],
    id_col: str = "doc_id",
    text_col: str = "text",
    max_labelled: int = MAX_LABELLED,
) -> Chain:
    """Fit the chain; ``categories`` gives each name, in order, and its label as a column of ``labels``."""
    names = list(categories)
    sample = settle(
        labelled_sample(docs, labels, categories, id_col, text_col, max_labelled), "toxicity-sample"
    )
    if sample.isEmpty():
        return Chain(names, {}, [])
    index = {f: i for i, f in enumerate(chosen_features(sample, len(names)))}
    width = len(index)

    def number(column: pa.Array) -> pa.Array:
        return pa.array(
            [sorted(index[f] for f in row.as_py() if f in index) for row in column], pa.list_(pa.int32())
        )

    rows = settle(
        sample.select(
            "y",
            "fold",
            F.arrow_udf(number, "array<int>")("features").alias("at"),
            F.array().cast("array<double>").alias("chain"),
        ),
        "toxicity-rows",
    )
    weights = []
    for position in range(len(names)):
        fits = _fits(rows, position, width)
        weights.append(fits[FOLDS])
        if position + 1 < len(names):
            rows = settle(_with_out_of_fold(rows, fits, width), "toxicity-rows")
    return Chain(names, index, weights)


def _fits(rows: DataFrame, position: int, width: int) -> dict[int, np.ndarray]:
    """Weights of the model without each fold, and under ``FOLDS`` of the model of all rows."""

    def fit(key, group: pd.DataFrame) -> pd.DataFrame:
        x = np.zeros((len(group), width + position))
        for i, (at, chain) in enumerate(zip(group["at"], group["chain"])):
            x[i, at] = 1.0
            x[i, width:] = chain
        y = np.array([row[position] for row in group["y"]])
        return pd.DataFrame({"model": [key[0]], "weights": [logistic(x, y)]})

    models = rows.withColumn("model", F.explode(F.sequence(F.lit(0), F.lit(FOLDS)))).filter(
        F.col("model") != F.col("fold")
    )
    found = models.groupBy("model").applyInPandas(fit, "model int, weights array<double>").collect()
    fits = {r["model"]: np.array(r["weights"]) for r in found}
    # A fold that holds all rows leaves no model of its own; it takes the one of all rows.
    return {m: fits.get(m, fits[FOLDS]) for m in range(FOLDS + 1)}


def _with_out_of_fold(rows: DataFrame, fits: dict[int, np.ndarray], width: int) -> DataFrame:
    """Append to ``chain`` the probability by the model that has not seen the row."""

    def guess(fold: pa.Array, at: pa.Array, chain: pa.Array) -> pa.Array:
        out = []
        for f, places, before in zip(fold.to_pylist(), at.to_pylist(), chain.to_pylist()):
            weights = fits[f]
            score = weights[places].sum() + weights[-1] + np.dot(weights[width:-1], before)
            out.append([*before, float(probability(score))])
        return pa.array(out, pa.list_(pa.float64()))

    return rows.withColumn("chain", F.arrow_udf(guess, "array<double>")("fold", "at", "chain"))


def score(docs: DataFrame, chain: Chain, text_col: str = "text") -> DataFrame:
    """``docs`` with a probability column ``p_<category>`` for each category."""
    names = [f"p_{c}" for c in chain.categories]

    def look(column: pa.Array) -> pa.Array:
        found = [chain.predict(text.as_py()) for text in column]
        return pa.StructArray.from_arrays(
            [pa.array([row[i] for row in found], pa.float64()) for i in range(len(names))], names=names
        )

    result = F.arrow_udf(look, ", ".join(f"`{n}` double" for n in names))(F.col(f"`{text_col}`"))
    return attach(docs, result, names)

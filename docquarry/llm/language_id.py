"""Language identification, words first.

Training counts words per language and, from those, character n-grams of the
words (``<`` and ``>`` mark their ends).  A known word votes by its log frequency in
each language.  An unseen word backs off: its n-grams of the longest length are
looked up, then shorter ones, down to single characters, and the first length
with a known n-gram votes.  Votes are log posteriors over the languages with equal priors,
summed over all words of the whole text; the language with the largest sum wins
(ties: the first in sorted order).  ``score`` is the mean posterior of the winner.

Counting is a Spark job over at most about ``MAX_DOCS_PER_LANGUAGE`` labelled
documents of every language, chosen by a hash of the id (the documented bound of the
fit).  The model holds words seen ``MIN_WORD`` times and n-grams seen ``MIN_GRAM``
times in that sample, so its size is bounded too and it may travel to the tasks.

Defined cases: ``und`` with score 0 for a NULL text, a text without a letter, and for
every text if nothing was learned; rows without a label teach nothing; a text
whose letters were all never seen gets the first language with score 1 / languages.
Input columns named like a result are replaced by it.
"""

from __future__ import annotations

import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docquarry.llm.common import attach, settle

MAX_DOCS_PER_LANGUAGE = 2000
MIN_WORD = 3
MIN_GRAM = 3
LONGEST_GRAM = 5
REMEMBERED_WORDS = 200_000
UNDETERMINED = "und"
FIELDS = ["lang_pred", "score"]

_WORD = re.compile(r"[^\W\d_]+")


def words_of(text: str) -> Counter:
    """Runs of letters with their number.  The pattern also takes numerals such as a half, which are none."""
    counts = Counter(_WORD.findall(text.lower()))
    for word in [w for w in counts if not w.isalpha()]:
        times = counts.pop(word)
        for part in "".join(c if c.isalpha() else " " for c in word).split():
            counts[part] += times
    return counts


def _grams(word: str, size: int) -> list[str]:
    framed = word if size == 1 else f"<{word}>"
    return [framed[i : i + size] for i in range(len(framed) - size + 1)]


class Model:
    """Log posteriors of words and n-grams, one row per entry and one column per language."""

    def __init__(self, languages: list[str], words: dict, grams: dict):
        self.languages = languages
        self.words, self.word_votes = self._votes(words)
        self.grams, self.gram_votes = self._votes(grams)

    def _votes(self, counts: dict) -> tuple[dict, np.ndarray]:
        index = {key: row for row, key in enumerate(sorted(counts))}
        table = np.zeros((len(index), max(len(self.languages), 1)))
        for key, row in index.items():
            for language, n in counts[key].items():
                table[row, self.languages.index(language)] = n
        totals = np.maximum(table.sum(axis=0), 1.0)
        likely = np.log((table + 0.5) / totals)
        top = likely.max(axis=1, keepdims=True) if len(index) else likely
        return index, likely - top - np.log(np.exp(likely - top).sum(axis=1, keepdims=True))

    def vote(self, word: str) -> np.ndarray:
        row = self.words.get(word)
        if row is not None:
            return self.word_votes[row]
        for size in range(LONGEST_GRAM, 0, -1):
            rows = [r for g in _grams(word, size) if (r := self.grams.get(g)) is not None]
            if rows:
                return self.gram_votes[rows].mean(axis=0)
        return np.full(len(self.languages), -np.log(len(self.languages)))

    def predict(self, text: str | None, remembered: dict) -> tuple[str, float]:
        counts = words_of(text) if text else {}
        if not counts or not self.languages:
            return UNDETERMINED, 0.0
        votes = []
        for word in counts:
            row = self.words.get(word)
            vote = remembered.get(word) if row is None else self.word_votes[row]
            if vote is None:
                if len(remembered) >= REMEMBERED_WORDS:
                    remembered.clear()
                vote = remembered[word] = self.vote(word)
            votes.append(vote)
        weights = np.fromiter(counts.values(), dtype=float, count=len(counts))
        votes = np.asarray(votes)
        best = int(np.argmax(np.round(weights @ votes, 9)))
        score = float(weights @ np.exp(votes[:, best]) / weights.sum())
        return self.languages[best], min(1.0, max(0.0, score))


def _kept_shares(labelled: DataFrame, bound: int) -> DataFrame:
    return labelled.groupBy("lang").agg(F.least(F.lit(1.0), F.lit(bound) / F.count("*")).alias("share"))


def train(
    labelled: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    lang_col: str = "lang",
    max_docs: int = MAX_DOCS_PER_LANGUAGE,
) -> Model:
    """Fit on the labelled rows given; only the bounded counts reach the driver."""
    rows = labelled.filter(F.col(lang_col).isNotNull()).select(
        F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang")
    )
    shares = _kept_shares(rows, max_docs)
    sample = rows.join(F.broadcast(shares), "lang").filter(
        F.pmod(F.xxhash64("id"), F.lit(1 << 20)) < F.ceil(F.col("share") * (1 << 20))
    )
    words = settle(
        sample.select(
            "lang", F.explode(F.expr(r"regexp_extract_all(lower(text), '\\p{L}+', 0)")).alias("word")
        )
        .groupBy("lang", "word")
        .agg(F.count("*").alias("n")),
        "language-words",
    )
    framed = F.concat(F.lit("<"), F.col("word"), F.lit(">"))
    grams = [
        words.select("lang", "n", F.explode(_gram_column(F.col("word") if size == 1 else framed, size)).alias("gram"))
        for size in range(1, LONGEST_GRAM + 1)
    ]
    every = grams[0]
    for one in grams[1:]:
        every = every.unionByName(one)
    gram_counts = every.groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    languages = sorted(r["lang"] for r in shares.select("lang").collect())
    return Model(
        languages,
        _collected(words, "word", MIN_WORD),
        _collected(gram_counts, "gram", MIN_GRAM),
    )


def _gram_column(word, size: int):
    count = F.length(word) - size + 1
    return F.when(
        count > 0, F.transform(F.sequence(F.lit(1), count), lambda i: F.substring(word, i, F.lit(size)))
    )


def _collected(counts: DataFrame, key: str, least: int) -> dict:
    """{entry: {language: count}} of the entries seen ``least`` times in all languages."""
    known = (
        counts.groupBy(key)
        .agg(F.map_from_entries(F.collect_list(F.struct("lang", "n"))).alias("by"), F.sum("n").alias("all"))
        .filter(F.col("all") >= least)
    )
    return {r[0]: r[1] for r in known.select(key, "by").collect()}


def identify(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """``docs`` with ``lang_pred`` and ``score``."""
    sent = docs.sparkSession.sparkContext.broadcast(model)
    kind = pa.struct([("lang_pred", pa.string()), ("score", pa.float64())])
    remembered: dict = {}

    def look(column: pa.Array) -> pa.Array:
        found = [sent.value.predict(text.as_py(), remembered) for text in column]
        return pa.StructArray.from_arrays(
            [pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.float64())],
            fields=list(kind),
        )

    result = F.arrow_udf(look, "lang_pred string, score double")(F.col(f"`{text_col}`"))
    return attach(docs, result, FIELDS)


def is_rejected(min_score: float):
    """Rows whose language is undetermined or doubtful; needs the columns of :func:`identify`."""
    return (F.col("lang_pred") == UNDETERMINED) | (F.col("score") < min_score)

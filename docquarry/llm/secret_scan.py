"""Secrets in text: fixed shapes, and strings that look drawn at random.

Three shapes are found by pattern: assignments of a long value to a telling name,
access key ids and long hexadecimal runs.  Beyond them, runs of 16 or more key characters are
scored outside those spans by two first-order character Markov models, one of random strings and
one of ordinary identifiers.  A stretch of at least ``MIN_STRETCH`` characters whose summed
log-likelihood ratio reaches ``MIN_RATIO`` is a span of kind ``markov``, in whole pieces between
separators, so that a key inside a path or behind a fixed shape is found without what is around
it.  The spans of the fixed shapes stay as they are.

The models are counted by Spark from labelled samples (value, is_random).
:func:`labelled_samples` takes them from documents: values inside the fixed shapes are
random, other runs of 4 to 15 key characters are ordinary.  It reads at
most about ``MAX_SAMPLE_DOCS`` documents, chosen by a hash of the id (the documented
bound of the fit).  The counts are bounded by the square of the alphabet.

Defined cases: NULL counts as the empty text and has no spans; without a random
sample or without an ordinary one there are no ``markov`` spans; repeated rows give
repeated results.  Input columns named like a result are replaced by it.
"""

from __future__ import annotations

import bisect
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docquarry.llm.common import attach, rank_sample

MAX_SAMPLE_DOCS = 20_000
MIN_RUN = 16
MIN_ORDINARY = 4
MIN_RATIO = 12.0
MIN_STRETCH = 12
ROW_PRIOR = 5.0

# The kinds in the order of equal starts, their patterns and least lengths.
KINDS = ("assign", "access", "hex", "markov")
ASSIGN = re.compile(
    r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
    re.ASCII | re.IGNORECASE,
)
MIN_ASSIGNED = 12
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
MIN_ACCESS = 18
HEX = re.compile(r"[0-9a-f]+")
MIN_HEX = 16

_KEY_CHARS = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_.=-"
_PIECE = re.compile(r"[A-Za-z0-9]+")
_LONG_RUN = re.compile(r"[A-Za-z0-9+/_.=-]{%d,}" % MIN_RUN)
_ANY_RUN = re.compile(r"[A-Za-z0-9+/_.=-]+")
_INDEX = {c: i for i, c in enumerate(_KEY_CHARS)}

RESULT = "spans array<struct<kind:string,start:int,end:int>>"
FIELDS = ["spans"]


def _long_runs(text: str) -> list[tuple[int, int]]:
    return [m.span() for m in _LONG_RUN.finditer(text)]


def shape_spans(text: str, runs: list[tuple[int, int]]) -> list[tuple[int, int, int, int]]:
    """(start, kind, end, value start) of the fixed shapes; ``runs`` are the text's long runs.

    Long hexadecimal runs and access keys lie inside long runs of key characters,
    which are few; an assignment needs one of its two signs.
    """
    found = []
    if ":" in text or "=" in text:
        found += [
            (m.start(), 0, m.end(), m.start(2))
            for m in ASSIGN.finditer(text)
            if m.end(2) - m.start(2) >= MIN_ASSIGNED
        ]
    for low, high in runs:
        found += [
            (m.start(), 2, m.end(), m.start())
            for m in HEX.finditer(text, low, high)
            if m.end() - m.start() >= MIN_HEX
        ]
        found += [
            (m.start(), 1, m.end(), m.start())
            for m in ACCESS.finditer(text, low, high)
            if m.end() - m.start() >= MIN_ACCESS
        ]
    return sorted(found)


class MarkovPair:
    """Log-likelihood ratio of each character given the one before it."""

    def __init__(self, random: np.ndarray, ordinary: np.ndarray):
        self.ready = bool(random.sum() and ordinary.sum())
        ratio = _log_rows(random) - _log_rows(ordinary)
        self.table = {a: dict(zip(_KEY_CHARS, ratio[i].tolist())) for a, i in _INDEX.items()}

    def stretches(self, run: str) -> list[tuple[int, int]]:
        """Stretches (start, end) whose ratio reaches ``MIN_RATIO``, in one pass.

        A stretch begins where the sum so far is not positive, ends where the sum is greatest, and
        is closed when the sum is back at zero or has fallen by more than ``MIN_RATIO``.
        """
        found, table = [], self.table
        start, peak, total, best = 0, 0, 0.0, 0.0
        for i in range(1, len(run)):
            total += table[run[i - 1]][run[i]]
            if total > best:
                best, peak = total, i + 1
            elif total <= 0.0 or best - total > MIN_RATIO:
                if best >= MIN_RATIO:
                    found.append((start, peak))
                start, total, best = i, 0.0, 0.0
        if best >= MIN_RATIO:
            found.append((start, peak))
        return found

    def keys(self, run: str) -> list[tuple[int, int]]:
        """The long stretches in whole pieces between separators: those at least half inside one."""
        pieces = [m.span() for m in _PIECE.finditer(run)]
        ends = [end for _, end in pieces]
        found: list[tuple[int, int]] = []
        for low, high in self.stretches(run):
            if high - low < MIN_STRETCH:
                continue
            first, last = bisect.bisect_right(ends, low), bisect.bisect_left(ends, high)
            last = min(last, len(pieces) - 1)
            while first <= last and not _half_inside(pieces[first], low, high):
                first += 1
            while first <= last and not _half_inside(pieces[last], low, high):
                last -= 1
            if first > last:
                continue
            low, high = pieces[first][0], pieces[last][1]
            # The padding of an encoded key belongs to it.
            while high < len(run) and run[high] == "=":
                high += 1
            if found and low < found[-1][1]:
                low = found.pop()[0]
            found.append((low, high))
        return [span for span in found if span[1] - span[0] >= MIN_STRETCH]


def _half_inside(piece: tuple[int, int], low: int, high: int) -> bool:
    return 2 * (min(high, piece[1]) - max(low, piece[0])) >= piece[1] - piece[0]


def _log_rows(counts: np.ndarray) -> np.ndarray:
    """Log probabilities of the next character; rare rows lean on the class's single characters."""
    single = counts.sum(axis=0) + 0.5
    smooth = counts + ROW_PRIOR * single / single.sum()
    return np.log(smooth / smooth.sum(axis=1, keepdims=True))


def all_spans(text: str | None, model: MarkovPair | None) -> list[tuple[int, int, int]]:
    """(start, kind, end) of every span, in order."""
    if not text:
        return []
    runs = _long_runs(text)
    spans = [(start, kind, end) for start, kind, end, _ in shape_spans(text, runs)]
    if model is not None and model.ready:
        fixed = list(spans)
        at = 0
        for low, high in runs:
            # Fixed spans and runs are in order; a span may reach over several runs.
            while at < len(fixed) and fixed[at][2] <= low:
                at += 1
            for start, end in _outside(low, high, fixed[at:_first_from(fixed, at, high)]):
                if end - start >= MIN_STRETCH:
                    spans += [(start + a, 3, start + b) for a, b in model.keys(text[start:end])]
        spans.sort()
    return spans


def _first_from(fixed: list[tuple[int, int, int]], at: int, high: int) -> int:
    while at < len(fixed) and fixed[at][0] < high:
        at += 1
    return at


def _outside(low: int, high: int, fixed: list[tuple[int, int, int]]) -> list[tuple[int, int]]:
    """The parts of a run that no fixed span covers."""
    parts = []
    for start, _, end in fixed:
        if start > low:
            parts.append((low, start))
        low = max(low, end)
    if low < high:
        parts.append((low, high))
    return parts


def labelled_samples(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", max_docs: int = MAX_SAMPLE_DOCS
) -> DataFrame:
    """(value, is_random) from at most about ``max_docs`` documents."""
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    sample = rank_sample(rows, F.col("id"), max_docs, rows.select("id").count())

    def split(column: pa.Array) -> pa.Array:
        out = []
        for text in column:
            text = text.as_py() or ""
            shapes = shape_spans(text, _long_runs(text))
            values = [{"value": text[at:end], "is_random": True} for _, _, end, at in shapes]
            for m in _ANY_RUN.finditer(text):
                # Runs as long as a candidate are left out, as some are the very secrets sought.
                if MIN_ORDINARY <= m.end() - m.start() < MIN_RUN and not any(
                    start < m.end() and m.start() < end for start, _, end, _ in shapes
                ):
                    values.append({"value": m.group(), "is_random": False})
            out.append(values)
        return pa.array(
            out, pa.list_(pa.struct([("value", pa.string()), ("is_random", pa.bool_())]))
        )

    found = F.arrow_udf(split, "array<struct<value:string,is_random:boolean>>")
    return sample.select(F.explode(found("text")).alias("s")).select("s.value", "s.is_random")


def train(samples: DataFrame) -> MarkovPair:
    """Count character pairs of the labelled samples; characters beyond the alphabet are skipped.

    Values are summed per distinct value first, so repeated ones cost one row.
    """
    values = (
        samples.filter("length(value) > 1 AND is_random IS NOT NULL")
        .groupBy("value", "is_random")
        .agg(F.count("*").alias("n"))
    )
    pair_starts = F.expr("transform(sequence(1, length(value) - 1), i -> substring(value, i, 2))")
    pairs = values.select("is_random", "n", F.explode(pair_starts).alias("pair"))
    inside = pairs.filter(F.col("pair").rlike(r"^[A-Za-z0-9+/_.=\-]{2}$"))
    counts = {True: np.zeros((len(_KEY_CHARS),) * 2), False: np.zeros((len(_KEY_CHARS),) * 2)}
    for row in inside.groupBy("is_random", "pair").agg(F.sum("n").alias("n")).collect():
        counts[row["is_random"]][_INDEX[row["pair"][0]], _INDEX[row["pair"][1]]] = row["n"]
    return MarkovPair(counts[True], counts[False])


def find_secrets(docs: DataFrame, model: MarkovPair | None, text_col: str = "text") -> DataFrame:
    """``docs`` with ``spans`` (kind, start, end in code points, end exclusive), in order."""
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))

    def look(column: pa.Array) -> pa.Array:
        found = [
            {
                "spans": [
                    {"kind": KINDS[k], "start": s, "end": e}
                    for s, k, e in all_spans(text.as_py(), model)
                ]
            }
            for text in column
        ]
        return pa.array(found, pa.struct([("spans", kind)]))

    return attach(docs, F.arrow_udf(look, RESULT)(F.col(f"`{text_col}`")), FIELDS)


def joined(spans: Column) -> Column:
    """kind:start:end of each span, comma-joined."""
    return F.array_join(
        F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ","
    )


def of_kind(spans: Column, *kinds: str) -> Column:
    return F.filter(spans, lambda s: s["kind"].isin(*kinds))

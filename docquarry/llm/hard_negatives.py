"""Hard negatives of labelled anchors, found by coordinate pruning of inner products.

The best rows of an anchor's own label are its positives.  Negatives of a positive are rows of
another label whose product with the anchor lies in a band of shares of the positive's.

Rows are dealt by descending length into blocks of bounded bytes, so that a block holds rows of
similar length, and a block is cut into length buckets.  A bucket keeps its rows' direction
coordinates in sorted lists.  Once an anchor has rows enough, a further one must reach some product
``t``; with the bucket's length limit that is a least cosine, and it confines every coordinate of a
row's direction to the range ``cos(phi +- arccos(least))`` around the anchor's ``cos(phi)``.  The ranges
of the anchor's largest coordinates are cut out of the sorted lists and intersected; only what is
in all of them is multiplied exactly.  A bucket whose length limit cannot reach ``t`` ends the search.

Products are whole numbers; ties go to the smaller id.  Cases: rows with a NULL id, label, vector or
component take no part.  A shorter vector counts as filled up with zeros; a vector of zeros has the
product 0 with all.  Rows equal in id, label and vector are one row; other rows that share an id
are rows and anchors of their own, but never each other's positive or negative.  An anchor without
positives gives no rows, as does an empty table.  Other columns are not read.  Components have to
be under 2^24 in size, so that products fit 64 bits.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docquarry.llm.common import settle
from docquarry.llm.vectors import as_matrix, block_count, smallest_of_equal, tiles, widened

BLOCK_BYTES = 16 << 20
BUCKET_ROWS = 4096
FOCUS = 4


class Bucket:
    """Rows of similar length; ``limit`` and ``least`` are the greatest and smallest length."""

    def __init__(self, ids: np.ndarray, labels: np.ndarray, rows: np.ndarray, lengths: np.ndarray):
        self.ids, self.labels, self.rows = ids, labels, rows
        self.limit, self.least = float(lengths.max()), float(lengths.min())
        self.directions = rows / np.where(lengths > 0, lengths, 1)[:, None]
        self.lists: dict[int, tuple[np.ndarray, np.ndarray]] = {}

    def sorted_list(self, j: int) -> tuple[np.ndarray, np.ndarray]:
        """Rows by coordinate ``j`` and the coordinates in that order; made when first asked for."""
        if j not in self.lists:
            order = np.argsort(self.directions[:, j], kind="stable")
            self.lists[j] = order, self.directions[order, j]
        return self.lists[j]

    def feasible(self, anchor: Anchor, least: float) -> np.ndarray | None:
        """Rows whose product may reach ``least``; None for all."""
        span = anchor.length * (self.limit if least > 0 else self.least)
        if span == 0 or np.isneginf(least):
            return None
        # Lowered by what the rounding of lengths and directions can add.
        cosine = least / span - 1e-9
        if cosine <= -1:
            return None
        if cosine > 1:
            return np.zeros(0, np.int64)
        width = np.arccos(cosine)
        low = np.cos(np.minimum(np.pi, anchor.angles + width)) - 1e-9
        high = np.cos(np.maximum(0, anchor.angles - width)) + 1e-9
        spans = []
        for j, lo, hi in zip(anchor.focus.tolist(), low.tolist(), high.tolist()):
            order, values = self.sorted_list(j)
            a, b = np.searchsorted(values, lo, "left"), np.searchsorted(values, hi, "right")
            spans.append((b - a, j, lo, hi, order[a:b]))
        spans.sort(key=lambda s: s[0])
        left = spans[0][4]
        for size, j, lo, hi, _ in spans[1:]:
            if size == len(self.ids):
                break
            at = self.directions[left, j]
            left = left[(at >= lo) & (at <= hi)]
        return None if len(left) == len(self.ids) else left


class Anchor:
    """An anchor's numbers and the angles to the axes of its largest coordinates."""

    def __init__(self, name: int, label: int, numbers: np.ndarray):
        self.name, self.label, self.numbers = name, label, numbers
        self.length = float(np.sqrt((numbers.astype(np.float64) ** 2).sum()))
        self.focus = np.argsort(-np.abs(numbers), kind="stable")[:FOCUS]
        self.angles = np.arccos(np.clip(numbers[self.focus] / (self.length or 1), -1, 1))


class Best:
    """The ``k`` highest (score, smaller id first) within ``low`` <= score <= ``high``."""

    def __init__(self, k: int, low: float = -np.inf, high: float = np.inf):
        self.k, self.low, self.high = k, low, high
        self.scores = self.ids = np.zeros(0, np.int64)

    @property
    def least(self) -> float:
        """What a further row must reach."""
        return max(self.low, float(self.scores[-1])) if len(self.ids) == self.k else self.low

    def add(self, scores: np.ndarray, ids: np.ndarray) -> None:
        fit = (scores >= self.least) & (scores <= self.high)
        if fit.any():
            scores, ids = np.concatenate([self.scores, scores[fit]]), np.concatenate([self.ids, ids[fit]])
            order = np.lexsort((ids, -scores))[: self.k]
            self.scores, self.ids = scores[order], ids[order]


def make_buckets(ids: np.ndarray, labels: np.ndarray, rows: np.ndarray, k: int) -> list[Bucket]:
    """Length buckets, longest first; more than ``k + 1`` ids of one vector and label are never found."""
    kept = smallest_of_equal(rows, ids, k + 1, labels)
    lengths = np.sqrt((rows[kept].astype(np.float64) ** 2).sum(axis=1))
    order = np.argsort(-lengths, kind="stable")
    kept, lengths = kept[order], lengths[order]
    return [
        Bucket(ids[p], labels[p], rows[p], lengths[i : i + BUCKET_ROWS])
        for i in range(0, len(kept), BUCKET_ROWS)
        for p in [kept[i : i + BUCKET_ROWS]]
    ]


def search(anchor: Anchor, buckets: list[Bucket], same_label: bool, wanted: list[Best]) -> None:
    """Offer every row of the buckets that some of ``wanted`` may still take."""
    exact = np.float64 if _fits_double(anchor, buckets) else np.int64
    numbers = anchor.numbers.astype(exact)
    for bucket in buckets:
        least = min(w.least for w in wanted)
        if least > anchor.length * bucket.limit * (1 + 1e-9):
            break
        rows = bucket.feasible(anchor, least)
        at = slice(None) if rows is None else rows
        right = (bucket.labels[at] == anchor.label) == same_label
        right &= bucket.ids[at] != anchor.name
        at = np.nonzero(right)[0] if rows is None else rows[right]
        if len(at):
            scores = (bucket.rows[at].astype(exact, copy=False) @ numbers).astype(np.int64)
            for best in wanted:
                best.add(scores, bucket.ids[at])


def _fits_double(anchor: Anchor, buckets: list[Bucket]) -> bool:
    """Whether all partial sums are whole numbers that doubles hold exactly."""
    size = float(np.abs(anchor.numbers).max(initial=0))
    return all(size * float(np.abs(b.rows).max(initial=0)) * len(anchor.numbers) < 2**53 for b in buckets)


def _search_tile(k: int, same_label: bool):
    """Arrow function of a tile: per anchor (and band) the ``k`` best rows."""

    def run(asked: pa.Table, rows: pa.Table) -> pa.Table:
        out: dict[str, list] = {c: [] for c in ("anchor", "anchor_id", "bound", "id", "score")}
        if asked.num_rows and rows.num_rows:
            left, right = as_matrix(asked["vector"], np.int64), as_matrix(rows["vector"], np.int64)
            width = max(left.shape[1], right.shape[1])
            left, right = widened(left, width), widened(right, width)
            buckets = make_buckets(rows["id"].to_numpy(), rows["label"].to_numpy(), right, k)
            bands = asked["bands"].to_pylist()
            keys, names, labels = (asked[c].to_pylist() for c in ("anchor", "id", "label"))
            for n, numbers in enumerate(left):
                wanted = [Best(k, *(band["low"], band["high"]) if not same_label else ()) for band in bands[n]]
                search(Anchor(names[n], labels[n], numbers), buckets, same_label, wanted)
                for band, best in zip(bands[n], wanted):
                    out["anchor"] += [keys[n]] * len(best.ids)
                    out["anchor_id"] += [names[n]] * len(best.ids)
                    out["bound"] += [band["of"]] * len(best.ids)
                    out["id"] += best.ids.tolist()
                    out["score"] += best.scores.tolist()
        return pa.table(out, schema=pa.schema([(c, pa.int64()) for c in out]))

    return run


_TILE = "anchor bigint, anchor_id bigint, bound bigint, id bigint, score bigint"


def _ranked(found: DataFrame, k: int) -> DataFrame:
    """The ``k`` best of each anchor and bound over all tiles."""
    order = Window.partitionBy("anchor", "bound").orderBy(F.desc("score"), "id")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def mine(
    rows: DataFrame,
    is_anchor: Column,
    *,
    positives: int = 5,
    negatives: int = 10,
    low_percent: int = 30,
    high_percent: int = 90,
    id_col: str = "vec_id",
    label_col: str = "label",
    vector_col: str = "embedding",
    block_bytes: int = BLOCK_BYTES,
) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score).

    ``vector_col`` holds arrays of whole numbers.  A negative's score times 100 lies between the two
    percentages of the positive's score, which no score does if the positive's is negative.
    """
    spark = rows.sparkSession
    vector = F.col(f"`{vector_col}`").cast("array<bigint>")
    label = F.col(f"`{label_col}`")
    clean = settle(
        rows.filter(F.col(f"`{id_col}`").isNotNull() & label.isNotNull())
        .filter(F.coalesce(~F.exists(vector, lambda x: x.isNull()), F.lit(False)))
        .select(
            F.col(f"`{id_col}`").cast("bigint").alias("id"),
            label.cast("bigint").alias("label"),
            vector.alias("vector"),
            F.coalesce(is_anchor, F.lit(False)).alias("asks"),
        )
        .distinct()
        .withColumn("anchor", F.xxhash64("id", "label", "vector"))
        .withColumn(
            "length2",
            F.aggregate("vector", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")),
        ),
        "vectors",
    )
    count = clean.agg(F.count("*"), F.count_if("asks"), F.coalesce(F.max(F.size("vector")), F.lit(1))).first()
    if not count[1]:
        return spark.createDataFrame(
            [],
            "anchor_id bigint, positive_id bigint, rank int, negative_id bigint, positive_score bigint, negative_score bigint",
        )
    cores = spark.sparkContext.defaultParallelism
    a_blocks = block_count(count[1], count[1] * count[2], block_bytes)
    r_blocks = block_count(count[0], count[0] * count[2], block_bytes, -(-2 * cores // a_blocks))
    # Longest first; the second key deals rows of one length over several blocks.
    dealt = settle(
        clean.select("id", "label", "vector", "length2", "anchor")
        .repartitionByRange(r_blocks, F.desc("length2"), "anchor")
        .select("id", "label", "vector", F.spark_partition_id().alias("part")),
        "length-blocks",
    )
    # However many partitions there are: neighbours share a block.
    parts = max(r_blocks, dealt.agg(F.max("part")).first()[0] + 1)
    dealt = dealt.withColumn("r", F.floor(F.col("part") * r_blocks / parts)).drop("part")

    def searched(anchors: DataFrame, k: int, same_label: bool) -> DataFrame:
        asked = anchors.withColumn("a", F.pmod(F.xxhash64(F.lit(1), "anchor"), F.lit(a_blocks)))
        asked, offered = tiles(asked, "a", "r", r_blocks), tiles(dealt, "r", "a", a_blocks)
        return asked.groupBy("a", "r").cogroup(offered.groupBy("a", "r")).applyInArrow(_search_tile(k, same_label), _TILE)

    anchors = clean.filter("asks").select("anchor", "id", "label", "vector")
    no_band = F.array(F.struct(*[F.lit(0).cast("bigint").alias(c) for c in ("of", "low", "high")]))
    found = settle(_ranked(searched(anchors.withColumn("bands", no_band), positives, True), positives), "positives")
    bands = (
        found.select("anchor", F.col("score").alias("of"))
        # The smallest and greatest whole number within the percentages; none for a negative score.
        .withColumn("low", F.expr(f"ceil(of * {low_percent} / 100.0BD)").cast("bigint"))
        .withColumn("high", F.expr(f"floor(of * {high_percent} / 100.0BD)").cast("bigint"))
        .filter("low <= high")
        .groupBy("anchor")
        .agg(F.collect_set(F.struct("of", "low", "high")).alias("bands"))
    )
    mined = _ranked(searched(anchors.join(bands, "anchor"), negatives, False), negatives)
    return (
        found.select("anchor", F.col("id").alias("positive_id"), F.col("score").alias("bound"))
        .join(mined, ["anchor", "bound"])
        .select(
            "anchor_id",
            "positive_id",
            "rank",
            F.col("id").alias("negative_id"),
            F.col("bound").alias("positive_score"),
            F.col("score").alias("negative_score"),
        )
    )

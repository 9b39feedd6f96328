"""Near-duplicates by SimHash fingerprints and BK-trees.

A text's fingerprint has a bit set where more than half of its shingle hashes have it.
Two fingerprints link if at most ``RADIUS`` bits differ; documents are grouped by
the connected components of the links.

Only distinct fingerprints are searched.  Each is filed under ``RADIUS + 1`` keys, the
values of as many runs of its bits: two fingerprints within the radius agree on
at least one run and so share a key.  The keys of one shard make a forest of BK-trees, one tree a
key: a node's children are keyed by their integer Hamming distance to it, and a
search from a node at distance d follows only the edges from d - radius to d + radius.  The
trees grow with the corpus, so they are not broadcast to all tasks: a shard's
tree is built in the task that the shard's queries are sent to.

A key with more than ``MAX_TREE`` fingerprints is filed again under runs of its remaining
bits, as often as needed; a tree whose keys fix all but r bits has at most 2**r nodes,
so no group is unbounded and no link is lost.  A shard returns a
spanning forest of its links instead of all pairs; the forests are joined by
:mod:`docquarry.llm.components`.

Defined cases: NULL and texts without words have fingerprint 0, which links like any
other; fewer words than a shingle make one shingle; repeated rows share a
component; documents without an id take no part in naming a component (its id is
the smallest id there is); an empty table gives an empty result.  Only id and text are read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docquarry.llm.common import narrow, settle
from docquarry.llm.components import smallest_reachable

RADIUS = 2
SHINGLE_WORDS = 3
SEED = 42
BITS = 64
MAX_TREE = 20_000
SHARD_ROWS = 60_000
QUERY_ROWS = 8_192
SUM_ROWS = 16_384


def fingerprint(text: bytes | None, words: int = SHINGLE_WORDS) -> int:
    """Unsigned SimHash of a UTF-8 text."""
    parts = text.lower().split() if text else []
    if not parts:
        return 0
    if len(parts) <= words:
        shingles = [b" ".join(parts)]
    else:
        shingles = map(b" ".join, zip(*(parts[i:] for i in range(words))))
    digest = xxhash.xxh64_digest
    hashes = np.frombuffer(b"".join([digest(s, SEED) for s in shingles]), dtype=np.uint8)
    hashes = hashes.reshape(-1, BITS // 8)
    ones = np.zeros(BITS, dtype=np.int64)
    for low in range(0, len(hashes), SUM_ROWS):
        ones += np.unpackbits(hashes[low : low + SUM_ROWS], axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(ones * 2 > len(hashes)).tobytes(), "big")


def fingerprint_column(text: Column, words: int = SHINGLE_WORDS) -> Column:
    """The fingerprint of each text as a signed 64-bit number."""

    def look(column: pa.Array) -> pa.Array:
        values = [fingerprint(text.as_py(), words) for text in column]
        return pa.array(np.array(values, dtype=np.uint64).view(np.int64), pa.int64())

    return F.arrow_udf(look, "bigint")(text.cast("binary"))


def fingerprints(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = SHINGLE_WORDS
) -> DataFrame:
    """(doc_id, fp), the fingerprint as a signed 64-bit number."""
    return narrow(docs, id_col, fingerprint_column(F.col(f"`{text_col}`"), words).alias("fp"))


def runs(free: list[int], parts: int) -> list[list[int]]:
    """Bit positions cut into ``parts`` runs of about equal length."""
    edges = [round(i * len(free) / parts) for i in range(parts + 1)]
    return [free[edges[i] : edges[i + 1]] for i in range(parts)]


def _signed(value: int) -> int:
    return value - (1 << 64) if value >= 1 << 63 else value


def _mask(positions: list[int]) -> int:
    return sum(1 << p for p in positions)


def filed(prints: DataFrame, radius: int = RADIUS, max_tree: int = MAX_TREE) -> DataFrame:
    """(key, fp): every fingerprint under keys that any two within the radius share."""
    kept = None
    level = [(0, list(range(BITS)))]
    rows = prints.select("fp", F.lit(0).cast("bigint").alias("mask"))
    while True:
        # Masks of a level are few and known beforehand; a row meets those below its own.
        deeper, branches = [], None
        for mask, free in level:
            for run in runs(free, radius + 1):
                whole = mask | _mask(run)
                deeper.append((whole, [p for p in free if p not in set(run)]))
                branch = rows.filter(F.col("mask") == _signed(mask)).select(
                    "fp", F.lit(_signed(whole)).cast("bigint").alias("mask")
                )
                branches = branch if branches is None else branches.unionByName(branch)
        keyed = branches.withColumn("key", F.xxhash64("mask", F.col("fp").bitwiseAND(F.col("mask"))))
        fits = min(len(free) for _, free in deeper) <= np.log2(max_tree)
        hot = settle(
            keyed.groupBy("key", "mask").agg(F.count("*").alias("n")).filter(F.col("n") > max_tree),
            "hot-keys",
        )
        if fits or hot.isEmpty():
            now = keyed.select("key", "fp")
            return now if kept is None else kept.unionByName(now)
        cool = keyed.join(hot.select("key"), "key", "left_anti").select("key", "fp")
        kept = cool if kept is None else kept.unionByName(cool)
        rows = settle(keyed.join(hot.select("key"), "key", "left_semi").select("fp", "mask"), "hot-rows")
        level = deeper


class Forest:
    """BK-trees of all keys of a shard, grown level by level over arrays."""

    def __init__(self, keys: np.ndarray, prints: np.ndarray):
        self.prints = prints
        first = np.ones(len(keys), dtype=bool)
        first[1:] = keys[1:] != keys[:-1]
        roots = np.flatnonzero(first)
        self.root = np.repeat(roots, np.diff(np.append(roots, len(keys))))
        # Edges as parent * (BITS + 1) + distance, sorted, with the child beside.
        codes, children = [], []
        item = np.flatnonzero(~first)
        at = self.root[item]
        while len(item):
            code = at * (BITS + 1) + np.bitwise_count(prints[item] ^ prints[at])
            edge, chosen, which = np.unique(code, return_index=True, return_inverse=True)
            codes.append(edge)
            children.append(item[chosen])
            rest = np.ones(len(item), dtype=bool)
            rest[chosen] = False
            at = item[chosen][which][rest]
            item = item[rest]
        codes = np.concatenate(codes) if codes else np.zeros(0, np.int64)
        children = np.concatenate(children) if children else np.zeros(0, np.int64)
        order = np.argsort(codes)
        self.codes, self.children = codes[order], children[order]

    def links(self, radius: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(query, node) index pairs within the radius, each query in its own tree."""
        for low in range(0, len(self.root), QUERY_ROWS):
            query = np.arange(low, min(low + QUERY_ROWS, len(self.root)))
            node = self.root[query]
            while len(query):
                distance = np.bitwise_count(self.prints[query] ^ self.prints[node]).astype(np.int64)
                near = (distance <= radius) & (query != node)
                yield query[near], node[near]
                base = node * (BITS + 1)
                begin = np.searchsorted(self.codes, base + np.maximum(distance - radius, 1), "left")
                end = np.searchsorted(self.codes, base + np.minimum(distance + radius, BITS), "right")
                count = end - begin
                query = np.repeat(query, count)
                step = np.arange(len(query)) - np.repeat(np.cumsum(count) - count, count)
                node = self.children[np.repeat(begin, count) + step]


def _spanning(size: int, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """For each node the smallest node its links reach."""
    low = np.arange(size)
    while True:
        before = low.copy()
        np.minimum.at(low, left, low[right])
        np.minimum.at(low, right, low[left])
        low = low[low]
        if np.array_equal(before, low):
            return low


def shard_links(table: pa.Table, radius: int) -> pa.Table:
    """Spanning links (u, v) of the trees of one shard of (key, fp) rows."""
    keys = table.column("key").to_numpy()
    prints = table.column("fp").to_numpy()
    order = np.lexsort((prints, keys))
    keys, prints = keys[order], prints[order]
    fresh = np.ones(len(keys), dtype=bool)
    fresh[1:] = (keys[1:] != keys[:-1]) | (prints[1:] != prints[:-1])
    keys, prints = keys[fresh], prints[fresh]
    found = [p for p in Forest(keys, prints.view(np.uint64)).links(radius) if len(p[0])]
    left = np.concatenate([p[0] for p in found] or [np.zeros(0, np.int64)])
    right = np.concatenate([p[1] for p in found] or [np.zeros(0, np.int64)])
    low = _spanning(len(prints), left, right)
    moved = np.flatnonzero(low != np.arange(len(prints)))
    return pa.table({"u": prints[moved], "v": prints[low[moved]]})


def fingerprint_links(prints: DataFrame, radius: int = RADIUS, max_tree: int = MAX_TREE) -> DataFrame:
    """(u, v): links between distinct fingerprints that span all links within the radius."""
    keyed = filed(prints, radius, max_tree)
    shards = max(1, -(-prints.count() * (radius + 1) // SHARD_ROWS))

    def search(table: pa.Table) -> pa.Table:
        return shard_links(table.select(["key", "fp"]), radius)

    return (
        keyed.withColumn("shard", F.pmod("key", F.lit(shards)))
        .groupBy("shard")
        .applyInArrow(search, "u bigint, v bigint")
    )


def near_duplicates(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    radius: int = RADIUS,
    words: int = SHINGLE_WORDS,
) -> DataFrame:
    """(doc_id, fingerprint, component_id): 16 hex digits, and the smallest id reachable."""
    own = settle(fingerprints(docs, id_col, text_col, words), "fingerprints")
    prints = settle(own.groupBy("fp").agg(F.min("doc_id").alias("low")), "distinct-fingerprints")
    roots = smallest_reachable(fingerprint_links(prints.select("fp"), radius))
    rooted = (
        prints.join(roots, prints["fp"] == roots["node"], "left")
        .select("fp", "low", F.coalesce("root", "fp").alias("root"))
    )
    names = rooted.groupBy("root").agg(F.min("low").alias("component_id"))
    # Written, so that a fingerprint or component with a third of the rows can be split.
    named = settle(
        rooted.join(settle(names, "component-names"), "root").select("fp", "component_id"), "components"
    )
    return own.join(named, "fp").select(
        "doc_id",
        F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"),
        "component_id",
    )


def deduplicate(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """One row of each component, all its columns: the smallest id's (of its repeated rows, one).

    Documents without an id cannot be named; all of them stay.
    """
    names = near_duplicates(docs, id_col, text_col, **options)
    firsts = names.filter(F.col("doc_id") == F.col("component_id")).select("doc_id").distinct()
    own = docs.join(firsts, docs[id_col] == firsts["doc_id"], "left_semi").dropDuplicates([id_col])
    return own.unionByName(docs.filter(F.col(id_col).isNull()))

"""Benchmark decontamination by winnowing.

Documents and test items are cut into words (runs of a-z, 0-9 and everything
beyond ASCII, A-Z in lower case).  Of every ``WINDOW - GRAM + 1`` consecutive
``GRAM``-word hashes the smallest is kept, the last one where several are
smallest.  Two texts that share ``WINDOW`` words share one whole run of such hashes
and so keep the same one: no shared span of that length is missed.  Kept
fingerprints of documents are looked up among those of the items, and each hit
is extended word by word to both sides; spans shorter than ``WINDOW`` words are
dropped.  Items of fewer words are one window each: their whole-item hashes are
looked up at every position, one length at a time.

Hashing runs over whole Arrow buffers with numpy.  The test set is taken in
blocks of at most ``BLOCK_BYTES`` of text (a single longer item is a block), so what
travels to the tasks is bounded whatever its size; every block meets all
documents, and the blocks' spans are united per document.

Defined cases: NULL and empty texts have no words and are never hit; an item
without words occurs nowhere; an item with a NULL id marks words but cannot be
named; equal items are all named; an empty test set leaves every document
clean.  Input columns named like a result are replaced by it.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docquarry.llm.common import attach, packed, unpacked

WINDOW = 10
GRAM = 5
BLOCK_BYTES = 16 << 20
SLICE_BYTES = 1 << 20

RESULT = "n_words bigint, spans array<struct<start:int,end:int>>, items array<string>"
FIELDS = ["n_words", "spans", "items"]

_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32
_IS_WORD = np.zeros(256, dtype=bool)
for _low, _high in ((48, 58), (97, 123), (128, 256)):
    _IS_WORD[_low:_high] = True
_STEP = np.uint64(0x9E3779B97F4A7C15)


def _mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every input bit."""
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xA0761D6478BD642F)
    return x ^ (x >> np.uint64(32))


def _powers(count: int) -> np.ndarray:
    steps = np.full(max(count, 1), _STEP, dtype=np.uint64)
    steps[0] = 1
    return np.multiply.accumulate(steps)


def word_hashes(
    data: np.ndarray, offsets: np.ndarray, in_word: np.ndarray = _IS_WORD
) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words of the texts ``data[offsets[i]:offsets[i + 1]]`` and each word's text."""
    folded = _FOLD[data]
    inside = in_word[folded]
    at = np.flatnonzero(inside)
    if not len(at):
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    fresh = np.ones(len(at), dtype=bool)
    fresh[1:] = np.diff(at) > 1
    # A text begins a new word even where the one before ends in a word.
    begins = np.searchsorted(at, offsets[:-1])
    begins = begins[begins < len(at)]
    fresh[begins] = True
    starts = np.flatnonzero(fresh)
    lengths = np.diff(np.append(starts, len(at)))
    place = np.arange(len(at)) - np.repeat(starts, lengths)
    scaled = _mix(folded[at].astype(np.uint64) + np.uint64(1)) * _powers(int(lengths.max()))[place]
    words = _mix(np.add.reduceat(scaled, starts) + lengths.astype(np.uint64))
    texts = np.searchsorted(offsets, at[starts], side="right") - 1
    return words, texts


def gram_hashes(words: np.ndarray, size: int) -> np.ndarray:
    """Hash of the ``size`` words from each position that has so many after it."""
    count = len(words) - size + 1
    if count <= 0:
        return np.zeros(0, np.uint64)
    total = np.zeros(count, dtype=np.uint64)
    for shift, factor in enumerate(_powers(size + 1)[1:]):
        total += words[shift : shift + count] * factor
    return _mix(total)


def winnow(words: np.ndarray, texts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(positions, hashes) of the grams that some window of one text keeps."""
    grams = gram_hashes(words, GRAM)
    run = WINDOW - GRAM + 1
    count = len(grams) - run + 1
    if count <= 0:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    best, where = grams[:count].copy(), np.arange(count)
    for shift in range(1, run):
        other = grams[shift : shift + count]
        lower = other <= best
        best[lower] = other[lower]
        where[lower] = np.flatnonzero(lower) + shift
    whole = texts[:count] == texts[WINDOW - 1 : WINDOW - 1 + count]
    kept = np.unique(where[whole])
    return kept, grams[kept]


class TestIndex:
    """Fingerprints of one block of items; built on the driver, used by the tasks."""

    __test__ = False

    def __init__(self, items: list[tuple[str | None, str]]):
        self.names = [name for name, _ in items]
        data, offsets = _buffers([text for _, text in items])
        self.words, self.texts = word_hashes(data, offsets)
        self.first = np.searchsorted(self.texts, np.arange(len(items) + 1))
        places, hashes = winnow(self.words, self.texts)
        order = np.argsort(hashes, kind="stable")
        self.places, self.hashes = places[order], hashes[order]
        self.short: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        lengths = np.diff(self.first)
        for size in range(1, WINDOW):
            chosen = np.flatnonzero(lengths == size)
            if len(chosen):
                found = gram_hashes(self.words, size)[self.first[chosen]]
                order = np.argsort(found, kind="stable")
                self.short[size] = (found[order], chosen[order])

    def hits(self, words: np.ndarray, texts: np.ndarray) -> list[tuple[int, int, int]]:
        """(start, end, item) of every longest shared span, by word position; whole items."""
        found = self._short_hits(words, texts)
        places, hashes = winnow(words, texts)
        low = np.searchsorted(self.hashes, hashes, side="left")
        high = np.searchsorted(self.hashes, hashes, side="right")
        reached: dict[tuple[int, int], int] = {}
        for k in np.flatnonzero(high > low):
            for place in self.places[low[k] : high[k]]:
                here, there = int(places[k]), int(place)
                text, item = texts[here], int(self.texts[there])
                line = (item, here - there)
                if reached.get(line, -1) > here:
                    continue
                start, end = self._extend(words, texts, here, there, text, item)
                reached[line] = end
                if end - start >= WINDOW:
                    found.append((start, end, item))
        return found

    def _extend(self, words, texts, here, there, text, item) -> tuple[int, int]:
        first, last = self.first[item], self.first[item + 1]
        back = 0
        while (
            here - back > 0
            and there - back > first
            and texts[here - back - 1] == text
            and words[here - back - 1] == self.words[there - back - 1]
        ):
            back += 1
        ahead = 0
        while (
            here + ahead < len(words)
            and there + ahead < last
            and texts[here + ahead] == text
            and words[here + ahead] == self.words[there + ahead]
        ):
            ahead += 1
        return here - back, here + ahead

    def _short_hits(self, words, texts) -> list[tuple[int, int, int]]:
        found = []
        for size, (hashes, items) in self.short.items():
            grams = gram_hashes(words, size)
            low = np.searchsorted(hashes, grams, side="left")
            high = np.searchsorted(hashes, grams, side="right")
            for k in np.flatnonzero(high > low):
                if texts[k] == texts[k + size - 1]:
                    found += [(int(k), int(k) + size, int(i)) for i in items[low[k] : high[k]]]
        return found


def _buffers(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    raw = [t.encode("utf-8") for t in texts]
    offsets = np.zeros(len(raw) + 1, dtype=np.int64)
    np.cumsum([len(r) for r in raw], out=offsets[1:])
    return np.frombuffer(b"".join(raw), dtype=np.uint8), offsets


def text_slices(column: pa.Array, limit: int = SLICE_BYTES):
    """(first row, bytes, offsets) of stretches of a string column, about ``limit`` bytes each."""
    column = column.fill_null("").cast(pa.large_binary())
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64)
    offsets = offsets[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    data = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    row = 0
    while row < len(column):
        stop = int(np.searchsorted(offsets, offsets[row] + limit, side="right")) - 1
        stop = min(max(stop, row + 1), len(column))
        yield row, data[offsets[row] : offsets[stop]], offsets[row : stop + 1] - offsets[row]
        row = stop


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Sorted spans without overlap, same words covered."""
    out: list[tuple[int, int]] = []
    for start, end in sorted(spans):
        if out and start <= out[-1][1]:
            out[-1] = (out[-1][0], max(end, out[-1][1]))
        else:
            out.append((start, end))
    return out


def _scan_udf(index: TestIndex):
    kind = pa.struct(
        [
            ("n_words", pa.int64()),
            ("spans", pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))),
            ("items", pa.list_(pa.string())),
        ]
    )

    def look(column: pa.Array) -> pa.Array:
        rows = []
        for _, data, offsets in text_slices(column):
            words, texts = word_hashes(data, offsets)
            first = np.searchsorted(texts, np.arange(len(offsets)))
            counts = np.diff(first)
            by_row: dict[int, list] = {}
            for hit in index.hits(words, texts):
                by_row.setdefault(int(texts[hit[0]]), []).append(hit)
            for row, count in enumerate(counts):
                own, base = by_row.get(row, ()), int(first[row])
                spans = merged([(s - base, e - base) for s, e, _ in own])
                names = {index.names[i] for _, _, i in own} - {None}
                rows.append(
                    {
                        "n_words": int(count),
                        "spans": [{"start": s, "end": e} for s, e in spans],
                        "items": sorted(names),
                    }
                )
        return pa.array(rows, type=kind)

    return F.arrow_udf(look, RESULT)


def test_blocks(benchmark: DataFrame, item_col: str, text_col: str, block_bytes: int):
    """The test set in blocks of bounded size, each collected when its turn comes."""
    items = benchmark.select(
        F.col(item_col).cast("string").alias("name"), F.coalesce(F.col(text_col), F.lit("")).alias("text")
    )
    total = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = max(1, -(-total // block_bytes))
    for block in range(blocks):
        part = items.filter(F.pmod(F.xxhash64("name", "text"), F.lit(blocks)) == block)
        yield TestIndex([(r["name"], r["text"]) for r in part.collect()])


test_blocks.__test__ = False


def _united(spans: Column) -> Column:
    """Sorted spans, overlaps merged."""
    kind = "array<struct<start:int,end:int>>"

    def add(done: Column, s: Column) -> Column:
        last = F.element_at(done, -1)
        wider = F.struct(last["start"].alias("start"), F.greatest(s["end"], last["end"]).alias("end"))
        return (
            F.when(F.size(done) == 0, F.array(s))
            .when(s["start"] <= last["end"], F.concat(F.slice(done, 1, F.size(done) - 1), F.array(wider)))
            .otherwise(F.concat(done, F.array(s)))
        )

    return F.aggregate(F.array_sort(spans), F.array().cast(kind), lambda done, s: add(done, s).cast(kind))


def find_contamination(
    docs: DataFrame,
    benchmark: DataFrame,
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
    block_bytes: int = BLOCK_BYTES,
) -> DataFrame:
    """``docs`` with ``n_words``, ``spans`` (hit words, merged) and ``items`` (names found).

    Each row is looked at on its own: no shuffle, whatever is common.
    """
    text = F.col(f"`{text_col}`")
    found = docs
    blocks = []
    for index in test_blocks(benchmark, item_col, item_text_col, block_bytes):
        name = f"__block{len(blocks)}"
        while name in docs.columns:
            name += "_"
        blocks.append(F.col(f"`{name}`"))
        found = found.withColumn(name, _scan_udf(index)(text))
    every = {f: F.flatten(F.array(*[b[f] for b in blocks])) for f in ("spans", "items")}
    result = F.struct(
        blocks[0]["n_words"].alias("n_words"),
        _united(every["spans"]).alias("spans"),
        F.array_sort(F.array_distinct(every["items"])).alias("items"),
    )
    kept = [c for c in docs.columns if c.lower() not in FIELDS]
    return attach(found, blocks[0] if len(blocks) == 1 else result, FIELDS).select(
        *[F.col(f"`{c}`") for c in kept], *FIELDS
    )


def hit_words(spans: Column) -> Column:
    """Number of words in merged spans."""
    return F.aggregate(
        spans, F.lit(0).cast("bigint"), lambda n, s: n + s["end"] - s["start"]
    )


def decontaminate(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", **options) -> DataFrame:
    """The documents without a hit, all their columns."""
    own = packed(docs, text_col, text_col).select("row", "text")
    found = find_contamination(own, benchmark, "text", **options)
    return unpacked(found.filter(F.size("spans") == 0), docs)

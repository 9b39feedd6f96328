"""Exact duplicates by two-pass Bloom filtering.

Pass 1 counts how often every bit of a Bloom filter is set; the bits that were
set twice or more form the filter of pass 2.  Both bits of a text lie in one
64-bit word, so one join finds them.  A text whose bits are not both in the
filter is certainly unique and goes straight to the result.  Only the others
are shuffled, by the full SHA-256 of the text, so a false positive costs a row
of traffic and never a wrong answer.

The filter has 16 bits a row and is kept sparse (words without a repeated bit
have no row), so it grows with the repeats.  It is broadcast while it has at
most ``MAX_SENT_WORDS`` rows; beyond that the same join runs as a shuffle join of
(id, digest) rows.  Texts are read once and never shuffled for the classes.

Defined cases: a NULL text equals the empty text; a NULL id is an id like any
other and loses to every number; rows that repeat id and text are one document
whose ``group_size`` counts all its rows; an empty table gives an empty result.
Other columns are not read, so clashing names are harmless.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docquarry.llm.common import narrow, packed, settle, unpacked

BITS_PER_ROW = 16
MAX_SENT_WORDS = 1 << 20


def _digest(text: Column) -> Column:
    return F.unhex(F.sha2(F.coalesce(text, F.lit("")), 256))


def _word_and_bits(digest: Column, words: int) -> tuple[Column, Column, Column]:
    where, which = F.xxhash64(digest), F.xxhash64(digest, F.lit(1))
    first = F.pmod(which, F.lit(64))
    step = F.pmod(F.shiftright(which, 6), F.lit(63)) + 1
    return F.pmod(where, F.lit(words)), first, F.pmod(first + step, F.lit(64))


def _bit(position: Column) -> Column:
    return F.call_function("shiftleft", F.lit(1).cast("bigint"), position.cast("int"))


def repeated_bits(digests: DataFrame, words: int) -> DataFrame:
    """(word, bits): the bits that at least two rows set."""
    word, first, second = _word_and_bits(F.col("digest"), words)
    return (
        digests.select(word.alias("word"), F.explode(F.array(first, second)).alias("bit"))
        .groupBy("word", "bit")
        .agg(F.count("*").alias("n"))
        .filter("n > 1")
        .groupBy("word")
        .agg(F.bit_or(_bit(F.col("bit"))).alias("bits"))
    )


class RepeatFilter:
    """The filter of pass 2, built from the ``digest`` column of ``digests``."""

    def __init__(self, digests: DataFrame):
        self.words = max(1, digests.count() * BITS_PER_ROW // 64)
        found = settle(repeated_bits(digests, self.words), "bloom")
        self.found = F.broadcast(found) if found.count() <= MAX_SENT_WORDS else found

    def mark(self, rows: DataFrame, digest: str, candidate: str) -> DataFrame:
        """Add ``candidate``: may another row have the same digest?"""
        word, first, second = _word_and_bits(F.col(digest), self.words)
        mask = _bit(first).bitwiseOR(_bit(second))
        hit = F.coalesce(F.col("__bits").bitwiseAND(mask) == mask, F.lit(False))
        found = self.found.select(F.col("word").alias("__word"), F.col("bits").alias("__bits"))
        return (
            rows.withColumn("__word", word)
            .join(found, "__word", "left")
            .withColumn(candidate, hit)
            .drop("__word", "__bits")
        )


def _classes(candidates: DataFrame) -> DataFrame:
    """(digest, keep_id, group_size).

    Written, so that both sides of the joins with it are plain exchanges and a class with
    a third of all rows can be split.
    """
    return settle(
        candidates.groupBy("digest").agg(
            F.max("doc_id").alias("keep_id"), F.count("*").alias("group_size")
        ),
        "classes",
    )


def duplicate_classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, keep_id, group_size, kept, text_sha256), one row per document."""
    digests = settle(narrow(docs, id_col, _digest(F.col(text_col)).alias("digest")), "digests")
    marked = RepeatFilter(digests).mark(digests, "digest", "candidate")
    single = marked.filter(~F.col("candidate")).select(
        "doc_id",
        F.col("doc_id").alias("keep_id"),
        F.lit(1).cast("bigint").alias("group_size"),
        "digest",
    )
    candidates = marked.filter("candidate")
    members = candidates.groupBy("doc_id", "digest").agg(F.count("*").alias("copies"))
    grouped = members.join(_classes(candidates), "digest").select(
        "doc_id", "keep_id", "group_size", "digest"
    )
    return single.unionByName(grouped).select(
        "doc_id",
        "keep_id",
        "group_size",
        F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"),
    )


def deduplicate(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that stay, all columns; of fully repeated rows one stays.

    Rows that the filter clears are not moved; only the others meet their class.
    """
    rows = packed(docs, id_col, text_col).withColumn("digest", _digest(F.col("text")))
    digests = settle(rows.select("doc_id", "digest"), "digests")
    repeats = RepeatFilter(digests)
    classes = _classes(repeats.mark(digests, "digest", "candidate").filter("candidate"))
    marked = repeats.mark(rows, "digest", "candidate")
    chosen = (
        marked.filter("candidate")
        .join(classes, "digest")
        .filter(F.col("doc_id").eqNullSafe(F.col("keep_id")))
        .dropDuplicates(["digest"])
    )
    return unpacked(marked.filter(~F.col("candidate")).select("row").unionByName(chosen.select("row")), docs)

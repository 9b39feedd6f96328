"""Near-duplicate lines by an exact set-similarity join.

A line is the set of its words (runs without ASCII white space, in lower case).  A line goes
if an earlier line of the corpus, in the order of id, text hash and line number, has
a Jaccard similarity of at least ``PERCENT`` / 100 with it; whether that line goes
too does not matter.

1.  Words are ordered by rarity: occurrences are counted over all texts in
    ``BUCKETS`` hashed counters (a bounded table), then by hash.  The order decides
    how many sets meet, never the result.
2.  Equal sets become one row, with the place of their first line.
3.  Two similar sets share a word among the first ``size - ceil(t * size) + 1`` of
    each.  Sets are joined on those words; pairs are kept if their sizes, the positions of the word
    and the words' sketches still allow the overlap that the similarity needs, and, where
    sets are too large for sketches, if their whole prefixes do.  All of these
    are upper bounds, so no link is lost.  A sketch has 128 or 512 bits, each the parity of the words
    that fall on it: two sets differ in at least as many words as their sketches in bits.  Of the
    smaller of two sets the first ``size - ceil(2 * t / (1 + t) * size) + 1`` words are enough.
4.  Pairs are verified on the words of the whole lines, read again for the candidates only.

A cluster of many variants of a line would give all its pairs, so step 3 runs
twice: first every set meets only the earliest set of each of its frequent words and the nearest of
these is verified, which removes nearly all of a cluster; then the sets still standing meet all
earlier ones.  Everything is DataFrame work.  Sets are told apart by 64-bit hashes of words of 56
bits, so two different ones are one with a chance of 2**-56 at most.

Defined cases: lines without a word stay; a NULL text has no lines and stays NULL; of
repeated rows (id and text) all keep what one keeps; rows that share an id but not
the text are told apart; an empty table gives an empty result.  Other columns pass through, whatever their names.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docquarry.llm.common import packed, passing, release, settle, unpacked

PERCENT = 80
BUCKETS = 1 << 18
# One in so many buckets has frequent words at most; levels from FREQUENT on are theirs.
FREQUENT_SHARE = 4
FREQUENT = 64
# Sets of more words have a sketch of 512 bits too; beyond SKETCHED_WORDS it hardly tells sets apart.
WIDE_WORDS = 160
SKETCHED_WORDS = 512
# A line's number has its document's rank above these bits and its place in the text below.
LINE_BITS = 31
# The bits that Spark's increasing ids leave for the rows of a partition.
ROW_BITS = 33
# Prefix words are joined in so many parts, one after the other, so that less lies on disk at once.
PARTS = 2
# A token has the level of its word above 56 bits of the hash.
LEVEL_SHIFT = 56
# Rows, and rows and line numbers, that may be sent to every task (16 and 40 MB at most).
MAX_SENT_IDS = 1 << 20
MAX_SENT_NUMBERS = 1 << 20


def words_of(text: Column) -> Column:
    """Words of a text, repeats included."""
    return F.array_remove(F.split(F.lower(text), r"[\x20\x09-\x0D]+"), "")


def _cut(line: Column) -> Column:
    """Words of a line in lower case, with empty ones; lines without other white space, nearly all, need no pattern."""
    return F.when(line.rlike(r"[\x09\x0B-\x0D]"), F.split(line, r"[\x20\x09-\x0D]+")).otherwise(F.split(line, " "))


def word_counts(rows: DataFrame, buckets: int = BUCKETS) -> np.ndarray:
    """Occurrences of words over column ``text`` of all rows, in hashed counters."""
    line = F.replace(F.lower("text"), F.lit("\n"), F.lit(" "))
    # The outer form, as the other one cuts the words twice, once to see whether there are any.
    words = rows.select(F.explode_outer(_cut(line)).alias("w")).filter("w <> ''")
    bucket = F.xxhash64("w").bitwiseAND(F.lit(buckets - 1)).cast("int")
    found = words.groupBy(bucket.alias("b")).agg(F.count("*").alias("n")).toArrow()
    counts = np.zeros(buckets, dtype=np.int64)
    counts[found.column("b").to_numpy()] = found.column("n").to_numpy()
    return counts


def rarity_levels(rows: DataFrame, buckets: int = BUCKETS) -> Column:
    """A constant array: the logarithm of each bucket's count, from ``FREQUENT`` on for the fullest buckets."""
    counts = word_counts(rows, buckets)
    # Of equal counts all or none are frequent; words seen once never are.
    least = max(2, int(np.partition(counts, -(buckets // FREQUENT_SHARE) - 1)[-(buckets // FREQUENT_SHARE) - 1]) + 1)
    steps = np.log2(np.maximum(counts, 1) / np.where(counts < least, 1, least))
    levels = np.minimum(FREQUENT - 1, 4 * steps).astype(int) + np.where(counts < least, 0, FREQUENT)
    return F.split(F.lit(",".join(map(str, levels))), ",").cast("array<bigint>")


def _tokens(line: Column, levels: Column, buckets: int) -> Column:
    """The word set of a line in lower case as sorted 64-bit values, rare words first."""

    def token(code: Column) -> Column:
        level = F.call_function("shiftleft", levels[code.bitwiseAND(F.lit(buckets - 1))], F.lit(LEVEL_SHIFT))
        # Never NULL, and Spark sorts an array that it knows to have no NULL as plain numbers.
        return F.coalesce(level, F.lit(0).cast("bigint")).bitwiseOR(F.shiftrightunsigned(code, 8))

    codes = F.array_distinct(F.transform(F.array_remove(_cut(line), ""), lambda word: F.xxhash64(word)))
    return F.sort_array(F.transform(codes, token))


def _sketch(tokens: Column, part: int, parts: int) -> Column:
    """64 of the bits of a sketch: the parities of the tokens that fall on each."""
    bits = [0] * (64 * parts)
    for place in range(64):
        bits[64 * part + place] = 1 << place if place < 63 else -(1 << 63)
    marks = F.split(F.lit(",".join(map(str, bits))), ",").cast("array<bigint>")
    last = F.lit(64 * parts - 1)
    return F.aggregate(
        tokens, F.lit(0).cast("bigint"), lambda met, token: met.bitwiseXOR(marks[token.bitwiseAND(last)])
    )


def ranked(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``rows`` with the rank of each (doc_id, th), and (doc_id, th, rank); ranks have gaps."""
    known = rows.filter(F.col("text").isNotNull())
    ordered = known.select("doc_id", "th").distinct().orderBy("doc_id", "th")
    ordered = settle(ordered.withColumn("at", F.monotonically_increasing_id()), "line-ranks")
    row = F.col("at").bitwiseAND(F.lit((1 << ROW_BITS) - 1))
    count, most = ordered.agg(F.count("*"), F.max(row)).first()
    rank = F.call_function("shiftright", F.col("at"), F.lit(ROW_BITS)) * ((most or 0) + 1) + row
    ranks = ordered.select("doc_id", "th", rank.alias("rank"))
    named = ranks.toDF("d", "t", "rank")
    if count <= MAX_SENT_IDS:
        named = F.broadcast(named)
    met = known.join(named, F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("th") == F.col("t")))
    return met.select("rank", "th", "text"), ranks


def numbered_lines(rows: DataFrame, text: Column) -> DataFrame:
    """(number, line); numbers are in the order of documents and lines."""
    lines = rows.select("rank", F.posexplode(F.split(text, "\n")).alias("line_no", "line"))
    first = F.call_function("shiftleft", F.col("rank"), F.lit(LINE_BITS))
    return lines.select((first + F.col("line_no")).alias("number"), "line")


def split_lines(rows: DataFrame, levels: Column, buckets: int) -> DataFrame:
    """(number, tokens) of every line that has a word."""
    lines = numbered_lines(rows, F.lower("text"))
    # Asked of the line: a filter on the tokens would be pushed below them and cut the words twice.
    return lines.filter(F.col("line").rlike(r"[^\x20\x09-\x0D]")).select(
        "number", _tokens(F.col("line"), levels, buckets).alias("tokens")
    )


def _needed(size: Column, percent: int) -> Column:
    return F.ceil(size * percent / F.lit(100.0)).cast("int")


def described_lines(lines: DataFrame, percent: int) -> DataFrame:
    """(number, set_id, size, prefix, low, high, wide), a row per line; the last three are the sketches."""
    size, tokens = F.size("tokens"), F.col("tokens")
    return lines.select(
        "number",
        F.xxhash64("tokens").alias("set_id"),
        size.alias("size"),
        F.slice("tokens", F.lit(1), size - _needed(size, percent) + 1).alias("prefix"),
        _sketch(tokens, 0, 2).alias("low"),
        _sketch(tokens, 1, 2).alias("high"),
        F.when(size > WIDE_WORDS, F.array(*[_sketch(tokens, part, 8) for part in range(8)])).alias("wide"),
    )


def word_sets(lines: DataFrame) -> DataFrame:
    """(set_id, n, number, size, prefix, low, high, wide), a row per different set with its first line's number."""
    return lines.groupBy("set_id").agg(
        F.count("*").alias("n"),
        F.min("number").alias("number"),
        *[F.first(c).alias(c) for c in ("size", "prefix", "low", "high", "wide")],
    )


def _prefix_rows(sets: DataFrame, part: int, *columns: str) -> DataFrame:
    """One row per prefix word of a part."""
    rows = sets.select(F.posexplode("prefix").alias("pos", "token"), "number", "size", "low", "high", *columns)
    return rows.filter(F.pmod("token", F.lit(PARTS)) == part)


def _heads(prefixes: DataFrame) -> DataFrame:
    """The row of the earliest set of every word that several sets have; a narrow sum, so hot words cost nothing."""
    of_first = [F.min_by(c, "number").alias(c) for c in ("pos", "size", "low", "high")]
    return (
        prefixes.groupBy("token")
        .agg(F.min("number").alias("number"), *of_first, F.count("*").alias("sharing"))
        .filter("sharing > 1")
        .drop("sharing")
    )


def _differing(a: str, b: str) -> Column:
    """Bits in which two sketches differ."""
    low, high = (F.col(f"{a}.{half}").bitwiseXOR(F.col(f"{b}.{half}")) for half in ("low", "high"))
    return F.bit_count(low) + F.bit_count(high)


def _may_match(a: str, b: str, percent: int) -> Column:
    """Can the two sets still reach the similarity, if this is their first common word?

    Whole numbers and the cheapest tests first, as this runs for every two rows of a word.
    """
    size_a, size_b = F.col(f"{a}.size"), F.col(f"{b}.size")
    both = size_a + size_b
    overlap = F.least(size_a - F.col(f"{a}.pos"), size_b - F.col(f"{b}.pos"))
    return (
        (overlap * (100 + percent) >= both * percent)
        & (F.least(size_a, size_b) * 100 >= F.greatest(size_a, size_b) * percent)
        & (_differing(a, b) * (100 + percent) <= both * (100 - percent))
    )


def _wide_may_match(a: str, b: str, percent: int) -> Column:
    """The same by the larger sketches, where both sets have one."""
    apart = F.lit(0)
    for part in range(8):
        apart = apart + F.bit_count(F.col(f"{a}.wide")[part].bitwiseXOR(F.col(f"{b}.wide")[part]))
    both = F.col(f"{a}.size") + F.col(f"{b}.size")
    return F.coalesce(apart * (100 + percent) <= both * (100 - percent), F.lit(True))


def _by_parts(sets: DataFrame, meet) -> DataFrame:
    """What ``meet`` finds in all parts; files of a part's exchanges go before the next."""
    found = None
    for part in range(PARTS):
        met = settle(meet(part), "line-pairs")
        found = met if found is None else found.unionByName(met)
        release(sets.sparkSession)
    return found


def _nearest_heads(sets: DataFrame, percent: int) -> DataFrame:
    """(x, y): each set and the nearest of the earliest sets of its frequent words, if one may match."""

    def meet(part: int) -> DataFrame:
        rows = _prefix_rows(sets, part).filter(F.col("token") >= (FREQUENT << LEVEL_SHIFT))
        a, b = rows.alias("a"), _heads(rows).alias("b")
        is_later = F.col("a.number") > F.col("b.number")
        met = a.join(b, (F.col("a.token") == F.col("b.token")) & is_later & _may_match("a", "b", percent)).select(
            F.col("a.number").alias("x"), F.col("b.number").alias("y"), _differing("a", "b").alias("apart")
        )
        return met.groupBy("x").agg(F.min_by("y", "apart").alias("y"), F.min("apart").alias("apart"))

    return _by_parts(sets, meet).groupBy("x").agg(F.min_by("y", "apart").alias("y"))


def _all_pairs(sets: DataFrame, gone: DataFrame, percent: int) -> DataFrame:
    """(x, y, apart): each set that is not ``gone`` (x) and every earlier one that it may match."""
    marked = sets.join(gone.select(F.col("x").alias("number"), F.lit(True).alias("gone")), "number", "left")

    def meet(part: int) -> DataFrame:
        rows = _prefix_rows(marked, part, "wide", "gone")
        size = F.col("size")
        kept = size - F.ceil(size * (2 * percent) / F.lit(100.0 + percent)).cast("int") + 1
        a, b = rows.filter(F.col("pos") < kept).alias("a"), rows.alias("b")
        is_smaller = (F.col("a.size") < F.col("b.size")) | (
            (F.col("a.size") == F.col("b.size")) & (F.col("a.number") < F.col("b.number"))
        )
        is_later = F.col("a.number") > F.col("b.number")
        stands = F.when(is_later, F.col("a.gone")).otherwise(F.col("b.gone")).isNull()
        may = is_smaller & _may_match("a", "b", percent) & stands & _wide_may_match("a", "b", percent)
        met = a.join(b, (F.col("a.token") == F.col("b.token")) & may).select(
            F.greatest("a.number", "b.number").alias("x"),
            F.least("a.number", "b.number").alias("y"),
            _differing("a", "b").alias("apart"),
            F.col("b.size").alias("size"),
        )
        return met.groupBy("x", "y").agg(F.first("apart").alias("apart"), F.first("size").alias("size"))

    found = settle(
        _by_parts(sets, meet).groupBy("x", "y").agg(F.first("apart").alias("apart"), F.first("size").alias("size")),
        "line-pairs",
    )
    large = found.filter(F.col("size") > SKETCHED_WORDS).drop("size")
    sized = sets.select("number", "size", "prefix")
    return found.filter(F.col("size") <= SKETCHED_WORDS).drop("size").unionByName(_prefixes_agree(large, sized, percent))


def _prefixes_agree(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs whose whole prefixes still allow the similarity.

    A prefix has all words of its set up to its last one, so what another prefix has before that
    place and this one has not, the set has not.  This holds for sets of every size.
    """

    def missing(own: str, other: str) -> Column:
        return F.size(F.filter(F.array_except(own, other), lambda t: t < F.col(f"{other}_last")))

    a, b = sets.toDF("x", "size_x", "prefix_x"), sets.toDF("y", "size_y", "prefix_y")
    met = pairs.join(a, "x").join(b, "y").select(
        "*", F.array_max("prefix_x").alias("prefix_x_last"), F.array_max("prefix_y").alias("prefix_y_last")
    )
    asked = (F.col("size_x") + F.col("size_y")) * percent
    left_x = F.col("size_x") - missing("prefix_x", "prefix_y")
    left_y = F.col("size_y") - missing("prefix_y", "prefix_x")
    return met.filter((left_x * (100 + percent) >= asked) & (left_y * (100 + percent) >= asked)).select(
        "x", "y", "apart"
    )


def _verified(pairs: DataFrame, rows: DataFrame, percent: int, one_each: bool = False) -> DataFrame:
    """(x): the sets of ``pairs`` that reach the similarity with an earlier one, by their whole lines.

    The nearest partner of a set is compared first; only sets that it does not settle are
    compared with all others.  With ``one_each`` no set has others.
    """
    pairs = settle(pairs, "line-pairs")
    numbers = pairs.select(F.col("x").alias("number")).unionByName(pairs.select(F.col("y").alias("number")))
    wanted = settle(numbers.distinct(), "line-places")
    if wanted.count() <= MAX_SENT_IDS:
        wanted = F.broadcast(wanted)
    whole = settle(numbered_lines(rows, F.col("text")).join(wanted, "number"), "lines-compared")

    def similar(asked: DataFrame) -> DataFrame:
        a, b = whole.toDF("x", "one"), whole.toDF("y", "two")
        words = asked.join(a, "x").join(b, "y").select(
            "x", F.array_distinct(words_of(F.col("one"))).alias("one"), F.array_distinct(words_of(F.col("two"))).alias("two")
        )
        shared = F.size(F.array_intersect("one", "two"))
        # A filter here would be pushed below the cutting of words.
        judged = words.select(
            "x", (shared * (100 + percent) >= (F.size("one") + F.size("two")) * percent).alias("same")
        )
        return judged.groupBy("x").agg(F.max("same").alias("same")).filter("same").select("x")

    if one_each:
        return similar(pairs)
    best = settle(pairs.groupBy("x").agg(F.min_by("y", "apart").alias("y")), "line-partners")
    first = settle(similar(best), "lines-settled")
    others = pairs.select("x", "y").join(first, "x", "left_anti").join(best, ["x", "y"], "left_anti")
    return first.unionByName(similar(others))


def repeated_lines(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    percent: int = PERCENT,
    buckets: int = BUCKETS,
) -> DataFrame:
    """(doc_id, th, numbers): the lines that go, for each document that loses any.

    ``th`` is the hash of the text and tells rows of one id apart; line numbers start at 0.
    """
    rows = docs.select(
        F.col(id_col).alias("doc_id"), F.xxhash64(text_col).alias("th"), F.col(text_col).alias("text")
    )
    levels = rarity_levels(rows, buckets)
    with passing() as keep:
        rows, ranks = ranked(rows)
        # Every line is cut into words here and never again but to verify candidates.
        lines = settle(described_lines(split_lines(rows, levels, buckets), percent), "line-rows")
        sets = settle(word_sets(lines), "line-sets")
        release(docs.sparkSession)

        with passing() as keep_gone:
            gone = keep_gone(_verified(_nearest_heads(sets, percent), rows, percent, one_each=True), "lines-gone")
        release(docs.sparkSession)

        with passing() as keep_found:
            found = keep_found(_verified(_all_pairs(sets, gone, percent), rows, percent), "lines-gone")
        release(docs.sparkSession)

        # Sets that lose a line: those that go, and those with more lines than their first.
        fallen = gone.unionByName(found).select(F.col("x").alias("number"), F.lit(True).alias("gone"))
        losing = settle(
            sets.select("number", "set_id", "n")
            .join(fallen, "number", "left")
            .filter("gone OR n > 1")
            .select("set_id", F.col("number").alias("first"), F.coalesce("gone", F.lit(False)).alias("gone")),
            "lines-losing",
        )
        number = F.col("number")
        place = number.bitwiseAND(F.lit((1 << LINE_BITS) - 1)).cast("int")
        lost = (
            lines.select("number", "set_id")
            .join(losing, "set_id")
            .filter(F.col("gone") | (number != F.col("first")))
            .groupBy(F.call_function("shiftright", number, F.lit(LINE_BITS)).alias("rank"))
            .agg(F.sort_array(F.collect_set(place)).alias("numbers"))
        )
        return keep(ranks.join(lost, "rank").select("doc_id", "th", "numbers"), "lines-found")


def _with_numbers(rows: DataFrame, found: DataFrame) -> DataFrame:
    """``rows`` (row, doc_id, text) with the ``numbers`` of the lines to go, NULL for none."""
    found = found.select(F.col("doc_id").alias("d"), F.col("th").alias("t"), "numbers")
    size = found.agg(F.count("*") + F.coalesce(F.sum(F.size("numbers")), F.lit(0))).first()[0]
    if size <= MAX_SENT_NUMBERS:
        # The texts stay in place; beyond the bound both sides are dealt by document.
        found = F.broadcast(found)
    return rows.join(found, F.col("doc_id").eqNullSafe(F.col("d")) & (F.xxhash64("text") == F.col("t")), "left")


def count_repeated(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """(doc_id, n_lines, n_removed, removed): ``removed`` lists the line numbers; texts stay in place."""
    own = docs.select(
        F.col(id_col).alias("doc_id"),
        F.xxhash64(text_col).alias("th"),
        F.coalesce(F.size(F.split(text_col, "\n")), F.lit(0)).alias("size"),
        F.col(text_col).isNull().alias("none"),
    )
    found = repeated_lines(docs, id_col, text_col, **options).select(
        F.col("doc_id").alias("d"), F.col("th").alias("t"), "numbers"
    )
    numbers = F.coalesce("numbers", F.array().cast("array<int>"))
    return own.join(found, F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("th") == F.col("t")), "left").select(
        "doc_id",
        F.when(F.col("none"), 0).otherwise(F.col("size")).cast("bigint").alias("n_lines"),
        F.size(numbers).cast("bigint").alias("n_removed"),
        numbers.alias("removed"),
    )


def remove_repeated(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """``docs`` with the later lines taken out of the text; all columns and rows stay."""
    rows = packed(docs, id_col, text_col)
    joined = _with_numbers(rows, repeated_lines(rows.select("doc_id", "text"), **options))
    kept = F.filter(F.split("text", "\n"), lambda line, i: ~F.array_contains("numbers", i))
    text = F.when(F.col("numbers").isNull(), F.col("text")).otherwise(F.array_join(kept, "\n"))
    return unpacked(joined, docs, **{text_col: text})

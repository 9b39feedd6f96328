"""A lexical index that uploads maintain and searches prune.

Three tables share their versions: ``documents`` (chunks with their terms, by document), ``postings`` (blocks
of entries, by base and term) and ``totals`` (by base).  A block holds a term's entries of one range of
chunk ordinals, with the greatest term frequency and the smallest chunk length among them.  An upload
replaces whole documents: it opens the blocks of their old and new terms, and writes the buckets these
lie in; everything else stays as it is.

A block's entries are (ordinal, dl, tf): what else a chunk has is found by its ordinal.  Postings are replaced
in ``PARTS`` groups of buckets, one after the other; each takes one exchange of the old blocks, the new
entries and the places of those that go, and one that deals the new blocks to their buckets.

A search bounds what any chunk of a range can score by the blocks' heads, scores the ranges of the highest
bounds, and then only those further ranges whose bound reaches the N-th best score.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from docquarry.functions import multiset, text
from docquarry.operators.index import LexicalIndex, weighted_vocabulary
from docquarry.params import Bm25Params
from docquarry.session import discard, ensure_checkpoint_dir, scratch_dir
from docquarry.sources.versions import Layout, Snapshot, VersionedTables

# Chunk ordinals of one block; a term's entries of one range are one row.
RANGE = 4_096
# Ranges that a question is scored on before its N-th best score is known.
FIRST_RANGES = 4

# Groups of buckets whose exchanges lie on disk one after the other.
PARTS = 4
# Rows of documents that change which may be sent to every task (about 40 bytes each).
MAX_SENT_DOCUMENTS = 1 << 20

_FACTS = ["kb_id", "doc_id", "chunk_id", "ordinal"]
_BLOCK = ["kb_id", "term", "range"]


def layouts(buckets: int = 256) -> dict[str, Layout]:
    return {
        "documents": Layout(("kb_id", "doc_id"), buckets),
        "postings": Layout(("kb_id", "term"), buckets),
        "totals": Layout(("kb_id",), 16),
    }


def _tables(spark: SparkSession, path: str, buckets: int) -> VersionedTables:
    return VersionedTables(spark, path, layouts(buckets))


def _counted(chunks: DataFrame) -> DataFrame:
    """Chunks with their length and the counts of their terms; a chunk without text has neither."""
    split = chunks.select(*_FACTS, text.tokens(F.col("text")).alias("__tokens"))
    counted = multiset.with_token_counts(split.withColumn("dl", F.size("__tokens")), F.col("__tokens"), "counts")
    return counted.select(*_FACTS, F.when(F.col("__tokens").isNotNull(), F.col("dl")).alias("dl"), "counts")


def _both(left: DataFrame | None, right: DataFrame) -> DataFrame:
    return right if left is None else left.unionByName(right)


def _range(ordinal: Column, width: int) -> Column:
    return F.floor(ordinal / F.lit(width)).alias("range")


def _blocks(old: DataFrame | None, added: DataFrame, gone: DataFrame, width: int) -> DataFrame:
    """The blocks of ``old`` with the entries ``added`` (kb_id, ordinal, dl, term, tf) and without those at ``gone``
    (kb_id, ordinal, term); ordinals are unique in a base, so a row has at most ``width`` entries."""
    entry, none = "struct<ordinal:bigint,dl:int,tf:bigint>", F.lit(None)
    key = ["kb_id", "term", _range(F.col("ordinal"), width)]
    rows = added.select(
        *key,
        none.cast(f"array<{entry}>").alias("held"),
        F.struct("ordinal", "dl", "tf").alias("new"),
        none.cast("bigint").alias("less"),
    ).unionByName(gone.select(*key, F.col("ordinal").alias("less")), allowMissingColumns=True)
    if old is not None:
        rows = rows.unionByName(old.select(*_BLOCK, F.col("entries").alias("held")), allowMissingColumns=True)
    # Rows move as they are; aggregated before, their buffers would take more space.
    met = rows.repartition(*_BLOCK).groupBy(*_BLOCK).agg(
        F.coalesce(F.first("held", ignorenulls=True), F.array().cast(f"array<{entry}>")).alias("held"),
        F.collect_list("new").alias("new"),
        F.collect_list("less").alias("less"),
    )
    left = F.when(F.size("less") == 0, F.col("held")).otherwise(
        F.filter("held", lambda e: ~F.array_contains(F.col("less"), e["ordinal"]))
    )
    return (
        met.filter(F.size("held") + F.size("new") > F.size("less"))
        .select(*_BLOCK, F.sort_array(F.concat(left, F.col("new"))).alias("entries"))
        .select(
            *_BLOCK,
            F.size("entries").cast("bigint").alias("n"),
            F.array_max(F.transform("entries", lambda e: e["tf"])).alias("max_tf"),
            F.array_min(F.transform("entries", lambda e: e["dl"])).alias("min_dl"),
            "entries",
        )
    )


def update(
    spark: SparkSession,
    path: str,
    chunks: DataFrame | None = None,
    removed: DataFrame | None = None,
    *,
    buckets: int = 256,
    width: int = RANGE,
    keep: int | None = None,
) -> None:
    """Replace the documents of ``chunks`` (kb_id, doc_id, chunk_id, ordinal, text) and drop ``removed`` (kb_id, doc_id).

    Chunks of a document that is indexed already take the place of its old ones.  The first call makes the
    index; ``buckets`` and ``width`` have to stay the same.  With ``keep``, versions that none of the last
    ``keep`` commits names are deleted; their readers must have ended.
    """
    tables = _tables(spark, path, buckets)
    before = tables.snapshot()
    folder = scratch_dir(spark, "lexical-update")

    def written(df: DataFrame, name: str) -> DataFrame:
        # As columns; a checkpoint of rows takes several times the space of the texts.
        df.write.option("compression", "zstd").parquet(f"{folder}/{name}")
        return spark.read.schema(df.schema).parquet(f"{folder}/{name}")

    empty = "kb_id string, doc_id string, chunk_id string, ordinal long, text string"
    fresh = written(_counted(chunks if chunks is not None else spark.createDataFrame([], empty)), "counted")
    changed = fresh.select("kb_id", "doc_id")
    if removed is not None:
        changed = changed.unionByName(removed.select("kb_id", "doc_id"))
    changed = written(changed.distinct(), "changed")
    documents = tables.layouts["documents"].touched(changed)
    terms = F.transform("counts", lambda c: c["term"]).alias("terms")
    added = fresh.select(*_FACTS, "dl", terms)
    held, gone = before.read("documents", documents), added.limit(0)
    if held is not None:
        some = F.broadcast(changed) if changed.count() <= MAX_SENT_DOCUMENTS else changed
        gone = written(held.join(some, ["kb_id", "doc_id"], "left_semi"), "gone")
        held = held.join(some, ["kb_id", "doc_id"], "left_anti")
    layout = tables.layouts["postings"]
    entries = fresh.select("kb_id", "ordinal", "dl", F.inline("counts"))
    places = gone.select("kb_id", "ordinal", F.explode("terms").alias("term"))
    postings = layout.touched(entries.select("kb_id", "term").unionByName(places.select("kb_id", "term")))

    def blocks() -> Iterator[DataFrame]:
        for part in range(min(PARTS, len(postings)) or 1):
            some = postings[part::PARTS]
            old = before.read("postings", some)
            yield _blocks(old, layout.of_buckets(entries, some), layout.of_buckets(places, some), width)

    sums = [F.sum(c).alias(c) for c in ("n", "counted", "total")]

    def counts(rows: DataFrame, sign: int) -> DataFrame:
        return rows.groupBy("kb_id").agg(
            (sign * F.count("*")).alias("n"),
            (sign * F.count("dl")).alias("counted"),
            (sign * F.coalesce(F.sum("dl"), F.lit(0))).alias("total"),
        )

    bases = tables.layouts["totals"].touched(changed)
    totals = _both(before.read("totals", bases), counts(added, 1)).unionByName(counts(gone, -1))
    tables.publish(
        0 if before.version is None else before.version + 1,
        {
            "documents": (iter([_both(held, added)]), documents),
            "postings": (blocks(), postings),
            "totals": (totals.groupBy("kb_id").agg(*sums).filter("n > 0"), bases),
        },
        before,
    )
    discard(folder)
    if keep is not None:
        tables.expire(keep)


def _empty(spark: SparkSession) -> dict[str, DataFrame]:
    entry = "array<struct<ordinal:long,dl:int,tf:long>>"
    return {
        "documents": spark.createDataFrame([], "kb_id string, doc_id string, chunk_id string, ordinal long, dl int, terms array<string>"),
        "postings": spark.createDataFrame([], f"kb_id string, term string, range long, n long, max_tf long, min_dl int, entries {entry}"),
        "totals": spark.createDataFrame([], "kb_id string, n long, counted long, total long"),
    }


def read(
    spark: SparkSession,
    path: str,
    questions: DataFrame | None = None,
    params: Bm25Params = Bm25Params(),
    *,
    buckets: int = 256,
) -> LexicalIndex:
    """The index last published.  With ``questions`` (kb_id, question), entries are read from the buckets of
    their terms only; term weights always come from the heads of all blocks."""
    tables = _tables(spark, path, buckets)
    now: Snapshot = tables.snapshot()
    wanted = None
    if questions is not None:
        asked = questions.select("kb_id", F.explode(text.tokens(F.col("question"))).alias("term"))
        wanted = tables.layouts["postings"].touched(asked)
    nothing = _empty(spark)

    def rows(table: str, some: list[int] | None = None) -> DataFrame:
        found = now.read(table, some)
        return nothing[table] if found is None else found

    blocks = rows("postings", wanted)
    stats = rows("totals").select("kb_id", "n", (F.col("total") / F.col("counted")).alias("avgdl"))
    vocabulary = rows("postings").groupBy("kb_id", "term").agg(F.sum("n").alias("df"))
    chunks = rows("documents").select(*_FACTS)
    return LexicalIndex(
        chunks=chunks,
        postings=blocks.select("kb_id", "term", F.inline("entries")).join(chunks, ["kb_id", "ordinal"]),
        terms=weighted_vocabulary(vocabulary, stats, params),
        stats=stats,
        blocks=blocks,
        vocabulary=vocabulary,
        params=params,
    )


def _gain(tf: str, dl: str, params: Bm25Params) -> Column:
    length = F.lit(1 - params.b) + F.lit(params.b) * F.col(dl) / F.col("avgdl")
    share = F.col(tf) * F.lit(params.k1 + 1) / (F.col(tf) + F.lit(params.k1) * length)
    return F.col("qtf") * F.col("idf") * share


def best_of_blocks(
    weighted: DataFrame, blocks: DataFrame, top_n: int, params: Bm25Params, digits: int
) -> DataFrame:
    """(query_id, kb_id, ordinal, score) of all chunks that may be among a question's best N.

    A chunk that is left out scores less than N others.  A term of negative weight can only lower a score, so
    it adds nothing to a bound.
    """
    ensure_checkpoint_dir(weighted.sparkSession)
    heads = blocks.select("kb_id", "term", "range", "max_tf", "min_dl").join(weighted, ["kb_id", "term"])
    bounds = heads.groupBy("query_id", "kb_id", "range").agg(
        F.sum(F.greatest(_gain("max_tf", "min_dl", params), F.lit(0.0))).alias("bound")
    )
    highest = Window.partitionBy("query_id").orderBy(F.desc("bound"), "range")
    first = bounds.withColumn("place", F.row_number().over(highest)).filter(F.col("place") <= FIRST_RANGES)
    first = first.select("query_id", "kb_id", "range").checkpoint()

    def scored(pairs: DataFrame) -> DataFrame:
        needed = pairs.select("query_id", "kb_id", "range").join(weighted, ["query_id", "kb_id"])
        return (
            blocks.select(*_BLOCK, "entries")
            .join(needed, _BLOCK)
            .select("query_id", "kb_id", "qtf", "idf", "avgdl", F.inline("entries"))
            .groupBy("query_id", "kb_id", "ordinal")
            .agg(F.round(F.sum(_gain("tf", "dl", params)), digits).alias("score"))
        )

    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "ordinal")

    def foremost(rows: DataFrame) -> DataFrame:
        return rows.withColumn("place", F.row_number().over(best)).filter(F.col("place") <= top_n)

    known = foremost(scored(first)).checkpoint()
    worst = known.filter(F.col("place") == top_n).select("query_id", F.col("score").alias("worst"))
    rest = (
        bounds.join(first, ["query_id", "kb_id", "range"], "left_anti")
        .join(worst, "query_id", "left")
        # The bound is a sum of doubles as well; equal scores may still win by their ordinal.
        .filter(F.col("worst").isNull() | (F.col("bound") * (1 + 1e-9) + 10.0**-digits >= F.col("worst")))
    )
    return known.unionByName(foremost(scored(rest))).drop("place")

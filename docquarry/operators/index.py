"""Lexical statistics and text vectors over all chunks of each knowledge base."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from hashlib import md5

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docquarry.functions import multiset, text
from docquarry.params import Bm25Params
from docquarry.session import ensure_checkpoint_dir


@dataclass(frozen=True)
class LexicalIndex:
    """chunks(kb_id, doc_id, chunk_id, ordinal),
    postings(kb_id, doc_id, chunk_id, ordinal, dl, term, tf),
    terms(kb_id, term, df, idf), stats(kb_id, n, avgdl); ``texts``: the chunks with
    their text, where the index was built from them and not read back; ``blocks``: the
    postings as blocks with heads, where it comes from a maintained store; ``vocabulary``:
    (kb_id, term, df) that ``terms`` would weigh by ``params``, where it is not saved."""

    chunks: DataFrame
    postings: DataFrame
    terms: DataFrame
    stats: DataFrame
    texts: DataFrame | None = None
    blocks: DataFrame | None = None
    vocabulary: DataFrame | None = None
    params: Bm25Params = Bm25Params()


def weighted_vocabulary(vocabulary: DataFrame, stats: DataFrame, params: Bm25Params) -> DataFrame:
    """(kb_id, term, df, idf) from (kb_id, term, df) and (kb_id, n)."""
    raw = vocabulary.join(stats.select("kb_id", "n"), "kb_id").withColumn(
        "raw_idf", F.log(F.col("n") - F.col("df") + 0.5) - F.log(F.col("df") + 0.5)
    )
    # Terms found in more than half of the chunks get a share of the mean.
    floor = raw.groupBy("kb_id").agg((F.avg("raw_idf") * params.epsilon).alias("__floor"))
    return raw.join(floor, "kb_id").select(
        "kb_id",
        "term",
        "df",
        F.when(F.col("raw_idf") < 0, F.col("__floor")).otherwise(F.col("raw_idf")).alias("idf"),
    )


def asked_weights(index: LexicalIndex, asked: DataFrame) -> DataFrame:
    """(kb_id, term, idf, avgdl) of the asked terms (kb_id, term), which are few enough for every task.

    The weights of :func:`weighted_vocabulary`, with one pass over the vocabulary: what is kept of it are the
    asked terms and, for the mean weight, the number of terms of each count.
    """
    ensure_checkpoint_dir(asked.sparkSession)
    wanted = asked.select("kb_id", "term", F.col("term").alias("asked")).distinct()
    counted = (
        index.vocabulary.join(F.broadcast(wanted), ["kb_id", "term"], "left")
        .groupBy("kb_id", "df", "asked")
        .agg(F.count("*").alias("terms"))
        .join(index.stats, "kb_id")
        .withColumn("raw_idf", F.log(F.col("n") - F.col("df") + 0.5) - F.log(F.col("df") + 0.5))
        .checkpoint()
    )
    mean = F.sum(F.col("raw_idf") * F.col("terms")) / F.sum("terms")
    floor = counted.groupBy("kb_id").agg((mean * index.params.epsilon).alias("__floor"))
    idf = F.when(F.col("raw_idf") < 0, F.col("__floor")).otherwise(F.col("raw_idf")).alias("idf")
    found = counted.filter(F.col("asked").isNotNull())
    return found.join(floor, "kb_id").select("kb_id", F.col("asked").alias("term"), idf, "avgdl")


def build_lexical_index(
    chunks: DataFrame, params: Bm25Params = Bm25Params(), *, clustered: bool = False
) -> LexicalIndex:
    """``chunks``: kb_id, doc_id, chunk_id, ordinal, text.

    Only whoever needs ``postings`` (a saved index, all scores, a scope) has the text
    partitioned by chunk: term counts are computed inside the row, and per-chunk
    sums reuse the partitioning.  Ranked search without a scope scores ``texts`` in place.
    Chunks are small, so no key can be hot.  Pass ``clustered`` when the table is already
    bucketed by chunk_id.
    """
    facts = ["kb_id", "doc_id", "chunk_id", "ordinal"]
    spread = chunks if clustered else chunks.repartition("chunk_id")
    split = spread.select(*facts, text.tokens(F.col("text")).alias("__tokens"))
    counted = multiset.with_token_counts(
        split.withColumn("dl", F.size("__tokens")), F.col("__tokens"), "__counts"
    )
    # The outer form keeps Catalyst from evaluating the counts twice, once to
    # test for emptiness below the exchange.
    postings = counted.select(*facts, "dl", F.inline_outer("__counts")).filter(
        F.col("term").isNotNull()
    )
    # Corpus statistics come straight from the scan, so the text is moved for
    # the postings only.
    scanned = chunks.select("kb_id", text.tokens(F.col("text")).alias("__tokens"))
    stats = scanned.groupBy("kb_id").agg(
        F.count("*").alias("n"), F.avg(F.size("__tokens")).alias("avgdl")
    )
    # Distinct tokens instead of postings: without lambdas in the plan, Spark
    # recognises a repeated exchange and computes it once.
    vocabulary = (
        scanned.select("kb_id", F.explode_outer(F.array_distinct("__tokens")).alias("term"))
        .filter(F.col("term").isNotNull())
        .groupBy("kb_id", "term")
        .agg(F.count("*").alias("df"))
    )
    terms = weighted_vocabulary(vocabulary, stats, params)
    return LexicalIndex(
        chunks.select(*facts),
        postings,
        terms,
        stats,
        chunks.select(*facts, "text"),
        vocabulary=vocabulary,
        params=params,
    )


def write_lexical_index(index: LexicalIndex, path: str) -> None:
    """Persist the index by knowledge base.

    The rebalance hint lets AQE split a dominant knowledge base over many
    writers instead of sending it to one.  With dynamic partition overwrite,
    only knowledge bases present in ``index`` are replaced.
    """
    for name in ("chunks", "postings", "terms", "stats"):
        frame: DataFrame = getattr(index, name)
        (
            frame.hint("rebalance", "kb_id")
            .write.mode("overwrite")
            .option("partitionOverwriteMode", "dynamic")
            .partitionBy("kb_id")
            .parquet(f"{path}/{name}")
        )


def read_lexical_index(spark, path: str) -> LexicalIndex:
    read = {n: spark.read.parquet(f"{path}/{n}") for n in ("chunks", "postings", "terms", "stats")}
    return LexicalIndex(**read)


Embedder = Callable[[pd.Series], np.ndarray]
# Texts of a batch that are shown to an embedder at once.
EMBED_ROWS = 256
# Places of terms that the default embedder keeps between its calls.
REMEMBERED_TERMS = 200_000


def hashed_terms(dimensions: int = 64) -> Embedder:
    """Deterministic default embedder: hashed term counts, L2-normalised."""

    numbers: dict[str, int] = {}

    def embed(texts: pd.Series) -> np.ndarray:
        out = np.zeros((len(texts), dimensions))
        for row, body in enumerate(texts):
            if len(numbers) > REMEMBERED_TERMS:
                numbers.clear()
            for token in body.split():
                at = numbers.get(token)
                if at is None:
                    at = numbers[token] = int(md5(token.encode()).hexdigest()[:7], 16) % dimensions
                out[row, at] += 1.0
        norms = np.sqrt((out**2).sum(axis=1, keepdims=True))
        return out / np.where(norms == 0, 1.0, norms)

    return embed


def embed_texts(
    rows: DataFrame,
    make_embedder: Callable[[], Embedder] = hashed_terms,
    *,
    body: str = "text",
    name: str = "embedding",
) -> DataFrame:
    """Vector column from a caller-supplied model, built once per Python worker batch stream.

    A NULL text has a NULL vector and is not shown to the model.
    """

    kind = pa.list_(pa.float32())

    @F.arrow_udf("array<float>")
    def vectors(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        embed = make_embedder()
        for batch in batches:
            parts = [pa.array([], kind)]
            for at in range(0, len(batch), EMBED_ROWS):
                texts = batch.slice(at, EMBED_ROWS).to_pylist()
                known = [row for row, body in enumerate(texts) if body is not None]
                found: list = [None] * len(texts)
                if known:
                    made = np.asarray(embed(pd.Series([texts[row] for row in known])), dtype=np.float32)
                    for row, vector in zip(known, made):
                        found[row] = vector
                parts.append(pa.array(found, kind))
            yield pa.concat_arrays(parts)

    return rows.withColumn(name, vectors(F.col(body)))

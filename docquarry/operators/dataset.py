"""Evaluation papers, questions and case selection."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docquarry.functions import digest, ordered

# The parallel arrays of a paper's questions.
QUESTION_FIELDS = (
    "question",
    "question_id",
    "nlp_background",
    "topic_background",
    "paper_read",
    "search_query",
    "question_writer",
    "answers",
)
MIN_QUESTIONS = 3


def eligible_papers(papers: DataFrame) -> DataFrame:
    """Papers with enough questions and at least one section."""
    return papers.filter(
        (F.size("qas.question") >= MIN_QUESTIONS) & (F.size("full_text.section_name") > 0)
    )


def sample_papers(papers: DataFrame, count: int, seed: int) -> DataFrame:
    """Seeded choice of ``count`` papers, the same whatever the partitioning."""
    shuffled = F.md5(F.concat(F.lit(f"{seed}|"), F.col("id")))
    return papers.orderBy(shuffled, "id").limit(count)


def flatten_questions(papers: DataFrame) -> DataFrame:
    """One row per question with its index; ``papers``: id, paper_ordinal, qas.

    Arrays that fall short are filled up with NULL; ``integrity.papers`` finds such papers.
    """
    zipped = F.arrays_zip(*[F.col(f"qas.{f}").alias(f) for f in QUESTION_FIELDS])
    flat = papers.select(
        F.col("id").alias("paper_id"),
        "paper_ordinal",
        F.posexplode(zipped).alias("question_index", "__q"),
    )
    return flat.select(
        "paper_id", "paper_ordinal", "question_index", *[F.col(f"__q.{f}").alias(f) for f in QUESTION_FIELDS]
    )


def number_cases(papers: DataFrame) -> DataFrame:
    """(id, paper_ordinal, question_count, first_case): dataset order of the cases.

    Running totals are kept in blocks of papers, never in one global window.
    """
    sized = papers.select(
        "id", "paper_ordinal", F.size("qas.question").alias("question_count"), F.lit(0).alias("__all")
    )
    return ordered.running_total(
        sized, ["__all"], "paper_ordinal", F.col("question_count"), "first_case"
    ).drop("__all")


def first_cases(
    cases: DataFrame, max_papers: int | None = None, max_questions: int | None = None
) -> DataFrame:
    """The first papers, then the first questions of those, in dataset order."""
    kept = cases if max_papers is None else cases.filter(F.col("paper_ordinal") < max_papers)
    return kept if max_questions is None else kept.orderBy("case_ordinal").limit(max_questions)


def cases_by_key(cases: DataFrame, wanted: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(selected cases, requested keys that do not exist)."""
    keys = ["paper_id", "question_id"]
    asked = wanted.select(*keys).distinct()
    return cases.join(asked, keys, "left_semi"), asked.join(cases.select(*keys), keys, "left_anti")


def below_threshold(cases: DataFrame, judged: DataFrame, threshold: float) -> DataFrame:
    """Cases whose deciding score is strictly below the threshold."""
    keys = ["paper_id", "question_id"]
    failed = judged.filter(F.col("semantic_score") < threshold).select(*keys, "semantic_score")
    return cases.join(failed, keys)


def ordered_key_digest(selected: DataFrame, *, block: int = 10_000) -> DataFrame:
    """Digest over the ordered case keys: the SHA-256 of the list of its blocks' digests.

    A block is the compact JSON list of ``block`` consecutive keys in case order, and its
    digest the SHA-256 of that, so no task holds the whole key list.  One rule holds for
    every size; an empty selection is the digest of the empty list.
    """
    key = F.concat(F.col("paper_id"), F.lit("/"), F.col("question_id"))
    ranked = ordered.dense_rank_along(
        selected.withColumn("__all", F.lit(0)), ["__all"], "case_ordinal", "__pos"
    ).withColumn("__blk", F.floor(F.col("__pos") / block))
    listed = ranked.groupBy("__blk").agg(
        F.count("*").alias("__n"),
        F.transform(
            F.array_sort(F.collect_list(F.struct("__pos", key.alias("k")))), lambda x: x["k"]
        ).alias("__keys"),
    )
    blocks = listed.select("__blk", "__n", digest.sha256_list(F.col("__keys")).alias("__d"))
    joined = F.transform(
        F.array_sort(F.collect_list(F.struct("__blk", "__d"))), lambda x: x["__d"]
    )
    return blocks.agg(
        F.coalesce(F.sum("__n"), F.lit(0)).cast("bigint").alias("selected_case_count"),
        digest.sha256_list(joined).alias("ordered_case_key_blocks_sha256"),
    )


def pending(cases: DataFrame, records: DataFrame) -> DataFrame:
    """Cases without a successful record."""
    keys = ["paper_id", "question_id"]
    done = records.filter(F.col("status") == "success").select(*keys).distinct()
    return cases.join(done, keys, "left_anti")


def record_counters(records: DataFrame) -> DataFrame:
    return records.agg(
        F.count("*").alias("answer_records"),
        F.count_if(F.col("status") == "success").alias("successful"),
        F.count_if(F.col("status") != "success").alias("failed"),
    )


def generation_status(pending_cases: DataFrame, counters: DataFrame, availability: DataFrame, log_rows: DataFrame) -> DataFrame:
    """One row with the run's status and what it rests on.

    ``availability``: (role, measure, n); ``log_rows``: application_log_records.
    """
    left = pending_cases.agg(F.count("*").alias("pending_cases"))
    unknown = availability.filter(F.col("measure") == "unknown").agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("unknown_diagnostics")
    )
    row = counters.join(left).join(unknown).join(log_rows)
    done = (
        (F.col("pending_cases") == 0)
        & (F.col("unknown_diagnostics") == 0)
        & (F.col("application_log_records") >= F.col("successful"))
    )
    return row.withColumn("run_status", F.when(done, "complete").otherwise("complete_with_errors"))

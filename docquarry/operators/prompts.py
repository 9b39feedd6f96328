"""Context and prompt columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

DEFAULT_TEMPLATE = (
    "Answer the question from the passages alone. If they do not hold the answer, "
    "say so.\n\nEarlier messages:\n{history}\n\nPassages:\n{context}\n\n"
    "Question:\n{question}\n\nAnswer:\n"
)


def contexts(sources: DataFrame, *, numbered: bool = False, name: str = "context") -> DataFrame:
    """Passages of each question in rank order, separated by an empty line.

    ``sources``: query_id, rank, passage - at most top-K rows per question.
    """
    shown = (
        F.concat(F.lit("[Context "), F.col("rank").cast("string"), F.lit("]\n"), F.col("passage"))
        if numbered
        else F.col("passage")
    )
    return sources.groupBy("query_id").agg(
        F.array_join(
            F.transform(
                F.array_sort(F.collect_list(F.struct(F.col("rank"), shown.alias("p")))),
                lambda x: x["p"],
            ),
            "\n\n",
        ).alias(name)
    )


def fill(template: str, **values: Column) -> Column:
    """Put columns into the {named} places of a template."""
    parts: list[Column] = []
    rest = template
    while rest:
        spots = {rest.find("{" + k + "}"): k for k in values if "{" + k + "}" in rest}
        if not spots:
            parts.append(F.lit(rest))
            break
        at = min(spots)
        if at:
            parts.append(F.lit(rest[:at]))
        key = spots[at]
        parts.append(F.coalesce(values[key], F.lit("")))
        rest = rest[at + len(key) + 2 :]
    return F.concat(*parts)


def prompts(
    questions: DataFrame,
    context: DataFrame,
    history: DataFrame | None = None,
    template: str = DEFAULT_TEMPLATE,
) -> DataFrame:
    """(query_id, prompt); a question without context or history gets blanks."""
    joined = questions.select("query_id", "question").join(context, "query_id", "left")
    if history is not None:
        joined = joined.join(history.select("query_id", "history"), "query_id", "left")
    else:
        joined = joined.withColumn("history", F.lit(""))
    return joined.select(
        "query_id",
        fill(
            template,
            history=F.col("history"),
            context=F.col("context"),
            question=F.col("question"),
        ).alias("prompt"),
    )

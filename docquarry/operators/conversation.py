"""Question numbers, history windows and answer decoration."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docquarry.functions import ordered, text

REWRITE_HISTORY = 4
ANSWER_HISTORY = 6

# How labels are shown below an answer.
RELEVANCE_DISPLAY = {"high": "High", "medium": "Medium", "low": "Low", "unknown": "Unknown"}
GROUNDEDNESS_DISPLAY = {
    "grounded": "Grounded",
    "partially_grounded": "Partially grounded",
    "not_grounded": "Not grounded",
    "unknown": "Unknown",
}
RELEVANCE_DISPLAY_FALLBACK = "Low"
GROUNDEDNESS_DISPLAY_FALLBACK = "Partially grounded"

# Fixed value: the error of an answer without substance.
EMPTY_ANSWER_ERROR = (
    "GenerationIntegrityError: The provider returned no substantive answer "
    "after diagnostic stripping."
)

# Why a provider response is not accepted as an answer.
NO_CHOICES = "The provider response did not contain a usable choices list."
CHOICE_COUNT = "The provider response must contain exactly one answer choice."
TRUNCATED = "The provider truncated the answer at the completion-token limit."
NO_CONTENT = "The provider returned no substantive answer content."


def question_numbers(turns: DataFrame) -> DataFrame:
    """User turns with their number in the conversation, from 1."""
    asked = (F.col("role") == "user").cast("int")
    numbered = ordered.running_total(turns, ["conv_id"], "turn", asked, "__before")
    return numbered.filter(F.col("role") == "user").select(
        "conv_id", "turn", (F.col("__before") + 1).alias("question_no")
    )


def _spoken() -> Column:
    return F.concat(F.initcap("role"), F.lit(": "), F.col("text"))


def rewrite_history(turns: DataFrame) -> DataFrame:
    """The last messages before each turn, one per line."""
    recent = ordered.recent_values(
        turns, ["conv_id"], "turn", _spoken(), REWRITE_HISTORY, "__recent"
    )
    return recent.select("conv_id", "turn", "role", F.array_join("__recent", "\n").alias("history"))


def answer_history(turns: DataFrame) -> DataFrame:
    """The last messages before each turn, every line closed by a newline."""
    recent = ordered.recent_values(
        turns, ["conv_id"], "turn", F.concat(_spoken(), F.lit("\n")), ANSWER_HISTORY, "__recent"
    )
    return recent.select("conv_id", "turn", "role", F.array_join("__recent", "").alias("history"))


def effective_question(rewritten: Column, question: Column) -> Column:
    """A failed or blank rewrite falls back to the question as asked."""
    clean = text.strip(rewritten)
    return F.when(clean != "", clean).otherwise(question)


def _shown(labels: dict[str, str], label: Column, fallback: str) -> Column:
    shown = F.lit(fallback)
    for key, display in labels.items():
        shown = F.when(label == key, display).otherwise(shown)
    return shown


def diagnostics_suffix(
    relevance: Column, groundedness: Column, kb_mode: Column, scope_mode: Column, names: Column
) -> Column:
    """The block shown below an answer; the scope line only for multi-document bases."""
    scope = F.when(
        scope_mode == "all",
        F.concat(F.lit("All indexed documents ("), F.size(names).cast("string"), F.lit(")")),
    ).otherwise(F.concat(F.lit("Selected documents ("), F.array_join(names, ", "), F.lit(")")))
    return F.concat(
        F.lit("\n\n---\n\n**Answer diagnostics**\n\n- **Retrieval relevance:** "),
        _shown(RELEVANCE_DISPLAY, relevance, RELEVANCE_DISPLAY_FALLBACK),
        F.lit("\n- **Groundedness:** "),
        _shown(GROUNDEDNESS_DISPLAY, groundedness, GROUNDEDNESS_DISPLAY_FALLBACK),
        F.when(kb_mode == "multi", F.concat(F.lit("\n- **Scope:** "), scope)).otherwise(F.lit("")),
    )


# Fixed value: a closing diagnostics block of the earlier or the present layout.
SUFFIX_PATTERN = r"""\r?\n\r?\n(?:Retrieval relevance: (?:(?:🟢 )?High|(?:🟡 )?Medium|(?:🔴 )?Low|(?:⚪ )?Unknown)[ \t]*\r?\nGroundedness: (?:(?:🟢 )?Grounded|(?:🟡 )?Partially grounded|(?:🔴 )?Not grounded|(?:⚪ )?Unknown)[ \t]*(?:\r?\n(?:📚 )?Scope: (?:all indexed documents \([0-9]+\)|selected documents \([^\r\n]+\)))?|---[ \t]*\r?\n\r?\n\*\*Answer diagnostics\*\*[ \t]*\r?\n\r?\n- \*\*Retrieval relevance:\*\* (?:High|Medium|Low|Unknown)[ \t]*\r?\n- \*\*Groundedness:\*\* (?:Grounded|Partially grounded|Not grounded|Unknown)[ \t]*(?:\r?\n- \*\*Scope:\*\* (?:All indexed documents \([0-9]+\)|Selected documents \([^\r\n]+\)))?)[ \t\r\n]*\z"""


def without_suffix(answer: Column) -> Column:
    """Answer text with a closing diagnostics block of either layout removed."""
    return F.regexp_replace(answer, SUFFIX_PATTERN, "")


def classify_answers(answers: DataFrame, raw: str = "raw_answer") -> DataFrame:
    """cleaned_answer, status and error of returned answers."""
    clean = answers.withColumn("cleaned_answer", without_suffix(F.col(raw)))
    blank = text.is_blank(F.col("cleaned_answer"))
    return clean.withColumn("status", F.when(blank, "error").otherwise("success")).withColumn(
        "error", F.when(blank, F.lit(EMPTY_ANSWER_ERROR))
    )


def answer_rejection(choice_count: Column, finish_reason: Column, content: Column) -> Column:
    """Why a provider response is refused; NULL when it is accepted."""
    cut_off = F.lower(text.strip(finish_reason)) == "length"
    return (
        F.when(choice_count.isNull(), NO_CHOICES)
        .when(choice_count != 1, CHOICE_COUNT)
        .when(cut_off, TRUNCATED)
        .when(text.is_blank(content), NO_CONTENT)
    )

"""Rule-based choice of the retrieval strategy and its fusion weight."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from docquarry.functions.text import WHITESPACE, strip, token_count

# Weight of the dense branch per route.
ROUTE_ALPHA = {"keyword": 0.45, "semantic": 0.80, "balanced": 0.65}

# First words that mark a question as semantic.
SEMANTIC_STARTERS = (
    "what",
    "why",
    "how",
    "summarize",
    "explain",
    "describe",
    "compare",
    "discuss",
    "tell",
    "outline",
)

SHORT_QUESTION_TOKENS = 4

# A digit in Python's sense: decimal digits plus super- and subscripts.
_DIGIT = r"[\p{Nd}\x{b2}\x{b3}\x{b9}\x{2070}\x{2074}-\x{2079}\x{2080}-\x{2089}]"
# A whole token of two or more characters, an upper-case letter, none in lower case.
_SHOUTED = (
    rf"(?:^|[{WHITESPACE}])(?=[^{WHITESPACE}]*\p{{Lu}})"
    rf"[^{WHITESPACE}\p{{Ll}}\p{{Lt}}]{{2,}}(?:[{WHITESPACE}]|\z)"
)


def keyword_signals(question: Column) -> Column:
    q = strip(question)
    signals = (
        token_count(q) <= SHORT_QUESTION_TOKENS,
        F.rlike(q, F.lit(_DIGIT)),
        F.rlike(q, F.lit(_SHOUTED)),
        F.rlike(q, F.lit("[\"']")),
    )
    return sum((s.cast("int") for s in signals[1:]), signals[0].cast("int"))


def starts_semantic(question: Column) -> Column:
    words = "|".join(SEMANTIC_STARTERS)
    return F.rlike(F.lower(strip(question)), F.lit(rf"^(?:{words})(?: |\z)"))


def route(question: Column, mode: Column | str = "auto") -> Column:
    """Route name; a recognised manual mode wins, anything else is automatic."""
    wanted = F.lower(strip(F.coalesce(mode if isinstance(mode, Column) else F.lit(mode), F.lit("auto"))))
    signals, semantic = keyword_signals(question), starts_semantic(question)
    automatic = (
        F.when((signals >= 2) & ~semantic, "keyword")
        .when(semantic & (signals == 0), "semantic")
        .otherwise("balanced")
    )
    return F.when(wanted.isin(*ROUTE_ALPHA), wanted).otherwise(automatic)


def alpha(route_name: Column) -> Column:
    choice = F.lit(ROUTE_ALPHA["balanced"])
    for name in ("keyword", "semantic"):
        choice = F.when(route_name == name, F.lit(ROUTE_ALPHA[name])).otherwise(choice)
    return choice

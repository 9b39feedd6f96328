"""Redaction and classification of error texts."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

from docquarry.functions.text import collapse_whitespace

# Fixed values: (pattern, replacement) of log explanations, applied in order.
LOG_SECRETS = (
    (r"(?iU)\bgsk_[A-Za-z0-9_-]+\b", "<redacted>"),
    (r"(?iU)\bBearer\s+\S+", "Bearer <redacted>"),
    (r"(?iU)\borg_[A-Za-z0-9_-]+\b", "<redacted-organization>"),
    (r"(?U)\b[\w.+-]+@[\w.-]+\.[A-Za-z]{2,}\b", "<redacted-email>"),
    (r"(?iU)https?://(?:console\.)?groq\.com/\S*", "<redacted-provider-url>"),
    (r"(?iU)\b[A-Z]:[\\/][^\r\n,;]+", "<redacted-path>"),
    (r"(?U)(?<!\w)/(?:home|Users|tmp)/[^\r\n,;]+", "<redacted-path>"),
)

# The same for one-line error messages.
ERROR_SECRETS = (
    (r"(?iU)[A-Z]:\\Users\\[^\\\s]+(?:\\[^\s,;]+)*", "<redacted-path>"),
    (r"(?iU)(?<![A-Za-z0-9])[A-Z]:[\\/][^\s,;]+", "<redacted-path>"),
    (r"(?iU)\bgsk_[A-Za-z0-9_-]+\b", "<redacted>"),
    (r"(?iU)\bBearer\s+\S+", "Bearer <redacted>"),
    (r"(?iU)\b(api[_-]?key|authorization|token)(\s*[:=]\s*)(\S+)", "$1$2<redacted>"),
)
ERROR_LIMIT = 1000

# Checker failure causes, in report order.
CAUSES = (
    "rate_limit_tpm",
    "rate_limit_tpd",
    "malformed_output",
    "timeout",
    "connection",
    "other_failure",
)
# What names each cause in a failure text, in lower case.
DAY_LIMIT_MARKS = ("tokens per day", "tpd")
MINUTE_LIMIT_MARKS = ("tokens per minute", "tpm")
TIMEOUT_MARKS = ("timeout", "timed out")
CONNECTION_MARKS = ("connection", "connect error")
_MALFORMED_MARKS = (
    "invalid context-score",
    "invalid context score",
    "malformed",
    "schema",
    "could not parse",
    "parse failure",
)


def _apply(value: Column, rules: Iterable[tuple[str, str]]) -> Column:
    for pattern, replacement in rules:
        value = F.regexp_replace(value, pattern, replacement)
    return value


def log_explanation(value: Column) -> Column:
    return _apply(value, LOG_SECRETS)


def error_message(value: Column, root: str | None = None) -> Column:
    """One line, private paths and secrets removed, at most 1000 characters."""
    line = collapse_whitespace(value)
    if root:
        for form in (root, root.replace("\\", "/")):
            line = F.replace(line, F.lit(form), F.lit("<repository_root>"))
    return F.substring(_apply(line, ERROR_SECRETS), 1, ERROR_LIMIT)


def _mentions(lowered: Column, *marks: str) -> Column:
    found = F.contains(lowered, F.lit(marks[0]))
    for mark in marks[1:]:
        found = found | F.contains(lowered, F.lit(mark))
    return found


def failure_cause(explanation: Column) -> Column:
    low = F.lower(F.coalesce(explanation, F.lit("")))
    limited = _mentions(low, "429")
    return (
        F.when(limited & _mentions(low, *DAY_LIMIT_MARKS), "rate_limit_tpd")
        .when(limited & _mentions(low, *MINUTE_LIMIT_MARKS), "rate_limit_tpm")
        .when(_mentions(low, *_MALFORMED_MARKS), "malformed_output")
        .when(_mentions(low, *TIMEOUT_MARKS), "timeout")
        .when(_mentions(low, *CONNECTION_MARKS), "connection")
        .otherwise("other_failure")
    )


def failure_summary(explanation: Column) -> Column:
    """Content-free sentence for a failed check."""
    cause = failure_cause(explanation)
    scores = (cause == "malformed_output") & _mentions(F.lower(explanation), "context-score")
    status = F.when(cause.startswith("rate_limit_"), " (HTTP 429)").otherwise("")
    return F.when(scores, "Checker returned invalid context-score count.").otherwise(
        F.concat(F.lit("Checker request failed: "), cause, status, F.lit("."))
    )


def mentions_any(value: Column, markers: Iterable[str]) -> Column:
    """Markers that occur in the text, ignoring case."""
    low = F.lower(value)
    return F.array_compact(
        F.array(*[F.when(F.contains(low, F.lit(m.lower())), F.lit(m)) for m in markers])
    )

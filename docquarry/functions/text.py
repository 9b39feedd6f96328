"""Text expressions. All of them stay in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed value: the characters Python's str.split()/str.strip() treat as
# whitespace, as the inside of a regular-expression character class.
WHITESPACE = (
    r"\t-\r\x{1c}-\x{20}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}"
    r"\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
)

# Fixed value: appended to shortened previews.
TRUNCATION_MARK = "... [truncated]"

# Fixed value: extensions that can be indexed.
SUPPORTED_EXTENSIONS = (".pdf", ".doc", ".docx")


# The same set as a character list, for trimming.
WHITESPACE_CHARACTERS = "".join(
    map(
        chr,
        [
            *range(0x09, 0x0E),
            *range(0x1C, 0x21),
            0x85,
            0xA0,
            0x1680,
            *range(0x2000, 0x200B),
            0x2028,
            0x2029,
            0x202F,
            0x205F,
            0x3000,
        ],
    )
)
# The same set in the form that java.util.regex matches fastest.
_WS_RUN = r"(?U)[\s\x{1c}-\x{1f}]+"


def strip(text: Column) -> Column:
    """Only the ends are looked at, however long the text."""
    return F.btrim(text, F.lit(WHITESPACE_CHARACTERS))


def is_blank(text: Column) -> Column:
    """True for NULL and for whitespace-only text."""
    return F.coalesce(strip(text) == "", F.lit(True))


def collapse_whitespace(text: Column) -> Column:
    return strip(F.regexp_replace(text, _WS_RUN, " "))


def normalise_newlines(text: Column) -> Column:
    """LF line ends, at most one empty line in a row, outer whitespace removed."""
    lf = F.lit("\n")
    unix = F.replace(F.replace(F.coalesce(text, F.lit("")), F.lit("\r\n"), lf), F.lit("\r"), lf)
    # The pattern runs only over texts that hold a longer run.
    short = F.when(
        F.contains(unix, F.lit("\n\n\n")), F.regexp_replace(unix, r"\n{3,}", "\n\n")
    ).otherwise(unix)
    return strip(short)


def tokens(text: Column) -> Column:
    """Case-sensitive whitespace tokens, punctuation kept."""
    return F.array_remove(F.split(text, _WS_RUN), "")


def preview(text: Column, limit: int) -> Column:
    text = F.coalesce(text, F.lit(""))
    short = F.substring(text, 1, limit)
    return F.when(F.length(text) <= limit, text).otherwise(
        F.concat(short, F.lit(TRUNCATION_MARK))
    )


def file_name(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/]*)\z", 1)


def file_extension(path: Column) -> Column:
    """Lower-case suffix with its dot; '' for dot files and names without one."""
    return F.lower(F.regexp_extract(F.coalesce(path, F.lit("")), r"[^/](\.[^./]+)\z", 1))


def is_supported_file(path: Column) -> Column:
    return file_extension(path).isin(*SUPPORTED_EXTENSIONS)


def structured_text(
    content: Column, source_name: Column, section: Column, page: Column, doc_type: Column
) -> Column:
    """Passage text with its labelled origin lines; absent parts are skipped."""
    named = F.when(source_name != "", F.concat(F.lit("Source: "), source_name))
    sectioned = F.when(section != "", F.concat(F.lit("Section: "), section))
    paged = F.when(page.isNotNull(), F.concat(F.lit("Page: "), page.cast("string")))
    typed = F.when(
        (doc_type != "") & (doc_type != "pdf"), F.concat(F.lit("Content Type: "), doc_type)
    )
    return strip(F.concat_ws("\n", named, sectioned, paged, typed, strip(content)))


def token_count(text: Column) -> Column:
    return F.size(tokens(text))

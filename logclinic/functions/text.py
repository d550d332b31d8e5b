"""Line, trimming and wording helpers built from native string and array functions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# --- fixed values -----------------------------------------------------------------------------------------
#: Line boundaries: CRLF or one of these characters; also the characters that count as blank.
LINE_BREAK = "\r\n|[\n\x0b\f\r\x1c\x1d\x1e\x85  ]"
BLANKS = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0            "
    "    　"
)
STACK_LINE_STARTS = ["\tat ", "    at ", "Traceback (most recent call last)", "Caused by:"]
UPPER_WORDS = ["oom", "sql", "api", "uri", "dns", "sas", "id", "pat", "dfs"]
# ----------------------------------------------------------------------------------------------------------


def strip(text: Column) -> Column:
    return F.btrim(text, F.lit(BLANKS))


def is_blank(text: Column) -> Column:
    return F.coalesce(strip(text), F.lit("")) == ""


def ends_line(text: Column) -> Column:
    return F.rlike(F.right(text, F.lit(1)), F.lit("^(?:" + LINE_BREAK + ")"))


def lines(text: Column) -> Column:
    """All lines of ``text`` in order; a final line break opens no further line and an empty text has none."""
    chopped = (
        F.when(F.endswith(text, F.lit("\r\n")), F.substring(text, F.lit(1), F.length(text) - 2))
        .when(ends_line(text), F.substring(text, F.lit(1), F.length(text) - 1))
        .otherwise(text)
    )
    return F.when(text != "", F.split(chopped, LINE_BREAK)).otherwise(F.array().cast("array<string>"))


def numbered_lines(text: Column) -> Column:
    """Array of (no, line) over the non-blank lines; numbers count blank lines too and lines are trimmed."""
    numbered = F.transform(
        lines(text), lambda x, i: F.struct((i + 1).cast("bigint").alias("no"), strip(x).alias("line"))
    )
    return F.filter(numbered, lambda s: s["line"] != "")


def first_line(all_lines: Column) -> Column:
    """First non-blank line, trimmed; null when there is none."""
    return F.get(F.filter(F.transform(all_lines, strip), lambda x: x != ""), F.lit(0))


def stack_lines(all_lines: Column) -> Column:
    """The stack-frame lines of a raw log joined by line feeds; null when there is none."""

    def is_frame(x: Column) -> Column:
        return reduce(lambda a, b: a | b, [F.startswith(x, F.lit(m)) for m in STACK_LINE_STARTS])

    joined = F.array_join(F.filter(all_lines, is_frame), "\n")
    return F.nullif(joined, F.lit(""))


def padded(text: Column, width: int) -> Column:
    """Blanks added up to the width; longer texts stay whole."""
    return F.concat(text, F.repeat(F.lit(" "), F.greatest(width - F.length(text), F.lit(0))))


def clamp(text: Column, limit: int) -> Column:
    """Cut to ``limit`` characters, the last three being dots when something was cut."""
    return F.when(F.length(text) > limit, F.concat(F.substring(text, 1, limit - 3), F.lit("..."))).otherwise(text)


def humanize(key: Column) -> Column:
    """``executor_oom`` -> ``Executor OOM``."""
    word = lambda w: F.when(w.isin(*UPPER_WORDS), F.upper(w)).otherwise(
        F.concat(F.upper(F.substring(w, 1, 1)), F.lower(F.substring(w, 2, 1 << 30)))
    )
    words = F.transform(F.filter(F.split(key, "_"), lambda w: w != ""), word)
    return F.when(F.size(words) == 0, key).otherwise(F.array_join(words, " "))


def first_excerpt(excerpt: Column) -> Column:
    """The cited line of an excerpt block, at most 160 characters."""
    return F.substring(strip(F.substring_index(excerpt, " | ", 1)), 1, 160)


def short_name(name: Column) -> Column:
    return F.substring_index(name, ".", -1)


def dotted_suffixes(names: Column) -> Column:
    """Distinct names plus everything that follows one of their dots."""

    def suffixes(name: Column) -> Column:
        parts = F.split(name, r"\.")
        return F.transform(
            F.sequence(F.lit(1), F.size(parts)),
            lambda i: F.array_join(F.slice(parts, i, F.size(parts)), "."),
        )

    return F.array_distinct(F.flatten(F.transform(names, suffixes)))

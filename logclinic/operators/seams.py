"""Signals across the cuts of a text: what a piece has to remember of itself so that any number of pieces can be joined.

Pieces are cut at line breaks, so a match can cross a cut only in white space between two words of a phrase or inside a
quoted name; all other wild cards stay in one line.  A match therefore reaches at most ``LINES`` non-blank lines into a
piece, apart from a quoted name, of any length, which holds no quotation mark.  The edge of a text keeps its first and
last such lines, extended over two quotation marks, and says by a barrier whether the part left out holds a quotation
mark.  Long stretches between quotation marks are left out in the same way.  Edges joined by a line break are a text
that shows exactly the signals of the joined texts across its cuts, and that text has an edge again.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logclinic.functions.signals import DRIVER_HINTS, SIGNALS, WHITE
from logclinic.functions.text import is_blank, strip

_ALL_PHRASES = [p for phrases in [*SIGNALS.values(), DRIVER_HINTS] for p in phrases]
#: More lines than any phrase has words.
LINES = max(p.count(" ") + p.count(r"\s*") for p in _ALL_PHRASES) + 1

QUOTE = "[`'\"]"
_NO_QUOTE = "[^`'\"]"
_SOLID = "[^" + WHITE[1:]
#: The first LINES non-blank lines, and all before the third quotation mark.
_FIRST_LINES = rf"(?U)^(?:{WHITE}*+{_SOLID}[^\n]*+(?:\n|\z)){{1,{LINES}}}"
_TWO_QUOTES = rf"^{_NO_QUOTE}*+(?:{QUOTE}{_NO_QUOTE}*+){{0,2}}"

#: Ends every match but a quoted name, and ends that too.  No pattern matches the control character by itself.
_OPEN, _SHUT = "\x01\n\x01", "\x01'\x01\n\x01'\x01"


def _words() -> list[str]:
    """Expressions for all words of phrases: what may stand next to white space inside a match."""
    found = set()
    for phrase in _ALL_PHRASES:
        for word in re.split(r"\[`[^\]]*\]\[\^[^\]]*\]\+\[`[^\]]*\]|\[\^\\n\][*+]|\\S\+|\\s\*|\\b|[ ()|]", phrase):
            if word := word.lstrip("?*").rstrip("*"):
                found.add(word)
    return sorted(found, key=lambda w: (-len(w), w))


def _near_ends(size: int) -> tuple[list[str], list[str]]:
    """First and last `size` characters of all words (whole words where they are shorter), lower case."""
    plain = set()
    for word in _words():
        word = word.replace("\\.", ".").replace("\\[", "[").replace("\\]", "]").lower()
        word = re.sub(r"\[_\\x20\]|\[-\\x20\]\??", "_", word)  # in the middle of a word
        forms = {word.replace("[sz]", "s"), word.replace("[sz]", "z")}
        plain |= {f for w in forms for f in ({w[:-1], w[:-2]} if w.endswith("?") else {w})}
    plain = {w for w in plain if "\\" not in w}  # the one word that is no text is a number
    return sorted({w[:size] for w in plain}), sorted({w[-size:] for w in plain})


_STARTS, _ENDS = _near_ends(3)
#: The words on both sides of a quoted name.
_BEFORE_NAME = ["column", "reference", "view", "resolve", "parameter"]
_AFTER_NAME = ["cannot", "in", "given", "is", "not", "does"]
#: Without one of these words no phrase with a wild line goes on (first list) or comes from before (second).
_WILD_BEFORE, _WILD_AFTER = ["view", "cannot"], ["found", "overflow", "partition"]
_NEAR = 200


def _any(text: Column, words: list[str]) -> Column:
    hit = F.contains(text, F.lit(words[0]))
    for word in words[1:]:
        hit = hit | F.contains(text, F.lit(word))
    return hit


def _any_part(text: Column, parts: list[str], cut) -> Column:
    """Does the text start (or end) with one of the parts, of one to three characters?"""
    hits = [cut(text, F.lit(n)).isin(*[p for p in parts if len(p) == n]) for n in (1, 2, 3)]
    return hits[0] | hits[1] | hits[2]


def may_come_in(text: Column, low: Column) -> Column:
    """Could a match reach into the text from before it?  True too often, never too seldom."""
    start = F.regexp_replace(F.substring(low, 1, _NEAR), f"(?U)^{WHITE}++", "")
    near = _any_part(start, _STARTS, F.left) | (start == "") | F.rlike(start, F.lit(rf"(?Ud)^(?:at\s|\d|{QUOTE}|[^\n]*\()"))
    named = F.rlike(text, F.lit(rf"(?iU)^{_NO_QUOTE}*+{QUOTE}{WHITE}*+(?:(?<={WHITE})(?:{'|'.join(_AFTER_NAME)})|\z)"))
    return near | named | _any(low, _WILD_AFTER)


def may_go_on(text: Column, backward: Column, low: Column) -> Column:
    """Could a match go on after the text?  True too often, never too seldom."""
    end = F.right(low, F.lit(3))
    near = _any_part(end, [*_ENDS, "at"], F.right) | F.rlike(end, F.lit(rf"(?U)(?:{QUOTE}|{WHITE}|\d)\z"))
    before = "|".join(w[::-1] for w in _BEFORE_NAME)
    named = F.rlike(backward, F.lit(rf"(?iU)^{_NO_QUOTE}*+{QUOTE}{WHITE}*+(?:{before}|\z)"))
    return near | named | _any(low, _WILD_BEFORE)


def _squeezed(text: Column) -> Column:
    """Blank lines in a row count as one."""
    return F.regexp_replace(text, rf"(?U)\n{WHITE}*\n", "\n\n")


def _first_lines(text: Column) -> Column:
    return F.regexp_extract(text, _FIRST_LINES, 0)


def _shortened(text: Column) -> Column:
    """Long stretches between quotation marks reduced to their first and last lines."""

    def shorten(run: Column) -> Column:
        first, last = _first_lines(run), F.reverse(_first_lines(F.reverse(run)))
        long = (F.length(first) > 0) & (F.length(first) < F.length(run)) & (F.length(first) + F.length(last) < F.length(run))
        return F.when(long, F.concat(first, F.lit(_OPEN), last)).otherwise(run)

    return _squeezed(F.array_join(F.transform(F.split(text, QUOTE), shorten), "'"))


def with_edge(rows: DataFrame, text: str, gated: bool) -> DataFrame:
    """Adds ``edge`` of the column ``text``; gated: a side that no match can cross is left out (needs a column ``low``)."""
    whole = F.col(text)
    rows = rows.withColumn("_back", F.reverse(whole))
    if gated:
        rows = rows.withColumns({"_in": F.when(may_come_in(whole, F.col("low")), whole), "_on": F.when(may_go_on(whole, F.col("_back"), F.col("low")), F.col("_back"))})
    else:
        rows = rows.withColumns({"_in": whole, "_on": F.col("_back")})
    parts = {}
    for side in ("_in", "_on"):
        parts |= {f"{side}_l": _first_lines(F.col(side)), f"{side}_q": F.regexp_extract(side, _TWO_QUOTES, 0)}
    rows = rows.withColumns(parts)
    longer = lambda side: F.coalesce(F.when(F.length(f"{side}_q") >= F.length(f"{side}_l"), F.col(f"{side}_q")).otherwise(F.col(f"{side}_l")), F.lit(""))
    rows = rows.withColumns({"_head": longer("_in"), "_tail": F.reverse(longer("_on"))})
    rows = rows.withColumn("_left_out", F.length(whole) - F.length("_head") - F.length("_tail"))
    middle = F.substr(whole, F.length("_head") + 1, F.col("_left_out"))
    barrier = F.when(F.rlike(middle, F.lit(QUOTE)), F.lit(_SHUT)).otherwise(F.lit(_OPEN))
    one_line = ~F.contains(strip(whole), F.lit("\n"))
    edge = (
        F.when(is_blank(whole), _squeezed(whole))
        .when(one_line, whole)
        .when(F.col("_left_out") <= 0, _shortened(whole))
        .otherwise(F.concat(_shortened(F.col("_head")), barrier, _shortened(F.col("_tail"))))
    )
    return rows.withColumn("edge", edge).drop("_back", "_in", "_on", *parts, "_head", "_tail", "_left_out")

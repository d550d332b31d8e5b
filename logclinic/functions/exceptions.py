"""Exception class names found in text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from logclinic.functions.text import short_name

# --- fixed value: a dotted identifier whose last part ends in one of three suffixes --------------------------
NAME_PATTERN = r"\b([A-Za-z_]\w*(?:\.[A-Za-z_]\w*)*(?:Exception|Error|Failure))\b"
SUFFIXES = ["Exception", "Error", "Failure"]
# ----------------------------------------------------------------------------------------------------------


def with_short(names: Column) -> Column:
    """Each name followed by its last part, duplicates removed in order."""
    return F.array_distinct(F.flatten(F.transform(names, lambda n: F.array(n, short_name(n)))))


#: A whole run of word characters and dots that holds a suffix; only classes repeat, which does not recurse in the JVM.
RUN_PATTERN = r"(?U)(?<![\w.])[\w.]*?(?:Exception|Error|Failure)[\w.]*+"


def _names(run: Column) -> Column:
    """The names in a run, as the pattern of the fixed value finds them.

    Parts that no identifier starts cut the run; of each stretch, all up to the last part with a suffix is one name.
    """
    legal = F.transform(F.split(run, r"\."), lambda p: F.when(F.rlike(p, F.lit("^[A-Za-z_]")), p).otherwise(""))
    stretches = F.split(F.regexp_replace(F.array_join(legal, "."), r"^\.+|\.+$", ""), r"\.\.+")

    def name(stretch: Column) -> Column:
        parts = F.split(stretch, r"\.")
        ends = F.transform(parts, lambda p, i: F.when(F.rlike(p, F.lit(r".(?:Exception|Error|Failure)$")), i + 1))
        return F.array_join(F.slice(parts, F.lit(1), F.coalesce(F.array_max(ends), F.lit(0))), ".")

    return F.filter(F.transform(stretches, name), lambda n: n != "")


def exception_types(text: Column) -> Column:
    """Names in order of first appearance, full form before short form."""
    suspicious = F.contains(text, F.lit(SUFFIXES[0]))
    for suffix in SUFFIXES[1:]:
        suspicious = suspicious | F.contains(text, F.lit(suffix))
    found = with_short(F.flatten(F.transform(F.regexp_extract_all(text, F.lit(RUN_PATTERN), F.lit(0)), _names)))
    return F.when(suspicious, found).otherwise(F.array().cast("array<string>"))

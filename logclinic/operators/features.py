"""Everything a pooled text says about its source, computed in one narrow pass over the text.

After this step the text is gone: what travels on is a few hundred bytes per source.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logclinic.functions import signals as S
from logclinic.functions.exceptions import exception_types, with_short
from logclinic.functions.platforms import MARKERS, UNKNOWN, detect_platform
from logclinic.functions.redaction import redact
from logclinic.functions.text import LINE_BREAK, clamp, dotted_suffixes, numbered_lines
from logclinic.operators.fence import fenced
from logclinic.operators.pooling import PIECE_BYTES, pool
from logclinic.operators.seams import with_edge
from logclinic.rules.base import RuleBase

EXCERPT_CHARS = 200
#: Start of the pooled text kept for short citations.
HEAD_CHARS = 200
#: Fine buckets whose facts are merged before those of their source, as a power of two: 67 million positions.
MERGE_BITS = 10


def _shown(line: Column) -> Column:
    """Redacted line, cut where no excerpt can still show it."""
    return F.substring(redact(line), 1, EXCERPT_CHARS + 1)


def _neighbourhood(lines: Column, at: Column) -> list[Column]:
    """Number and text of the line at 1-based position ``at``, of the one before and of the one after."""

    def parts(index: Column, prefix: str) -> list[Column]:
        item = F.when(index >= 0, F.get(lines, index))
        return [item["no"].alias(prefix + "no"), _shown(item["line"]).alias(prefix + "line")]

    return parts(at - 1, "") + parts(at - 2, "prev_") + parts(at, "next_")


def excerpt_block(cite: Column) -> Column:
    """Cited line, line before, line after (non-blank ones), joined and clamped."""

    def numbered(prefix: str) -> Column:
        return F.concat(F.lit("line "), cite[prefix + "no"].cast("string"), F.lit(": "), cite[prefix + "line"])

    return clamp(F.concat_ws(" | ", numbered(""), numbered("prev_"), numbered("next_")), EXCERPT_CHARS)


def signal_cites(lines: str, mask: str) -> Column:
    """Line and neighbours for each present signal that some single line shows; first such line."""
    cited = F.filter(S.first_lines(lines, mask), lambda c: c["at"] > 0)
    return F.transform(cited, lambda c: F.struct(*_neighbourhood(F.col(lines), c["at"]), c["signal"].alias("name")))


def exception_cites(lines: Column, names: Column) -> Column:
    """Line and neighbours per name: first line outside stack frames naming it, else first line at all."""

    def cite(name: Column) -> Column:
        named = F.transform(lines, lambda x: F.contains(x["line"], name))
        outside = F.transform(lines, lambda x: F.contains(x["line"], name) & ~F.startswith(x["line"], F.lit("at ")))
        first = F.array_position(outside, F.lit(True))
        at = F.when(first > 0, first).otherwise(F.array_position(named, F.lit(True)))
        return F.struct((first == 0).alias("in_frame"), at.cast("int").alias("at"), name.alias("name"))

    cited = F.filter(F.transform(names, cite), lambda c: c["at"] > 0)
    return F.transform(
        cited,
        lambda c: F.struct(c["in_frame"].alias("in_frame"), *_neighbourhood(lines, c["at"]), c["name"].alias("name")),
    )


def excerpt_text() -> Column:
    """Text whose lines are cited: the raw text if there is any, else the pooled text."""
    return F.coalesce("payload_text", "text")


def scan_text(pooled: DataFrame, rules: RuleBase, pieces: bool = False) -> DataFrame:
    """Facts per pooled row: signal bits, platform, exception names and cited lines; of a piece also its edges.

    A declared exception that a piece mentions is cited even if only another piece names it; ``_whole`` decides.
    """
    declared = F.array(*[F.lit(n) for n in rules.declared_exceptions]).cast("array<string>")
    names = F.filter(declared, lambda n: F.contains("text", n)) if pieces else F.array_intersect("exception_keys", declared)
    lines = F.transform(numbered_lines(excerpt_text()), lambda x: F.struct(x["no"], x["line"], S.folded(x["line"]).alias("low")))
    if not pieces:
        # only pieces need the lines of a text that has nothing to cite
        lines = F.when((F.col("mask") != 0) | (F.size("exception_keys") > 0), lines)
    scanned = (
        pooled.withColumn("low", S.folded(F.col("text")))
        .withColumn("mask", S.signal_mask())
        .withColumn("text_platform", detect_platform(F.lower("text")))
        .withColumn("text_exceptions", exception_types(F.col("text")))
        .withColumns(_names_seen())
        .withColumn("lines", lines)
        .withColumn("signal_cites", signal_cites("lines", "mask"))
        .withColumn("exception_cites", exception_cites(F.col("lines"), names))
        .withColumn("head", F.substring("text", 1, HEAD_CHARS))
    )
    if pieces:
        scanned = with_edge(scanned, "text", gated=True).withColumns(
            {"first_line": _edge_line(F.lit(0)), "last_line": _edge_line(F.size("lines") - 1), "n_lines": _line_count(), "raw": F.col("payload_text").isNotNull()}
        )
    return scanned.drop("low", "lines")


def _names_seen() -> dict[str, Column]:
    """Columns that follow from the exception names in events and text."""
    observed = F.array_distinct(F.concat(with_short(F.col("event_error_types")), "text_exceptions"))
    return {"first_exception": F.get("text_exceptions", F.lit(0)), "observed": observed, "exception_keys": dotted_suffixes(observed)}


def _line_count() -> Column:
    """Lines the cited text takes up once the next piece follows on a new line; none if there is no text."""
    text = excerpt_text()
    return F.when(text == "", 0).otherwise(F.size(F.split(F.concat(text, F.lit("\n")), LINE_BREAK)) - 1)


def _edge_line(index: Column) -> Column:
    item = F.when(index >= 0, F.get("lines", index))
    return F.when(item.isNotNull(), F.struct(item["no"].alias("no"), _shown(item["line"]).alias("line")))


FEATURE_COLUMNS = [
    "source", "n_events", "mask", "text_platform", "event_platform", "text_exceptions", "first_exception",
    "event_error_types", "observed", "exception_keys", "has_stack", "has_metadata", "signal_cites", "exception_cites", "head",
]
SOURCE_COLUMNS = [
    "source", "n_events", "platform", "signals", "error_types", "first_exception", "observed", "exception_keys",
    "has_stack", "has_metadata", "signal_cites", "exception_cites", "head",
]
PIECE_COLUMNS = [
    "n_events", "mask", "text_platform", "event_platform", "text_exceptions", "event_error_types", "has_stack", "has_metadata", "head", "edge", "raw",
    "n_lines", "first_line", "last_line", "signal_cites", "exception_cites",
]


def finish(facts: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """Derived columns shared by whole and rejoined sources."""
    return fenced(
        facts.withColumn("signals", S.mask_signals())
        .withColumn(
            "platform",
            F.when(F.col("text_platform") != UNKNOWN, F.col("text_platform")).otherwise(
                F.coalesce("event_platform", F.lit(UNKNOWN))
            ),
        )
        .withColumn("error_types", F.array_sort(F.array_union("event_error_types", "text_exceptions")))
        .withColumn("has_stack", F.col("has_stack") | F.array_contains("signals", "stacktrace_present"))
        .select(*SOURCE_COLUMNS, *keep)
    )


def _moved(line: Column, start: Column) -> Column:
    return F.when(line.isNotNull(), F.struct((line["no"] + start).alias("no"), line["line"].alias("line")))


def _ordered_union(column: str) -> Column:
    """Distinct values of an array column of all pieces, in the order of the pieces."""
    return F.array_distinct(F.flatten(F.transform("pieces", lambda p: p[column])))


def _first_marked() -> Column:
    """Platform of highest priority found in any piece."""
    order = F.array(*[F.lit(p) for p in [*MARKERS, UNKNOWN]])
    return F.get(order, (F.array_min(F.transform("pieces", lambda p: F.array_position(order, p["text_platform"]))) - 1).cast("int"))


def _cite(c: Column, flags: list[str], number: Column, before: Column | None, after: Column | None, start: Column) -> Column:
    """A cited line moved by ``start`` lines; neighbours it lacks are taken from outside its piece."""
    prev = (c["prev_no"] + start, c["prev_line"]) if before is None else (F.coalesce(c["prev_no"] + start, before["no"]), F.coalesce(c["prev_line"], before["line"]))
    following = (c["next_no"] + start, c["next_line"]) if after is None else (F.coalesce(c["next_no"] + start, after["no"]), F.coalesce(c["next_line"], after["line"]))
    return F.struct(
        *[c[f].alias(f) for f in flags], number.alias("no"), c["line"].alias("line"), prev[0].alias("prev_no"), prev[1].alias("prev_line"),
        following[0].alias("next_no"), following[1].alias("next_line"), c["name"].alias("name"),
    )


def _joined_cites(left: Column, right: Column, column: str, after: Column) -> Column:
    """First citation per name of two neighbouring pieces; one in a stack frame gives way to one outside."""
    flags = ["in_frame"] if column == "exception_cites" else []
    old = F.transform(left[column], lambda c: _cite(c, flags, c["no"], None, after, F.lit(0).cast("bigint")))
    new = F.transform(right[column], lambda c: _cite(c, flags, c["no"] + left["n_lines"], left["last_line"], None, left["n_lines"]))
    if flags:
        old = F.filter(old, lambda c: ~(c["in_frame"] & F.exists(right[column], lambda d: (d["name"] == c["name"]) & ~d["in_frame"])))
        known = lambda d: F.exists(left[column], lambda c: (c["name"] == d["name"]) & (~c["in_frame"] | d["in_frame"]))
    else:
        known = lambda d: F.exists(left[column], lambda c: c["name"] == d["name"])
    return F.concat(old, F.filter(new, lambda d: ~known(d)))


def _joined_lines() -> Column:
    """Lines and citations of all pieces in their order; where any piece has raw text, only raw text is cited."""
    raw = F.exists("pieces", lambda p: p["raw"])

    def lines_of(p: Column) -> Column:
        cited = p["raw"] | ~raw
        none = lambda c: F.when(cited, p[c]).otherwise(F.filter(p[c], lambda _: F.lit(False))).alias(c)
        return F.struct(
            F.when(cited, p["n_lines"].cast("bigint")).otherwise(0).alias("n_lines"), F.when(cited, p["first_line"]).alias("first_line"),
            F.when(cited, p["last_line"]).alias("last_line"), none("signal_cites"), none("exception_cites"),
        )

    def join(left: Column, right: Column) -> Column:
        after = _moved(right["first_line"], left["n_lines"])
        return F.struct(
            (left["n_lines"] + right["n_lines"]).alias("n_lines"), F.coalesce(left["first_line"], after).alias("first_line"),
            F.coalesce(_moved(right["last_line"], left["n_lines"]), left["last_line"]).alias("last_line"),
            *[_joined_cites(left, right, c, after).alias(c) for c in ("signal_cites", "exception_cites")],
        )

    shown = F.transform("pieces", lines_of)
    return F.aggregate(F.slice(shown, F.lit(2), F.size("pieces")), F.get(shown, F.lit(0)), join)


def _merged(facts: DataFrame, *keys: str | Column) -> DataFrame:
    """Facts of neighbouring pieces as facts of one: (keys, place, PIECE_COLUMNS).

    ``place`` orders pieces and stays the place of the first.  Signals across cuts are searched in the joined edges.
    """
    several = F.size("pieces") > 1
    first_known = lambda c: F.get(F.filter(F.transform("pieces", lambda p: p[c]), lambda x: x.isNotNull()), F.lit(0))
    filled = lambda c: F.filter(F.transform("pieces", lambda p: p[c]), lambda x: x != "")
    any_of = lambda c: F.exists("pieces", lambda p: p[c])
    names = [k if isinstance(k, str) else "block" for k in keys]
    merged = (
        facts.groupBy(*keys)
        .agg(F.array_sort(F.collect_list(F.struct("place", *PIECE_COLUMNS)), lambda a, b: _compared(a["place"], b["place"])).alias("pieces"))
        .withColumn("joined", F.when(several, F.array_join(filled("edge"), "\n")))
        .withColumn("low", S.folded(F.col("joined")))
        .withColumn("seam_mask", S.signal_mask("joined"))
        .withColumn("lines", _joined_lines())
    )
    merged = with_edge(merged, "joined", gated=False)
    one = F.get("pieces", F.lit(0))
    masks = F.aggregate("pieces", F.col("seam_mask"), lambda held, p: held.bitwiseOR(p["mask"]))
    return merged.select(
        *names, one["place"].alias("place"),
        F.aggregate("pieces", F.lit(0).cast("bigint"), lambda held, p: held + p["n_events"]).alias("n_events"), masks.alias("mask"), _first_marked().alias("text_platform"),
        first_known("event_platform").alias("event_platform"), _ordered_union("text_exceptions").alias("text_exceptions"),
        F.array_sort(_ordered_union("event_error_types")).alias("event_error_types"), any_of("has_stack").alias("has_stack"), any_of("has_metadata").alias("has_metadata"),
        F.substring(F.array_join(filled("head"), "\n"), 1, HEAD_CHARS).alias("head"), F.when(several, F.col("edge")).otherwise(one["edge"]).alias("edge"), any_of("raw").alias("raw"),
        "lines.n_lines", "lines.first_line", "lines.last_line", "lines.signal_cites", "lines.exception_cites",
    )


def _compared(a: Column, b: Column) -> Column:
    return F.when(a < b, -1).when(a > b, 1).otherwise(0)


def _whole(merged: DataFrame) -> DataFrame:
    """Facts of a source from those of all its pieces."""
    named = merged.withColumns(_names_seen())
    return named.withColumn("exception_cites", F.filter("exception_cites", lambda c: F.array_contains("exception_keys", c["name"])))


def source_features(events: DataFrame, rules: RuleBase, piece_bytes: int = PIECE_BYTES) -> DataFrame:
    """One row of facts per source of an event table.

    Texts travel once, to their pieces.  The pieces' facts are merged in order by a tree: neighbours first, so that the
    heaviest source is merged by many tasks, then what is left of each source.  Every source takes this path.
    """
    scanned = scan_text(pool(events, piece_bytes), rules, pieces=True)
    facts = fenced(scanned.select("source", "fine", F.struct("fine", "part").alias("place"), *PIECE_COLUMNS))
    merged = _merged(facts, "source", F.shiftright("place.fine", MERGE_BITS).alias("block"))
    return finish(_whole(_merged(merged, "source")).select(FEATURE_COLUMNS))


def text_features(pooled: DataFrame, rules: RuleBase, keep: tuple[str, ...] = ()) -> DataFrame:
    """One row of facts per pooled source that is known to be whole; the columns ``keep`` go along."""
    return finish(scan_text(pooled, rules).select(*FEATURE_COLUMNS, *keep), keep)



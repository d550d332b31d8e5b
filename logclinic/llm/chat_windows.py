"""Conversations as training windows of a token budget, cut between turns, with a mask of what the loss covers.

Prefix sums of the turns' tokens choose the spans: a window takes new turns while they fit, at least one.  In front of
them it repeats the conversation's system turn, if the first turn is one, and the last turns before the span, as far as
HISTORY_TURNS and HISTORY_TOKENS allow and the budget has room.  The loss covers the texts of new assistant turns, so
each once; repeated turns are masked.  Only a window whose own single turn is too long exceeds the budget.

The template marks turns by control strings.  Where a text holds one, or one that was escaped, a backslash after its
first character is added; taking one away restores the text.  A turn is encoded by itself, so tokens add up.

Conversations longer than SEGMENT_BYTES are cut into segments, also by prefix sums: segments are formatted by different
tasks, each knowing the system turn and the history before it.  A span ends where its segment ends.  Short ones are
one segment.  A task streams its rows and holds a block of them at a time.

Turns ascend (null first; rows of one turn by role, then text); equal rows are turns of their own.  Null texts and roles
count as empty; a null conversation id is an id; an empty table gives no windows; other columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logclinic.llm.blocks import blocks
from logclinic.llm.positions import positioned
from logclinic.llm.staging import prepare, staged
from logclinic.llm.tokens import per_text, tokenizer_of

BUDGET = 1024
HISTORY_TURNS = 2
HISTORY_TOKENS = 256
SEGMENT_BYTES = 1 << 20

#: What stands before and after a turn's text; other roles are named between [ROLE] and [:].
MARKS = {"system": ("<<SYS>>", "<</SYS>>"), "user": ("[INST]", "[/INST]"), "assistant": ("<s>", "</s>")}
OTHER = ("[ROLE]", "[:]", "[/ROLE]")
#: The shortest marks of a turn, in bytes.
LEAST_MARKS = 7
#: A control string: its first character, the backslashes of its escapes, and (ahead) the rest.
CONTROL = r"([<\[])(\\*)(?=</?SYS>>|/?INST\]|/?ROLE\]|:\]|/?s>)"
ESCAPED = CONTROL.replace(r"(\\*)", r"\\(\\*)")
TURN = re.compile(r"<<SYS>>(.*?)<</SYS>>|\[INST\](.*?)\[/INST\]|<s>(.*?)</s>|\[ROLE\](.*?)\[:\](.*?)\[/ROLE\]", re.S)
UNESCAPE = re.compile(ESCAPED)

WINDOWS = "conv_id long, segment long, window int, n_tokens long, n_repeated int, text string, loss array<struct<start:int,end:int>>"
DIGESTS = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"

#: Rows of a segment: the system turn again, turns that may be history, its own turns.
SYSTEM, HISTORY, NEW = 0, 1, 2


def escaped(text: Column) -> Column:
    return F.regexp_replace(text, F.lit(CONTROL), F.lit(r"$1\\$2"))


def unescaped(text: str) -> str:
    return UNESCAPE.sub(r"\1\2", text)


def rendered(role: Column, text: Column) -> Column:
    """A turn in the template."""
    form = F.concat(F.lit(OTHER[0]), escaped(role), F.lit(OTHER[1]), escaped(text), F.lit(OTHER[2]))
    for name, (before, after) in MARKS.items():
        form = F.when(role == name, F.concat(F.lit(before), escaped(text), F.lit(after))).otherwise(form)
    return form


def turns_of(text: str) -> list[tuple[str, str]]:
    """Role and text of every turn of a formatted window."""
    found = []
    for m in TURN.finditer(text):
        own = m.lastindex
        found.append((unescaped(m[4]), unescaped(m[5])) if own == 5 else (list(MARKS)[own - 1], unescaped(m[own])))
    return found


def _rows(turns: DataFrame) -> DataFrame:
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return turns.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"), text.alias("text"))


def segmented(turns: DataFrame, segment_bytes: int, history_bytes: int) -> tuple[DataFrame, DataFrame]:
    """The rows of short and of long conversations, each with segment and kind; conversations are short or long as a whole."""
    rows = _rows(turns)
    weight = (F.octet_length("text") + LEAST_MARKS).cast("long")
    # narrow tables, written so that their sizes are known: broadcast if small, else joined by shuffling
    long_ones = staged(rows.groupBy("conv_id").agg(F.sum(weight).alias("bytes")).filter(F.col("bytes") > segment_bytes).select(F.col("conv_id").alias("long_id")), "long-conversations")
    is_long = F.col("conv_id").eqNullSafe(F.col("long_id"))
    short = rows.join(long_ones, is_long, "left_anti").withColumns({"segment": F.lit(0).cast("long"), "kind": F.lit(NEW)})

    own = rows.join(long_ones, is_long, "left_semi")
    summed = own.groupBy("conv_id", "turn").agg(F.sum(weight).alias("bytes"))
    places = positioned(summed, [F.col("conv_id").asc_nulls_first(), F.col("turn").asc_nulls_first()], ["bytes"], "turns")
    starts = places.groupBy(F.col("conv_id").alias("start_id")).agg(F.min("bytes_before").alias("start"))
    before = F.col("bytes_before") - F.col("start")
    segment = F.floor(before / segment_bytes).cast("long")
    places = places.join(starts, F.col("conv_id").eqNullSafe(F.col("start_id"))).select(
        F.col("conv_id").alias("at_id"), F.col("turn").alias("at_turn"), segment.alias("segment"), (before == 0).alias("first"),
        ((segment + 1) * segment_bytes - before <= history_bytes).alias("feeds"),
    )
    places = staged(places, "segments")
    at = own.join(places, F.col("conv_id").eqNullSafe(F.col("at_id")) & F.col("turn").eqNullSafe(F.col("at_turn")))
    columns = ["conv_id", "turn", "role", "text", "segment", "kind"]
    heads = at.filter("first").groupBy("conv_id").agg(F.min(F.struct("role", "text", "turn")).alias("head")).filter("head.role = 'system'")
    later = places.filter("segment > 0").select("at_id", "segment").distinct()
    systems = heads.join(later, F.col("conv_id").eqNullSafe(F.col("at_id"))).select("conv_id", "head.turn", "head.role", "head.text", "segment", F.lit(SYSTEM).alias("kind"))
    new = at.withColumn("kind", F.lit(NEW)).select(*columns)
    history = at.filter("feeds").withColumns({"segment": F.col("segment") + 1, "kind": F.lit(HISTORY)}).select(*columns)
    return short, new.unionByName(history).unionByName(systems)


def _windows(rows: DataFrame, path: str, budget: int, history_turns: int, history_tokens: int) -> DataFrame:
    """The windows of segmented rows; a segment's windows follow each other in one partition."""

    def format_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = tokenizer_of(path)
        found: list[tuple] = []
        held = None  # the open segment: its key, system turn, history, number of windows and turns not yet in a window

        def history_for(state: dict, own: int) -> list:
            """The last turns that fit before a turn of `own` tokens."""
            room = min(history_tokens, budget - own - (state["system"][1] if state["system"] else 0))
            kept: list = []
            for turn in reversed(state["history"]):
                room -= turn[1]
                if room < 0:
                    break
                kept.insert(0, turn)
            return kept

        def close(state: dict, repeated: list, new: list) -> None:
            at, parts, loss = 0, [], []
            for k, (text, _, target) in enumerate([*repeated, *new]):
                if target and k >= len(repeated):
                    loss.append({"start": at + len(MARKS["assistant"][0]), "end": at + len(text) - len(MARKS["assistant"][1])})
                parts.append(text)
                at += len(text)
            found.append((*state["key"], state["windows"], sum(t[1] for t in repeated) + sum(t[1] for t in new), len(repeated), "".join(parts), loss))

        def advance(state: dict, turns: list[tuple[str, int, bool]], ended: bool) -> list:
            """Closes windows; the last one stays open while the segment may go on."""
            sums = np.cumsum([0, *(t[1] for t in turns)])
            start = 0
            while start < len(turns):
                repeated = ([state["system"]] if state["system"] else []) + history_for(state, turns[start][1])
                room = budget - sum(t[1] for t in repeated)
                end = max(start + 1, int(np.searchsorted(sums, sums[start] + room, "right")) - 1)
                if end >= len(turns) and not ended:
                    break
                close(state, repeated, turns[start:end])
                if state["opens"] and turns[start][0].startswith(MARKS["system"][0]):
                    state["system"] = turns[start]
                state["opens"] = False
                own = [t for t in turns[max(start, end - history_turns) : end] if t is not state["system"]]
                state["history"] = (state["history"] + own)[-history_turns:] if history_turns else []
                state["windows"] += 1
                start = end
            return turns[start:]

        def batch() -> pa.RecordBatch:
            names = [x.split(" ")[0] for x in WINDOWS.split(", ")]
            kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.string(), pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))]
            columns = [pa.array([row[k] for row in found], kind) for k, kind in enumerate(kinds)]
            found.clear()
            return pa.RecordBatch.from_arrays(columns, names)

        for block in blocks(batches):
            codes, n_units, units = tokenizer.units(block.column("text"))
            tokens = per_text(tokenizer.ids(units)[1][codes], n_units).tolist()
            columns = [block.column(name).to_pylist() for name in ("conv_id", "segment", "kind", "text", "target")]
            for (conv_id, segment, kind, text, target), n in zip(zip(*columns, strict=True), tokens, strict=True):
                if held is None or held["key"] != (conv_id, segment):
                    if held is not None:
                        advance(held, held["turns"], True)
                    held = {"key": (conv_id, segment), "opens": segment == 0, "system": None, "history": [], "windows": 0, "turns": []}
                turn = (text, n, target)
                if kind == SYSTEM:
                    held["system"] = turn
                elif kind == HISTORY:
                    if held["system"] is None or turn[0] != held["system"][0]:
                        held["history"] = [*held["history"], turn][-history_turns:] if history_turns else []
                else:
                    held["turns"].append(turn)
            if held is not None:
                held["turns"] = advance(held, held["turns"], False)
            yield batch()
        if held is not None:
            advance(held, held["turns"], True)
            yield batch()

    prepare(rows.sparkSession)
    together = rows.repartition("conv_id", "segment").sortWithinPartitions("conv_id", "segment", "kind", "turn", "role", "text")
    shown = together.select("conv_id", "segment", "kind", rendered(F.col("role"), F.col("text")).alias("text"), (F.col("role") == "assistant").alias("target"))
    return shown.mapInArrow(format_rows, WINDOWS)


def _parts(turns: DataFrame, path: str, budget: int, history_turns: int, history_tokens: int, segment_bytes: int) -> list[DataFrame]:
    longest = int(tokenizer_of(path).id_bytes.max())
    if segment_bytes <= longest * history_tokens:
        raise ValueError(f"segments of {segment_bytes} bytes may be shorter than {history_tokens} tokens of history")
    return [_windows(rows, path, budget, history_turns, history_tokens) for rows in segmented(turns, segment_bytes, longest * history_tokens)]


def format_windows(
    turns: DataFrame, path: str, budget: int = BUDGET, history_turns: int = HISTORY_TURNS, history_tokens: int = HISTORY_TOKENS, segment_bytes: int = SEGMENT_BYTES
) -> DataFrame:
    """conv_id, segment, window (in it), n_tokens, n_repeated (turns in front), text, loss (code points, end exclusive)."""
    short, long = _parts(turns, path, budget, history_turns, history_tokens, segment_bytes)
    return short.unionByName(long)


def read_back(windows: DataFrame) -> DataFrame:
    """conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars, from windows in order inside partitions.

    Digests are taken while the windows of a conversation stream by; nothing of it is held.
    """

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [x.split(" ")[0] for x in DIGESTS.split(", ")]
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
        held, found = None, []

        def done() -> None:
            found.append((held["id"], held["turns"], held["all"].hexdigest(), held["loss_chars"], held["loss"].hexdigest(), held["chars"]))

        for batch in batches:
            columns = [batch.column(name).to_pylist() for name in ("conv_id", "n_repeated", "text", "loss")]
            for conv_id, n_repeated, text, loss in zip(*columns, strict=True):
                if held is None or held["id"] != conv_id:
                    if held is not None:
                        done()
                    held = {"id": conv_id, "turns": 0, "all": sha256(), "loss": sha256(), "loss_chars": 0, "chars": 0}
                own = turns_of(text)[n_repeated:]
                held["turns"] += len(own)
                for role, said in own:
                    held["all"].update(f"{role}\n{said}\n".encode())
                for span in loss:
                    said = unescaped(text[span["start"] : span["end"]])
                    held["loss_chars"] += len(said)
                    held["loss"].update(said.encode())
                held["chars"] += len(text)
            yield pa.RecordBatch.from_arrays([pa.array([row[k] for row in found], kind) for k, kind in enumerate(kinds)], names)
            found.clear()
        if held is not None:
            done()
            yield pa.RecordBatch.from_arrays([pa.array([row[k] for row in found], kind) for k, kind in enumerate(kinds)], names)

    return windows.mapInArrow(read, DIGESTS)


def read_back_all(
    turns: DataFrame, path: str, budget: int = BUDGET, history_turns: int = HISTORY_TURNS, history_tokens: int = HISTORY_TOKENS, segment_bytes: int = SEGMENT_BYTES
) -> DataFrame:
    """Windows formatted and read back.  Those of a short conversation lie together; only long ones are brought together."""
    short, long = _parts(turns, path, budget, history_turns, history_tokens, segment_bytes)
    return read_back(short).unionByName(read_back(long.repartition("conv_id").sortWithinPartitions("conv_id", "segment", "window")))

"""Benchmark decontamination by pigeonhole edit matching.

An item of m characters may differ by k = m // 20 edits.  Cut into k + 1 pieces, one of them must occur unchanged; an
automaton finds all pieces of all items in one pass over a text, and Myers' bit-parallel distance verifies the text around
each hit.  Items and texts are compared in lower case with white space collapsed.

Items travel to the tasks in blocks of bounded size; a larger benchmark means more passes, never a larger broadcast.
Texts stay where they are: nothing is shuffled, so no hot document or source can arise.

Items shorter than `LEAST_CHARS` must occur unchanged, as whole words; null and blank items occur nowhere; equal items are
all reported.  Null and empty texts hold nothing.  Rows with equal ids are searched one by one; other columns are ignored, empty tables give no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logclinic.llm.blocks import blocks
from logclinic.llm.staging import prepare

EDITS_PER = 20
#: Shorter items allow no edit: almost any text is within an edit or two of a part of another one.
LEAST_CHARS = 24
#: Characters of benchmark items that one pass over the texts searches.
BLOCK_CHARS = 4 << 20


def normal(text: str) -> str:
    return " ".join(text.lower().split())


def edits_of(item: str) -> int:
    return len(item) // EDITS_PER if len(item) >= LEAST_CHARS else 0


def pieces_of(item: str) -> list[tuple[int, str]]:
    """Start and text of one piece more than the edits allowed."""
    n = edits_of(item) + 1
    cuts = [k * len(item) // n for k in range(n + 1)]
    return [(a, item[a:b]) for a, b in zip(cuts, cuts[1:], strict=False)]


def is_whole(text: str, begin: int, end: int) -> bool:
    """Whether the part neither begins nor ends inside a word."""
    cut = [at for at in (begin, end) if 0 < at < len(text) and text[at - 1].isalnum() and text[at].isalnum()]
    return not cut


def letter_masks(item: str) -> dict[str, int]:
    masks: dict[str, int] = {}
    for k, c in enumerate(item):
        masks[c] = masks.get(c, 0) | 1 << k
    return masks


def myers(masks: dict[str, int], m: int, text: str) -> tuple[int, int]:
    """The smallest edit distance of the pattern to any part of the text, and where the first such part ends."""
    full, high = (1 << m) - 1, 1 << (m - 1)
    plus, minus, score, best, end = full, 0, m, m, 0
    for at, c in enumerate(text, 1):
        equal = masks.get(c, 0)
        vertical = equal | minus
        horizontal = (((equal & plus) + plus) ^ plus) | equal
        up = minus | (full & ~(horizontal | plus))
        down = plus & horizontal
        if up & high:
            score += 1
        elif down & high:
            score -= 1
        up, down = up << 1 & full, down << 1 & full
        plus = down | (full & ~(vertical | up))
        minus = up & vertical
        if score < best:
            best, end = score, at
    return best, end


class Matcher:
    """Finds items in texts."""

    def __init__(self, items: list[tuple[int, str]]):
        self.items = [(name, own, letter_masks(own)) for name, own in items]
        self.automaton = ahocorasick.Automaton()
        places: dict[str, list[tuple[int, int]]] = {}
        for k, (_, own, _) in enumerate(self.items):
            for start, piece in pieces_of(own):
                places.setdefault(piece, []).append((k, start))
        for piece, where in places.items():
            self.automaton.add_word(piece, (len(piece), where))
        self.automaton.make_automaton()

    def matches(self, text: str) -> Iterator[tuple[int, int, int]]:
        """item, distance and end (in the normal form of the text) of the best place of each item that occurs."""
        if not self.items:
            return
        own = normal(text)
        hits: dict[int, set[int]] = {}
        for last, (length, where) in self.automaton.iter(own):
            for k, start in where:
                hits.setdefault(k, set()).add(last + 1 - length - start)
        for k, begins in hits.items():
            name, item, masks = self.items[k]
            if len(item) < LEAST_CHARS:
                ends = [begin + len(item) for begin in begins if is_whole(own, begin, begin + len(item))]
                if ends:
                    yield name, 0, min(ends)
                continue
            allowed = edits_of(item)
            best = None
            low = high = None
            for begin in [*sorted(begins), None]:
                # places that begin within the allowed shift of each other lie in one stretch of text
                if low is not None and (begin is None or begin > high + 2 * allowed + 1):
                    a = max(0, low - allowed)
                    distance, end = myers(masks, len(item), own[a : high + len(item) + allowed])
                    if distance <= allowed and (best is None or distance < best[0]):
                        best = (distance, a + end)
                    low = None
                low, high = (begin, begin) if low is None else (low, begin)
            if best:
                yield name, *best


def item_blocks(benchmark: DataFrame, item_id: str, text: str) -> Iterator[list[tuple[int, str]]]:
    """Items in normal form, as many together as fit a block."""
    held, size = [], 0
    for row in benchmark.select(F.col(item_id).alias("item_id"), F.col(text).alias("text")).filter("text IS NOT NULL").toLocalIterator():
        own = normal(row["text"])
        if not own:
            continue
        if held and size + len(own) > BLOCK_CHARS:
            yield held
            held, size = [], 0
        held.append((row["item_id"], own))
        size += len(own)
    yield held


def find_leaks(docs: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """doc_id, item_id, distance, end of each item that a document holds, at its best place."""
    prepare(docs.sparkSession)
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))

    def search(items):
        def found(batches):
            matcher = Matcher(items)
            for block in blocks(batches):
                ids, texts = block.column("doc_id").to_pylist(), block.column("text").to_pylist()
                hits = [(d, *m) for d, t in zip(ids, texts, strict=True) if t for m in matcher.matches(t)]
                if hits:
                    yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*hits, strict=True)], ["doc_id", "item_id", "distance", "end"])

        return found

    schema = "doc_id long, item_id long, distance long, end long"
    return reduce(DataFrame.unionAll, [rows.mapInArrow(search(items), schema) for items in item_blocks(benchmark, item_id, item_text)])


def without_leaks(docs: DataFrame, benchmark: DataFrame, text: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """The rows of documents that hold no item, with all their columns."""
    prepare(docs.sparkSession)

    def clean(items):
        def kept(batches):
            matcher = Matcher(items)
            for block in blocks(batches):
                clear = [not t or next(matcher.matches(t), None) is None for t in block.column(text).to_pylist()]
                yield block.filter(pa.array(clear, pa.bool_()))

        return kept

    for items in item_blocks(benchmark, item_id, item_text):
        docs = docs.mapInArrow(clean(items), docs.schema)
    return docs

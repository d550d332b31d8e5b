"""Substring dedup by super-k-mer partitioning, with words as letters.

A window is a run of 13 words.  The minimiser of a window is the smallest hash among its runs of two words, so equal
windows have equal minimisers, and neighbouring windows mostly share one: they travel together as one packed string (a
super-k-mer) to the bucket of their minimiser.  Sorting the windows of a bucket by hash, and comparing neighbours word by
word, finds every window's first document exactly.

A block of texts resolves its own repeats before anything travels and sends each distinct window once, from its first
document there.  However many copies a passage has, a bucket gets it at most once per block.  A bucket keeps its strings
compressed and takes them shelf by shelf, dropping what is settled, so it never sorts much at once.

Null and empty texts have no words.  A null id counts as greater than all ids.  Rows with equal ids never remove each
other's words; equal rows give equal results.  Other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logclinic.llm.blocks import BLOCK_BYTES, blocks, coded, hashes_of, list_array, ranges, rolled, starts_of, words_of
from logclinic.llm.packs import packed, unpacked
from logclinic.llm.staging import prepare, shuffle_partitions
from logclinic.llm.tokens import per_text

WINDOW = 13
MINIMISER = 2
NULL_ID = (1 << 63) - 1
#: Words that a bucket sorts together, and the shelves (by minimiser) it can be taken apart by.
SLAB_WORDS = 1 << 20
SHELVES = 256

SENT = "bucket int, payload binary, doc_id long, text_hash long, starts array<int>"
MARKS = "doc_id long, text_hash long, starts array<int>"


def sliding_min(values: np.ndarray, width: int) -> np.ndarray:
    """The smallest of each run of `width` neighbours."""
    done, out = 1, values
    while done < width:
        step = min(done, width - done)
        out = np.minimum(out[: len(out) - step], out[step:])
        done += step
    return out


def equal_windows(codes: np.ndarray, hashes: np.ndarray, starts: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Places in `starts` of windows that occur more than once, equal ones side by side in their order; and where each group begins.

    `hashes`: of the window that starts at each word.
    """
    of_start = hashes[starts]
    order = np.argsort(of_start, kind="stable")
    ordered = of_start[order]
    new = np.concatenate([[True], ordered[1:] != ordered[:-1]])[: len(ordered)]
    several = ~(new & np.concatenate([new[1:], [True]])[: len(new)])
    order, new = order[several], new[several]
    if not len(order):
        return order, new
    at = starts[order]
    same = np.ones(len(at) - 1, bool)
    for j in range(width):
        same &= codes[at[1:] + j] == codes[at[:-1] + j]
    if not (same == ~new[1:]).all():  # different windows with one hash: sort these by their words
        words = [codes[at + j] for j in reversed(range(width))]
        again = np.lexsort((order, *words))
        order, at = order[again], at[again]
        new = np.concatenate([[True], np.zeros(len(at) - 1, bool)])
        for j in range(width):
            new[1:] |= codes[at[1:] + j] != codes[at[:-1] + j]
    return order, new


def _grouped(docs: np.ndarray, text_hashes: np.ndarray, starts: np.ndarray) -> pa.RecordBatch | None:
    """Marked starts as one row per document."""
    if not len(docs):
        return None
    order = np.lexsort((starts, text_hashes, docs))
    docs, text_hashes, starts = docs[order], text_hashes[order], starts[order]
    new = np.concatenate([[True], (docs[1:] != docs[:-1]) | (text_hashes[1:] != text_hashes[:-1])])
    heads = np.flatnonzero(new)
    counts = np.diff(np.append(heads, len(docs)))
    return pa.RecordBatch.from_arrays([pa.array(docs[heads]), pa.array(text_hashes[heads]), list_array(starts.astype(np.int32), counts, pa.int32())], ["doc_id", "text_hash", "starts"])


def _send(width: int, minimiser: int, n_buckets: int):
    def send(batches):
        for block in blocks(batches):
            block = block.take(pa.array(np.argsort(block.column("doc_id").to_numpy(zero_copy_only=False), kind="stable")))
            ids, text_hashes = (block.column(x).to_numpy(zero_copy_only=False) for x in ("doc_id", "text_hash"))
            words, counts = words_of(block.column("text"))
            starts, rows = starts_of(counts, width)
            if not len(starts):
                continue
            codes, distinct = coded(words)
            hashes = hashes_of(distinct)[codes]
            heads = np.cumsum(counts) - counts
            # places in starts: equal windows side by side, texts in the order of their ids
            places, new = equal_windows(codes, rolled(hashes, width), starts, width)
            group = np.cumsum(new) - 1
            first_doc = ids[rows[places[new]]]
            later = ids[rows[places]] > first_doc[group] if len(places) else np.zeros(0, bool)
            sent = np.ones(len(starts), bool)
            sent[places[later]] = False
            again = np.concatenate([[False], (~new[1:]) & (rows[places[1:]] == rows[places[:-1]])])[: len(places)]
            sent[places[again]] = False  # once per text: its other places are found again in the text
            if later.any():
                marked = places[later]
                marks = _grouped(ids[rows[marked]], text_hashes[rows[marked]], starts[marked] - heads[rows[marked]])
                bucket = pa.array((marks.column("doc_id").to_numpy() % n_buckets).astype(np.int32))
                yield pa.RecordBatch.from_arrays([bucket, pa.nulls(marks.num_rows, pa.binary()), *marks.columns], ["bucket", "payload", "doc_id", "text_hash", "starts"])
            smallest = sliding_min(rolled(hashes, minimiser), width - minimiser + 1)[starts]
            yield from _super_kmers(words, ids, text_hashes, heads, starts[sent], rows[sent], smallest[sent])

    def _super_kmers(words, ids, text_hashes, heads, starts, rows, smallest):
        if not len(starts):
            return
        new = np.concatenate([[True], (np.diff(starts) != 1) | (np.diff(rows) != 0) | (smallest[1:] != smallest[:-1])])
        first = np.flatnonzero(new)
        n_windows = np.diff(np.append(first, len(starts)))
        spread = (smallest[first] * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(32)
        bucket = (spread * np.uint64(n_buckets)) >> np.uint64(32)
        shelf = ((spread * np.uint64(n_buckets)) & np.uint64(0xFFFFFFFF)) * np.uint64(SHELVES) >> np.uint64(32)
        place = (bucket * np.uint64(SHELVES) + shelf).astype(np.int64)
        order = np.argsort(place, kind="stable")
        borders = np.searchsorted(place[order], np.arange(n_buckets + 1) * SHELVES)
        spaced = pc.binary_join_element_wise(words, pa.scalar("", words.type), pa.scalar(" ", words.type))
        names, blobs, n_words, size = [], [], [], 0
        for b in range(n_buckets):
            own = order[borders[b] : borders[b + 1]]
            if not len(own):
                continue
            at, length = starts[first[own]], n_windows[own] + width - 1
            row = rows[first[own]]
            on_shelf = np.bincount(place[own] - b * SHELVES, minlength=SHELVES).astype(np.uint32)
            texts, text_of = np.unique(row, return_inverse=True)
            taken = spaced.take(pa.array(ranges(at, length)))
            n_letters = per_text(pc.binary_length(taken).to_numpy(zero_copy_only=False).astype(np.int64), length).astype(np.uint32)
            letters = np.frombuffer(taken.buffers()[2], np.uint8)[: int(n_letters.sum())]
            names.append(b)
            n_words.append(int(length.sum()))
            blobs.append(packed(on_shelf, ids[texts], text_hashes[texts], text_of.astype(np.uint32), (at - heads[row]).astype(np.uint32), n_windows[own].astype(np.uint32), n_letters, letters))
            size += len(blobs[-1])
            if size > 4 << 20:
                yield _blobs(names, blobs, n_words)
                names, blobs, n_words, size = [], [], [], 0
        if names:
            yield _blobs(names, blobs, n_words)

    def _blobs(names, blobs, n_words):
        none = pa.nulls(len(names), pa.int64())
        return pa.RecordBatch.from_arrays([pa.array(names, pa.int32()), pa.array(blobs, pa.binary()), none, none, list_array(np.array(n_words, np.int32), np.ones(len(names), np.int64), pa.int32())], ["bucket", "payload", "doc_id", "text_hash", "starts"])

    return send


class _Strings:
    """Super-k-mers of a bucket: words, and for each string its document, place and number of windows."""

    def __init__(self, words, ids, text_hashes, at, n_windows):
        self.words, self.ids, self.text_hashes, self.at, self.n_windows = words, ids, text_hashes, at, n_windows

    @classmethod
    def read(cls, blob: bytes, shelves: slice) -> _Strings | None:
        """The strings on some shelves of a packed blob."""
        on_shelf, ids, text_hashes, text_of, at, n_windows, n_letters, letters = unpacked(blob)
        ends = np.cumsum(on_shelf, dtype=np.int64)
        own = slice(ends[shelves.start] - on_shelf[shelves.start], ends[shelves.stop - 1])
        if own.start == own.stop:
            return None
        after = np.cumsum(n_letters, dtype=np.int64)
        text = letters[after[own.start] - n_letters[own.start] : after[own.stop - 1]]
        one = pa.LargeStringArray.from_buffers(1, pa.py_buffer(np.array([0, len(text) - 1])), pa.py_buffer(np.ascontiguousarray(text)))
        words = pc.split_pattern(one, " ").flatten()
        return cls(words, ids[text_of[own]], text_hashes[text_of[own]], at[own].astype(np.int64), n_windows[own].astype(np.int64))

    @classmethod
    def joined(cls, parts: list[_Strings]) -> _Strings:
        if len(parts) == 1:
            return parts[0]
        return cls(pa.concat_arrays([p.words for p in parts]), *(np.concatenate([getattr(p, x) for p in parts]) for x in ("ids", "text_hashes", "at", "n_windows")))

    def resolved(self, width: int) -> tuple[pa.RecordBatch | None, _Strings]:
        """Marks of windows that a document with a smaller id has here too, and the strings that still hold a first window."""
        lengths = self.n_windows + width - 1
        heads = np.cumsum(lengths) - lengths
        starts = ranges(heads, self.n_windows)
        string = np.repeat(np.arange(len(heads)), self.n_windows)
        codes, distinct = coded(self.words)
        hashes = rolled(hashes_of(distinct)[codes], width)
        places, new = equal_windows(codes, hashes, starts, width)
        if not len(places):
            return None, self
        docs = self.ids[string[places]]
        smallest = np.minimum.reduceat(docs, np.flatnonzero(new))
        later = docs > smallest[np.cumsum(new) - 1]
        marked = places[later]
        own = string[marked]
        marks = _grouped(self.ids[own], self.text_hashes[own], self.at[own] + starts[marked] - heads[own])
        first = np.ones(len(starts), bool)
        first[marked] = False
        kept = np.flatnonzero(np.bincount(string[first], minlength=len(heads)) > 0)
        words = self.words.take(pa.array(ranges(heads[kept], lengths[kept])))
        return marks, _Strings(words, self.ids[kept], self.text_hashes[kept], self.at[kept], self.n_windows[kept])


def _sort_buckets(width: int):
    """One bucket, a part of its shelves at a time; of a packed blob, `starts` holds the number of words."""

    def sort(batches):
        blobs, n_words = [], 0
        for batch in batches:
            is_mark = pc.is_null(batch.column("payload"))
            marks = batch.filter(is_mark)
            if marks.num_rows:
                yield marks.select(["doc_id", "text_hash", "starts"])
            some = batch.filter(pc.invert(is_mark))
            blobs += some.column("payload").to_pylist()
            n_words += pc.sum(some.column("starts").flatten()).as_py() or 0
        passes = 1
        while passes < SHELVES and n_words > passes * SLAB_WORDS:
            passes *= 2
        for k in range(passes):
            held, n_held, settled = [], 0, 0
            for blob in blobs:
                strings = _Strings.read(blob, slice(k * SHELVES // passes, (k + 1) * SHELVES // passes))
                if strings is None:
                    continue
                held.append(strings)
                n_held += len(strings.words)
                if n_held > 2 * max(SLAB_WORDS, settled):
                    marks, rest = _Strings.joined(held).resolved(width)
                    held, n_held, settled = [rest], len(rest.words), len(rest.words)
                    if marks is not None:
                        yield marks
            if held:
                marks, _ = _Strings.joined(held).resolved(width)
                if marks is not None:
                    yield marks

    return sort


def _remove(width: int):
    """The words of each text that no marked window covers; a mark holds for all equal windows of the text."""

    def covered(codes, hashes, n_words, marked):
        starts = np.arange(n_words - width + 1)
        places, new = equal_windows(codes, hashes, starts, width)
        wanted = np.zeros(len(starts), bool)
        wanted[marked] = True
        if len(places):
            group = np.cumsum(new) - 1
            hit = np.bincount(group, weights=wanted[places]) > 0
            wanted[places[hit[group]]] = True
        edges = np.zeros(n_words + 1, np.int64)
        edges[:-width] += wanted
        edges[width:] -= wanted
        return np.cumsum(edges)[:-1] > 0

    def remove(batches):
        for block in blocks(batches, BLOCK_BYTES):
            marks = block.column("starts")
            n_words, n_removed, kept_texts = [], [], []
            for k, text in enumerate(block.column("text").to_pylist()):
                words = (text or "").encode().split()
                n_words.append(len(words))
                if len(words) >= width and (marked := np.unique(np.asarray(marks[k].values, dtype=np.int64) if marks[k].is_valid else np.zeros(0, np.int64))).size:
                    codes, distinct = coded(pa.array(words, pa.binary()))
                    gone = covered(codes, rolled(hashes_of(distinct)[codes], width), len(words), marked)
                    n_removed.append(int(gone.sum()))
                    words = [w for w, g in zip(words, gone.tolist(), strict=True) if not g]
                else:
                    n_removed.append(0)
                kept_texts.append(b" ".join(words))
            kept = pa.array(kept_texts, pa.binary()).cast(pa.string())
            yield pa.RecordBatch.from_arrays([block.column("doc_id"), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), kept], ["doc_id", "n_words", "n_removed", "kept_text"])

    return remove


def dedup_substrings(docs: DataFrame, width: int = WINDOW, minimiser: int = MINIMISER, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_words, n_removed, kept_text (the other words, joined by a space) of every row."""
    spark = docs.sparkSession
    prepare(spark)
    n_buckets = shuffle_partitions(spark)
    rows = docs.select(F.coalesce(F.col(doc_id).cast("long"), F.lit(NULL_ID)).alias("doc_id"), F.xxhash64(F.col(text).cast("string")).alias("text_hash"), F.col(text).cast("string").alias("text"))
    sent = rows.mapInArrow(_send(width, minimiser, n_buckets), SENT).repartitionById(n_buckets, "bucket")
    marks = sent.mapInArrow(_sort_buckets(width), MARKS).groupBy("doc_id", "text_hash").agg(F.flatten(F.collect_list("starts")).alias("starts"))
    marked = rows.join(marks, ["doc_id", "text_hash"], "left").select("doc_id", "text", "starts")
    kept = marked.mapInArrow(_remove(width), "doc_id long, n_words long, n_removed long, kept_text string")
    return kept.withColumn("doc_id", F.when(F.col("doc_id") != NULL_ID, F.col("doc_id")))

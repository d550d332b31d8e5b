"""Blocks of texts inside a task: bounded memory, words and hashes as arrays instead of Python objects."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash

#: Bytes of text handled together in a task.
BLOCK_BYTES = 12 << 20

GOLDEN = np.uint64(0x9E3779B97F4A7C15)


def blocks(batches: Iterator[pa.RecordBatch], limit: int = BLOCK_BYTES) -> Iterator[pa.RecordBatch]:
    """Batches joined or split to about `limit` bytes; a row is never split."""
    held: list[pa.RecordBatch] = []
    size = 0
    waiting = []
    for batch in batches:
        waiting.append(batch)
        while waiting:
            piece = waiting.pop()
            if piece.num_rows == 0:
                continue
            if piece.nbytes > limit and piece.num_rows > 1:
                half = piece.num_rows // 2
                waiting += [piece.slice(half), piece.slice(0, half)]
                continue
            if held and size + piece.nbytes > limit:
                yield _joined(held)
                held, size = [], 0
            held.append(piece)
            size += piece.nbytes
    if held:
        yield _joined(held)


def _joined(batches: list[pa.RecordBatch]) -> pa.RecordBatch:
    return batches[0] if len(batches) == 1 else pa.concat_batches(batches)


def words_of(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """All words (runs without ASCII white space) of all texts in order, and the number of words of each text."""
    if len(texts) == 0:
        return pa.array([], pa.large_string()), np.zeros(0, np.int64)
    parts = pc.ascii_split_whitespace(pc.fill_null(texts.cast(pa.large_string()), ""))
    values = parts.flatten()
    full = pc.binary_length(values).to_numpy(zero_copy_only=False) > 0
    heads = parts.offsets.to_numpy()[:-1] - parts.offsets[0].as_py()
    counts = np.add.reduceat(full.astype(np.int64), heads)
    return (values if full.all() else values.filter(pa.array(full))), counts


def coded(words: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """A code for each word, and the distinct words by code."""
    encoded = words.dictionary_encode()
    return encoded.indices.to_numpy(zero_copy_only=False), encoded.dictionary


def hashes_of(distinct: pa.Array) -> np.ndarray:
    """A 64-bit hash of each string, the same in every task."""
    return np.fromiter((xxhash.xxh3_64_intdigest(x) for x in distinct.to_pylist()), np.uint64, len(distinct))


def mixed(values: np.ndarray) -> np.ndarray:
    """Every bit of a 64-bit value spread over all bits."""
    z = (values ^ (values >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return z ^ (z >> np.uint64(31))


def rolled(hashes: np.ndarray, width: int) -> np.ndarray:
    """A hash of each run of `width` neighbours; as many as there are full runs."""
    n = len(hashes) - width + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    total = np.zeros(n, np.uint64)
    for j in range(width):
        total = total * GOLDEN + hashes[j : j + n]
    return mixed(total)


def starts_of(counts: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions (among all words) where a run of `width` words of one text starts, and the text of each."""
    heads = np.cumsum(counts) - counts
    full = np.maximum(counts - width + 1, 0)
    rows = np.repeat(np.arange(len(counts)), full)
    return ranges(heads, full), rows


def ranges(heads: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """head, head + 1, ... for each length, one after the other."""
    total = int(lengths.sum())
    ends = np.cumsum(lengths)
    return np.arange(total, dtype=np.int64) + np.repeat(heads - (ends - lengths), lengths)


def list_array(values: np.ndarray, counts: np.ndarray, kind: pa.DataType) -> pa.Array:
    """A list array whose rows take `counts` values each."""
    offsets = np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values, type=kind))

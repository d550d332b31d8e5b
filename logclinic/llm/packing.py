"""Best-fit packing of token sequences by hierarchical residual packing.

Every partition packs its own pieces best-fit decreasing.  Bins that are nearly full are final.  The underfull ones travel
as items, a few bytes each, through rounds of a tree: the items of a round are dealt over tasks of bounded size, packed
best-fit again, and nearly full bins leave.  Rounds end when one task held all items or a round closed hardly any bin.

A text's ids are followed by one separator id.  Texts longer than the capacity are cut into pieces of full capacity from
the end, so only the first piece may be shorter.  Null texts count as empty and still give one piece, the separator.  Rows
with equal ids are packed one by one; other columns are ignored; an empty table gives no pieces.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logclinic.llm.blocks import blocks, list_array
from logclinic.llm.staging import prepare, staged
from logclinic.llm.tokens import gathered, per_text, tokenizer_of

CAPACITY = 2048
SEPARATOR = 0
#: A bin with at most this share of its capacity free is final.
SLACK = 1 / 128
#: Items that one task packs together.
TASK_ITEMS = 40_000
#: Rounds go on while a round saves at least this share of the open bins.
LEAST_GAIN = 0.01

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long, bin long, offset long, fill long"


def best_fit(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bin and offset of each item, and the fill of each bin; longest items first, each into the fullest bin with room."""
    n = len(lengths)
    bin_of, offset, fill = np.zeros(n, np.int64), np.zeros(n, np.int64), []
    with_room: list[list[int]] = [[] for _ in range(capacity + 1)]
    rooms = 0  # bit r: some bin has room r
    for item in np.argsort(-lengths, kind="stable").tolist():
        size = int(lengths[item])
        fitting = rooms >> size
        if fitting:
            room = (fitting & -fitting).bit_length() - 1 + size
            chosen = with_room[room].pop()
            if not with_room[room]:
                rooms ^= 1 << room
        else:
            room, chosen = capacity, len(fill)
            fill.append(0)
        bin_of[item], offset[item] = chosen, fill[chosen]
        fill[chosen] += size
        if left := room - size:
            if not with_room[left]:
                rooms |= 1 << left
            with_room[left].append(chosen)
    return bin_of, offset, np.array(fill, np.int64)


def cut_pieces(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Row, number, start and length of the pieces of texts with so many ids."""
    count = -(-lengths // capacity)
    rows = np.repeat(np.arange(len(lengths)), count)
    number = np.arange(int(count.sum())) - np.repeat(np.cumsum(count) - count, count)
    first = lengths - (count - 1) * capacity
    start = np.where(number == 0, 0, first[rows] + (number - 1) * capacity)
    return rows, number, start, np.where(number == 0, first[rows], capacity)


def _packed_locally(path: str, capacity: int, separator: int, slack: float, with_ids: bool):
    def pack(batches):
        tokenizer = tokenizer_of(path)
        next_bin = TaskContext.get().partitionId() << 36
        held, n_held = [], 0
        for block in blocks(batches):
            codes, n_units, units = tokenizer.units(block.column("text"))
            flat, n_ids = tokenizer.ids(units)
            own = per_text(n_ids[codes], n_units)
            ids = np.full(int(own.sum()) + len(own), separator, np.uint32)
            ends = np.cumsum(own + 1)
            inside = np.ones(len(ids), bool)
            inside[ends - 1] = False
            ids[inside] = gathered(flat, n_ids, codes)
            rows, number, start, length = cut_pieces(own + 1, capacity)
            at = (ends - own - 1)[rows] + start
            raw = memoryview(ids.astype("<u4").view(np.uint8))
            crc = np.fromiter((zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip(at.tolist(), (at + length).tolist(), strict=True)), np.int64, len(at))
            columns = [block.column("doc_id").take(pa.array(rows)), pa.array(number, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc)]
            held.append((columns, length, list_array(ids.astype(np.int32), length, pa.int32()) if with_ids else None))
            n_held += len(rows)
            if n_held >= TASK_ITEMS:
                yield from flush(held, next_bin)
                next_bin += n_held
                held, n_held = [], 0
        if held:
            yield from flush(held, next_bin)

    def flush(held, next_bin):
        bin_of, offset, fill = best_fit(np.concatenate([x[1] for x in held]), capacity)
        at = 0
        for columns, length, ids in held:
            part = slice(at, at + len(length))
            arrays = [*columns, pa.array(bin_of[part] + next_bin), pa.array(offset[part]), pa.array(fill[bin_of[part]])]
            names = ["doc_id", "piece", "start", "length", "ids_crc32", "bin", "offset", "fill"]
            yield pa.RecordBatch.from_arrays(arrays + ([ids] if with_ids else []), names + (["ids"] if with_ids else []))
            at += len(length)

    return pack


def _packed_again(capacity: int):
    """One task of a round: open bins as items, with the bins they are made of and those bins' places."""

    def pack(batches):
        batches = [b for b in batches if b.num_rows]
        if not batches:
            return
        items = pa.Table.from_batches(batches).combine_chunks()
        length = items.column("length").to_numpy()
        bin_of, offset, fill = best_fit(length, capacity)
        order = np.argsort(bin_of, kind="stable")
        members = items.column("members").combine_chunks().take(pa.array(order))
        n_members = pc.list_value_length(members).to_numpy(zero_copy_only=False).astype(np.int64)
        inner = members.flatten()
        shifts = inner.field("shift").to_numpy(zero_copy_only=False) + np.repeat(offset[order], n_members)
        heads = np.flatnonzero(np.diff(bin_of[order], prepend=-1))
        in_bin = np.add.reduceat(n_members, heads)
        offsets = pa.array(np.concatenate([[0], np.cumsum(in_bin)]).astype(np.int32))
        merged = pa.StructArray.from_arrays([inner.field("bin"), pa.array(shifts, pa.int64())], ["bin", "shift"])
        first = items.column("item").combine_chunks().take(pa.array(order[heads]))
        yield pa.RecordBatch.from_arrays([first, pa.array(fill[bin_of[order[heads]]], pa.int64()), pa.ListArray.from_arrays(offsets, merged)], ["item", "length", "members"])

    return pack


def pack(docs: DataFrame, path: str, capacity: int = CAPACITY, separator: int = SEPARATOR, slack: float = SLACK, with_ids: bool = False, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset, and the ids if asked for."""
    spark = docs.sparkSession
    prepare(spark)
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    pieces = staged(rows.mapInArrow(_packed_locally(path, capacity, separator, slack, with_ids), PIECES + (", ids array<int>" if with_ids else "")), "pieces")

    most = int(capacity * (1 - slack))
    item_schema = "item long, length long, members array<struct<bin: long, shift: long>>"
    members = F.array(F.struct("bin", F.lit(0).cast("long").alias("shift")))
    open_items = pieces.filter((F.col("offset") == 0) & (F.col("fill") < most)).select(F.col("bin").alias("item"), F.col("fill").alias("length"), members.alias("members"))
    closed = []
    count = open_items.count()
    for turn in range(64):
        if count < 2:
            break
        tasks = -(-count // TASK_ITEMS)
        dealt = open_items.repartition(tasks, F.xxhash64("item", F.lit(turn))) if tasks > 1 else open_items.repartition(1)
        packed = staged(dealt.mapInArrow(_packed_again(capacity), item_schema), "round")
        closed.append(packed.filter(F.col("length") >= most))
        open_items = packed.filter(F.col("length") < most)
        left = packed.count()
        gained, count = count - left, open_items.count()
        if tasks == 1 or gained < LEAST_GAIN * left:
            break
    for one in closed:
        open_items = open_items.unionByName(one)
    moved = open_items.select("item", F.explode("members").alias("m")).select(F.col("m.bin").alias("bin"), F.col("item").alias("to_bin"), F.col("m.shift").alias("shift"))
    placed = pieces.join(moved, "bin", "left")
    return placed.select(
        "doc_id", "piece", "start", "length", "ids_crc32",
        F.coalesce("to_bin", "bin").alias("sequence_id"),
        (F.col("offset") + F.coalesce("shift", F.lit(0))).alias("offset"),
        *(["ids"] if with_ids else []),
    )


def sequences(packed: DataFrame) -> DataFrame:
    """The packed sequences themselves, of pieces packed `with_ids`: sequence_id, ids, and where its documents start."""
    piece = F.struct("offset", "doc_id", "ids")
    return packed.groupBy("sequence_id").agg(F.array_sort(F.collect_list(piece)).alias("parts")).select(
        "sequence_id", F.flatten("parts.ids").alias("ids"), F.col("parts.offset").alias("offsets"), F.col("parts.doc_id").alias("doc_ids")
    )

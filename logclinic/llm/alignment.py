"""Tokens of two tokenizers aligned by the bytes they cover, and counts of the linked pairs over the corpus.

A is a byte-level BPE file of the tokenizers library and sees a space before the text; B is a sentencepiece model, which
adds that space itself.  Where an A token and a B token end at the same byte, the two are linked and a group ends.

Arrow carries the work.  A block of texts is cut into its distinct units (from one space after a non-space to the next:
neither tokenizer has a token across such a place, so a document's ends are its units' ends, moved).  Tokens of a unit
are a list; flattened, with their parents and the sums of their lengths within each parent, they become a table of ends
per tokenizer; an Acero hash join on (parent, end) gives the links; `Table.group_by` counts the pairs of the block.
Spark adds the counts of all blocks, finds the highest of each B id, and hands every block the counts of its own pairs,
so what travels is a row per block and distinct pair, never one per token.

A text has no tokens, and zeros in all columns, where it is null or empty or the joined bytes of its A or B tokens are
not the bytes of space and text.  Rows with equal ids are aligned one by one; other columns are ignored; an empty
table gives no rows.  A pair that every block holds has one row per block, which Spark's skewed joins can divide.
"""

from __future__ import annotations

import sys
import types
from hashlib import sha256

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logclinic.llm.blocks import blocks
from logclinic.llm.packs import packed, unpacked
from logclinic.llm.staging import prepare, staged
from logclinic.llm.tokens import BlockTokenizer, byte_letters, per_text

#: Ends of one parent lie below this.
END_BITS = 32
DOCUMENTS = "doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string"
STAGED = "block long, payload binary, code int, a int, b int, n long"
ALIGNED = f"{DOCUMENTS}, n_best long, count_sum long"
#: Stands for a null id inside a payload.
NO_ID = np.int64(-(1 << 63))


class Aligner:
    """Both tokenizers, and the bytes of each of their tokens."""

    def __init__(self, path_a: str, path_b: str):
        import sentencepiece

        self.a = BlockTokenizer(path_a)
        self.a.tokenizer.encode_special_tokens = True
        self.a.special = []  # their strings are plain text here
        of_letter = byte_letters()
        self.bytes_a = self._table({i: bytes(of_letter[c] for c in piece) if all(c in of_letter for c in piece) else piece.encode() for piece, i in self.a.tokenizer.get_vocab().items()})
        self.b = sentencepiece.SentencePieceProcessor(model_file=path_b)
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        if any("▁" in piece.lstrip("▁") for piece in pieces):
            raise ValueError("a piece goes on after a space: texts cannot be cut at spaces")
        self.bytes_b = self._table({i: bytes([int(piece[3:-1], 16)]) if self.b.is_byte(i) else piece.replace("▁", " ").encode() for i, piece in enumerate(pieces)})

    @staticmethod
    def _table(of_id: dict[int, bytes]) -> pa.Array:
        return pa.array([of_id.get(i, b"") for i in range(max(of_id) + 1)], pa.large_binary())

    def encode_a(self, units: pa.Array) -> pa.LargeListArray:
        flat, counts = self.a.ids(units)
        return _lists(flat.astype(np.int32), counts)

    def encode_b(self, units: pa.Array) -> pa.LargeListArray:
        """Units start with the space that the model adds itself, as all units of space and text do."""
        found = self.b.encode(pc.binary_replace_slice(units.cast(pa.large_binary()), 0, 1, b"").cast(pa.large_string()).to_pylist(), num_threads=1)
        counts = np.fromiter(map(len, found), np.int64, len(found))
        flat = np.fromiter((i for own in found for i in own), np.int32, int(counts.sum()))
        empty = pc.equal(units, " ").to_numpy(zero_copy_only=False)
        if empty.any():  # a space alone: the model adds none to an empty text, but one to a text that ends there
            flat, counts = self._with_space(flat, counts, np.flatnonzero(empty))
        return _lists(flat, counts)

    def _with_space(self, flat: np.ndarray, counts: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        heads = np.cumsum(counts) - counts
        counts = counts.copy()
        counts[rows] += 1
        return np.insert(flat, heads[rows], self.b.piece_to_id("▁")).astype(np.int32), counts


def aligner_of(path_a: str, path_b: str) -> Aligner:
    """Kept for the life of the Python worker."""
    kept = sys.modules.setdefault("_kept_aligners", types.ModuleType("_kept_aligners")).__dict__
    key = f"{path_a}\n{path_b}"
    if key not in kept:
        kept[key] = Aligner(path_a, path_b)
    return kept[key]


def _lists(flat: np.ndarray, counts: np.ndarray) -> pa.LargeListArray:
    return pa.LargeListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(counts)]), pa.int64()), pa.array(flat))


def _lengths(lists: pa.Array) -> np.ndarray:
    return pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64)


def _ends(lists: pa.LargeListArray, token_bytes: pa.Array) -> tuple[np.ndarray, pa.Array, pa.Array]:
    """Key (parent, end) of every token, its id, and the joined bytes of each parent."""
    ids, parents = pc.list_flatten(lists), pc.list_parent_indices(lists).to_numpy()
    taken = token_bytes.take(ids)
    total = pc.cumulative_sum(pc.binary_length(taken).cast(pa.int64())).to_numpy()
    before = np.concatenate([[0], total])[lists.offsets.to_numpy()[:-1]]
    joined = pc.binary_join(pa.LargeListArray.from_arrays(lists.offsets, taken), pa.scalar(b"", pa.large_binary()))
    return (parents << END_BITS) + (total - before[parents]), ids, joined


def _texts_of(ids: pa.Array, keys: np.ndarray, ends: np.ndarray) -> pa.Array:
    """The ids up to each end, joined by commas."""
    borders = np.concatenate([[0], np.searchsorted(keys, ends, "right")])
    return pc.binary_join(pa.LargeListArray.from_arrays(pa.array(borders, pa.int64()), ids.cast(pa.large_string())), pa.scalar(",", pa.large_string()))


class Links:
    """The links of distinct units: groups as text, tokens of each side, pairs by code."""

    def __init__(self, aligner: Aligner, units: pa.Array):
        lists_a, lists_b = aligner.encode_a(units), aligner.encode_b(units)
        keys_a, ids_a, joined_a = _ends(lists_a, aligner.bytes_a)
        keys_b, ids_b, joined_b = _ends(lists_b, aligner.bytes_b)
        exact = units.cast(pa.large_binary())
        self.whole = pc.and_(pc.equal(joined_a, exact), pc.equal(joined_b, exact)).to_numpy(zero_copy_only=False)
        self.n_a, self.n_b = _lengths(lists_a), _lengths(lists_b)
        if not self.whole.all():  # units without links: texts that hold them have no tokens
            (keys_a, ids_a), (keys_b, ids_b) = self._of_whole(keys_a, ids_a), self._of_whole(keys_b, ids_b)
        left = pa.table({"end": keys_a, "a": ids_a})
        links = left.join(pa.table({"end": keys_b, "b": ids_b}), "end", join_type="inner", use_threads=False).sort_by("end")
        ends = links["end"].to_numpy()
        self.n_links = np.bincount(ends >> END_BITS, minlength=len(units)).astype(np.int64)
        groups = pc.binary_join_element_wise(_texts_of(ids_a, keys_a, ends), _texts_of(ids_b, keys_b, ends), pa.scalar("|", pa.large_string()))
        self.groups = pc.binary_join(pa.LargeListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(self.n_links)]), pa.int64()), groups), pa.scalar(";", pa.large_string()))
        self.pairs = links.select(["a", "b"])

    def _of_whole(self, keys: np.ndarray, ids: pa.Array) -> tuple[np.ndarray, pa.Array]:
        kept = self.whole[keys >> END_BITS]
        return keys[kept], ids.filter(pa.array(kept))

    def counted(self, uses: np.ndarray) -> tuple[pa.Table, np.ndarray]:
        """Distinct pairs with their links in the block, each unit as often as it is used, and the pair code of every link."""
        weighted = self.pairs.append_column("n", pa.array(np.repeat(uses, self.n_links)))
        counts = weighted.group_by(["a", "b"], use_threads=False).aggregate([("n", "sum")]).rename_columns(["a", "b", "n"])
        one = lambda t: (t["a"].to_numpy().astype(np.int64) << 32) + t["b"].to_numpy()
        order = np.argsort(one(counts))
        counts = counts.take(pa.array(order))
        return counts, np.searchsorted(one(counts), one(self.pairs))


def align(docs: DataFrame, path_a: str, path_b: str) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, groups_sha256, n_best, count_sum of every row (see `op11` for their meaning).

    Groups are digested in the form `a1,a2|b1;a3|b2,b3`; `aligned_groups` gives them as text.
    """
    spark = docs.sparkSession
    prepare(spark)

    def first(batches):
        aligner = aligner_of(path_a, path_b)
        task = TaskContext.get().partitionId() << 32
        for number, block in enumerate(blocks(batches)):
            doc_ids, codes, n_units, links, whole, groups = _block(aligner, block)
            uses = np.bincount(codes[np.repeat(whole, n_units)], minlength=len(links.whole)).astype(np.int64)
            counts, link_codes = links.counted(uses)
            sums = lambda per_unit: np.where(whole, per_text(per_unit[codes], n_units), 0)
            digests = np.frombuffer(b"".join(sha256(x).digest() if ok else bytes(32) for x, ok in zip(groups, whole.tolist(), strict=True)), np.uint8)
            used = counts["n"].to_numpy() > 0  # pairs of units that no whole text holds are of no interest
            place = np.cumsum(used) - 1
            kept = uses > 0
            link_codes = place[link_codes[np.repeat(kept, links.n_links)]]
            renumbered = np.cumsum(kept) - 1
            payload = packed(
                doc_ids, whole.astype(np.uint8), sums(links.n_a), sums(links.n_b), sums(links.n_links), digests,
                renumbered[codes[np.repeat(whole, n_units)]].astype(np.int32), np.where(whole, n_units, 0), link_codes.astype(np.int32), links.n_links[kept],
            )
            counts = counts.filter(pa.array(used))
            n = len(counts)
            after_payload = lambda values, kind: pa.concat_arrays([pa.nulls(1, kind), pa.array(values, kind)])
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(n + 1, task + number), pa.int64()), pa.array([payload] + [None] * n, pa.binary()), after_payload(np.arange(n), pa.int32()),
                 *(after_payload(counts[name].to_numpy(), kind) for name, kind in (("a", pa.int32()), ("b", pa.int32()), ("n", pa.int64())))],
                ["block", "payload", "code", "a", "b", "n"],
            )

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    stored = staged(rows.mapInArrow(first, STAGED), "aligned")
    pairs = stored.filter("payload is null").select("block", "code", "a", "b", "n")
    return _with_counts(stored.filter("payload is not null").select("block", "payload"), pairs, pair_counts(pairs))


def pair_counts(pairs: DataFrame) -> DataFrame:
    """a, b, count (links of the pair in the corpus), best (whether no other A id has more links with this B id)."""
    counts = staged(pairs.groupBy("a", "b").agg(F.sum("n").alias("count")), "pair-counts")
    # one row per id of B: bounded by its vocabulary
    highest = counts.groupBy("b").agg(F.max("count").alias("highest"))
    return counts.join(F.broadcast(highest), "b").select("a", "b", "count", (F.col("count") == F.col("highest")).alias("best"))


def _with_counts(payloads: DataFrame, pairs: DataFrame, counts: DataFrame) -> DataFrame:
    """Every block meets the counts of its own pairs."""

    def second(own: pa.Table, known: pa.Table) -> pa.Table:
        doc_ids, whole, n_a, n_b, n_links, digests, codes, n_units, link_codes, unit_links = unpacked(own["payload"][0].as_py())
        order = np.argsort(known["code"].to_numpy())
        count, best = known["count"].to_numpy()[order], known["best"].to_numpy()[order]
        over = lambda values: per_text(per_text(values[link_codes], unit_links)[codes], n_units)
        shown = [digests[32 * k : 32 * k + 32].tobytes().hex() if ok else "" for k, ok in enumerate(whole.tolist())]
        has_id = doc_ids != NO_ID
        columns = [pa.array(doc_ids, pa.int64(), mask=~has_id), n_a, n_b, n_links, n_links, shown, over(best.astype(np.int64)), over(count)]
        return pa.table(columns, ["doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "n_best", "count_sum"])

    known = pairs.join(counts, ["a", "b"]).select("block", "code", "count", "best")
    return payloads.groupBy("block").cogroup(known.toDF("of_block", "code", "count", "best").groupBy("of_block")).applyInArrow(second, ALIGNED)


def _block(aligner: Aligner, block: pa.RecordBatch):
    """doc ids, unit codes, units per text, links of the units, texts that have tokens, groups of each text."""
    texts = pc.fill_null(block.column("text").cast(pa.large_string()), "")
    spaced = pc.binary_join_element_wise(pa.scalar("", pa.large_string()), texts, pa.scalar(" ", pa.large_string()))
    codes, n_units, units = aligner.a.units(spaced)
    full = pc.binary_length(units).to_numpy(zero_copy_only=False)[codes] > 0
    codes, n_units = codes[full], per_text(full.astype(np.int64), n_units)
    used = np.unique(codes)
    codes, units = np.searchsorted(used, codes), units.take(pa.array(used))
    links = Links(aligner, units)
    broken = per_text((~links.whole)[codes].astype(np.int64), n_units)
    whole = (broken == 0) & (pc.binary_length(texts).to_numpy() > 0)
    lists = pa.LargeListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(n_units)]), pa.int64()), links.groups.take(pa.array(codes)))
    groups = pc.binary_join(lists, pa.scalar(";", pa.large_string())).cast(pa.large_binary()).to_pylist()
    doc_ids = pc.fill_null(block.column("doc_id"), int(NO_ID)).to_numpy(zero_copy_only=False)
    return doc_ids, codes, n_units, links, whole, groups


def aligned_groups(docs: DataFrame, path_a: str, path_b: str) -> DataFrame:
    """doc_id, groups (`a1,a2|b1;a3|b2,b3`, null without tokens): the alignment itself."""
    prepare(docs.sparkSession)

    def show(batches):
        aligner = aligner_of(path_a, path_b)
        for block in blocks(batches):
            *_, whole, groups = _block(aligner, block)
            yield pa.RecordBatch.from_arrays([block.column("doc_id"), pa.array([g.decode() if ok else None for g, ok in zip(groups, whole.tolist(), strict=True)], pa.string())], ["doc_id", "groups"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(show, "doc_id long, groups string")

"""Token counts and packing against the tokenizers library."""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from logclinic.llm import packing
from logclinic.llm.queries import QUERIES, tokenizer_path
from logclinic.llm.token_counts import count_tokens
from logclinic.llm.tokens import BlockTokenizer, gathered, per_text
from tests.llm.conftest import SMALL, ordered, pairs_of

TOKENIZER = Tokenizer.from_file(tokenizer_path())
BLOCKS = BlockTokenizer(tokenizer_path())
LETTERS = st.text(st.sampled_from([*" \n\t\r\x0b\x1c\x85  　ab'.!_1é中٣²😀\x00", "\U0001e900", "İ"]), max_size=30)
PARTS = st.lists(st.one_of(LETTERS, st.sampled_from(["'s", " the", "<|endoftext|>", "  ", " x", "text"])), max_size=6).map("".join)


def ids_of(text: str | None) -> list[int]:
    return TOKENIZER.encode(text or "", add_special_tokens=False).ids


@settings(max_examples=300, deadline=None)
@given(st.lists(st.one_of(st.none(), PARTS), min_size=1, max_size=5))
def test_blocks_give_the_ids_of_whole_texts(texts):
    codes, n_units, units = BLOCKS.units(pa.array(texts, pa.string()))
    flat, n_ids = BLOCKS.ids(units)
    ends = np.cumsum(per_text(n_ids[codes], n_units))
    ids = gathered(flat, n_ids, codes).tolist()
    assert [ids[a:b] for a, b in zip([0, *ends], ends, strict=False)] == [ids_of(t) for t in texts]
    pre_codes, n_pre, pre_tokens = BLOCKS.pre_tokens(units)
    of_unit = per_text(BLOCKS.counts(pre_tokens)[pre_codes], n_pre)
    assert per_text(of_unit[codes], n_units).tolist() == [len(ids_of(t)) for t in texts]


@pytest.mark.parametrize("table", ["odd", "small"])
def test_token_counts(table, request):
    docs = request.getfixturevalue(table)
    want = [(d, len((t or "").encode()), len(ids_of(t))) for d, t in pairs_of(docs)]
    assert ordered(count_tokens(docs, tokenizer_path()).collect()) == ordered(want)


def test_token_query(spark, small):
    found = QUERIES["op3_token_counts"](spark, SMALL).collect()
    assert {r["doc_id"]: r["over_limit"] for r in found} == {d: len(ids_of(t)) > 512 for d, t in pairs_of(small)}


@pytest.mark.parametrize("table", ["odd", "small"])
def test_packing(table, request):
    """Pieces make up their documents, sequences have no gap, and few sequences are needed."""
    docs = request.getfixturevalue(table)
    pieces = packing.pack(docs, tokenizer_path(), with_ids=True)
    placed = pieces.collect()
    wanted = sorted(str([*ids_of(t), 0]) for _, t in pairs_of(docs))
    found: dict = {}
    fill: dict = {}
    for r in sorted(placed, key=lambda r: (r["sequence_id"], r["offset"])):
        assert fill.get(r["sequence_id"], 0) == r["offset"]
        fill[r["sequence_id"]] = r["offset"] + r["length"]
        assert zlib.crc32(np.array(r["ids"], "<u4").tobytes()) == r["ids_crc32"] and len(r["ids"]) == r["length"]
        assert r["piece"] == 0 or r["length"] == packing.CAPACITY
    assert max(fill.values()) <= packing.CAPACITY
    if table == "small":
        for r in sorted(placed, key=lambda r: (r["doc_id"], r["piece"])):
            own = found.setdefault(r["doc_id"], [])
            assert r["start"] == len(own)
            own += r["ids"]
        assert sorted(str(x) for x in found.values()) == wanted
    assert len(fill) <= 1.05 * sum(fill.values()) / packing.CAPACITY + 2
    whole = {r["sequence_id"]: r["ids"] for r in packing.sequences(pieces).collect()}
    assert {k: len(v) for k, v in whole.items()} == fill


def test_best_fit_fills_the_tightest_bin():
    bins, offsets, fill = packing.best_fit(np.array([6, 5, 4, 3]), 10)
    assert fill.tolist() == [10, 8] and bins.tolist() == [0, 1, 0, 1] and offsets.tolist() == [0, 0, 6, 5]


def test_rounds_merge_open_bins(monkeypatch, small):
    monkeypatch.setattr(packing, "TASK_ITEMS", 20)
    placed = packing.pack(small, tokenizer_path()).collect()
    fill: dict = {}
    for r in placed:
        fill.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for own in fill.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= packing.CAPACITY
    assert len(placed) == sum(map(len, fill.values()))


def test_empty_tables(empty):
    assert count_tokens(empty, tokenizer_path()).count() == 0
    assert packing.pack(empty, tokenizer_path()).count() == 0

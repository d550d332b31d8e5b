"""Alignment of two tokenizers against whole texts encoded by the libraries."""

from __future__ import annotations

import pyarrow as pa
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from logclinic.llm import alignment
from logclinic.llm.blocks import blocks
from logclinic.llm.queries import OTHER_TOKENIZER, QUERIES, tokenizer_path
from logclinic.llm.tokens import byte_letters
from tests.llm import plain
from tests.llm.conftest import SMALL, ordered, pairs_of

PATHS = tokenizer_path(), tokenizer_path(OTHER_TOKENIZER)
A = Tokenizer.from_file(PATHS[0])
A.encode_special_tokens = True
B = sentencepiece.SentencePieceProcessor(model_file=PATHS[1])
LETTERS = byte_letters()
CHARACTERS = st.text(st.sampled_from([*" \n\t\r\x0b\x1c\x85\u00a0\u3000ab'.!_1é中٣²😀\x00▁<>/s", "İ"]), max_size=30)
PARTS = st.lists(st.one_of(CHARACTERS, st.sampled_from(["'s", " the", "<|endoftext|>", "  ", " x", "text", "</s>", "<0x41>", "▁the", "<unk>"])), max_size=6).map("".join)


def ids_a(text: str) -> list[int]:
    return A.encode(f" {text}", add_special_tokens=False).ids


def bytes_b(i: int) -> bytes:
    return bytes([int(B.id_to_piece(i)[3:5], 16)]) if B.is_byte(i) else B.id_to_piece(i).replace("▁", " ").encode()


def want(rows) -> list[tuple]:
    return plain.aligned(rows, ids_a, lambda i: bytes(LETTERS[c] for c in A.id_to_token(i)), B.encode, bytes_b)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.one_of(st.none(), PARTS), min_size=1, max_size=4))
def test_units_give_the_groups_of_whole_texts(texts):
    aligner = alignment.aligner_of(*PATHS)
    block = pa.RecordBatch.from_arrays([pa.array(range(len(texts)), pa.int64()), pa.array(texts, pa.string())], ["doc_id", "text"])
    *_, whole, groups = alignment._block(aligner, next(blocks(iter([block]))))
    assert [g.decode() if ok else "" for g, ok in zip(groups, whole.tolist(), strict=True)] == [r[-1] for r in want(list(enumerate(texts)))]


@pytest.mark.parametrize("table", ["odd", "small"])
def test_alignment(table, request):
    docs = request.getfixturevalue(table)
    rows = want(pairs_of(docs))
    found = alignment.align(docs, *PATHS).select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256").collect()
    assert ordered(found) == ordered([(*r[:-1], plain.digest(r[-1]) if r[1] else "") for r in rows])
    assert ordered(alignment.aligned_groups(docs, *PATHS).collect()) == ordered([(r[0], r[-1] or None) for r in rows])


def test_small_blocks_add_up(small, monkeypatch):
    """Counts are those of the corpus, however it is cut into blocks and partitions."""
    whole = alignment.align(small, *PATHS).collect()
    parted = alignment.align(small.repartition(5), *PATHS).collect()
    assert ordered(parted) == ordered(whole)


def test_query(spark, small):
    found = QUERIES["op11_alignment"](spark, SMALL)
    assert found.count() == small.count() and found.filter("n_links > 0").count() > 0


def test_empty(empty):
    assert alignment.align(empty, *PATHS).count() == 0

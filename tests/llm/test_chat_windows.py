"""Chat windows against plain Python, and read back."""

from __future__ import annotations

import random
import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from logclinic.llm import chat_windows as chat
from logclinic.llm.queries import QUERIES, tokenizer_path
from tests.llm import plain
from tests.llm.conftest import SMALL, ordered

PATH = tokenizer_path()
TOKENIZER = Tokenizer.from_file(PATH)
SCHEMA = "conv_id long, turn long, role string, text string, window int, segment string, n_tokens double, kind int"
CONTROLS = [x for marks in chat.MARKS.values() for x in marks] + list(chat.OTHER)
SAID = ["</s>[INST] ok [/INST]", "[\\\\INST]", "<\\s>", "<", "[", "<<\\SYS>>", "\n", "  ", "é😀", "s>", "/s>", "\\", "plain words"]


def odd_turns() -> list[tuple]:
    pick = random.Random(5)
    say = lambda n: " ".join(pick.choices(["the", "of", "lix", "téo", *CONTROLS, *SAID], k=n))
    rows: list[tuple] = []
    for conv_id in range(6):
        if conv_id % 2:
            rows.append((conv_id, 0, "system", say(20)))
        rows += [(conv_id, k, ("user", "assistant")[k % 2], say(pick.randrange(60))) for k in range(1, 14)]
    rows += [(7, 0, "system", "s"), (7, 1, "user", "word " * 3000), (7, 2, "assistant", "word " * 900), (7, 3, "tool[:]", say(9)), (7, 3, "assistant", "x"), (7, 3, "assistant", "x"), (7, 4, "system", "late")]
    rows += [(8, 0, "user", None), (8, None, "assistant", "first"), (8, 1, None, "no role"), (8, 1, "", ""), (None, 0, "assistant", "no id"), (None, None, None, None)]
    rows += [(9, k, ("system", "user", "assistant")[min(k, 2 - k % 2)], say(9)) for k in range(400)]
    return rows


@pytest.fixture(scope="module")
def odd_chat(spark):
    return spark.createDataFrame([(*r, 1, "s", 0.5, 2) for r in odd_turns()], SCHEMA).repartition(3)


def escape(text: str) -> str:
    return re.sub(chat.CONTROL, r"\1\\\2", text)


def rendered(role: str, text: str) -> str:
    if role in chat.MARKS:
        return chat.MARKS[role][0] + escape(text) + chat.MARKS[role][1]
    return f"[ROLE]{escape(role)}[:]{escape(text)}[/ROLE]"


@settings(max_examples=500, deadline=None)
@given(st.lists(st.tuples(st.sampled_from(["system", "user", "assistant", "", "tool", "[/ROLE]"]), st.lists(st.sampled_from([*CONTROLS, *SAID]), max_size=6).map("".join)), max_size=4))
def test_templates_are_read_back(turns):
    assert chat.turns_of("".join(rendered(*t) for t in turns)) == turns
    assert all(c not in escape(text) for _, text in turns for c in CONTROLS)


def test_escapes_in_spark_are_the_same(spark):
    texts = [*CONTROLS, *SAID, "<<<SYS>>", "[[\\\\\\:]<s></s>"]
    frame = spark.createDataFrame([(t,) for t in texts], "text string")
    assert [r[0] for r in frame.select(chat.escaped(frame["text"])).collect()] == [escape(t) for t in texts]


def test_windows(odd_chat):
    """One segment each: the windows of plain Python."""
    found = chat.format_windows(odd_chat, PATH, budget=600, history_tokens=300, segment_bytes=1 << 22).collect()
    by_id: dict = {}
    for conv_id, turn, role, text in odd_turns():
        by_id.setdefault(conv_id, []).append((turn is not None, turn or 0, role or "", text or ""))
    want = []
    for conv_id, own in by_id.items():
        shown = [rendered(role, text) for *_, role, text in sorted(own)]
        turns = [(t, len(TOKENIZER.encode(t, add_special_tokens=False).ids), t.startswith("<s>")) for t in shown]
        for k, (repeated, new) in enumerate(plain.chat_windows(turns, 600, 2, 300)):
            want.append((conv_id, 0, k, sum(t[1] for t in repeated + new), len(repeated), "".join(t[0] for t in repeated + new)))
    assert ordered((r["conv_id"], r["segment"], r["window"], r["n_tokens"], r["n_repeated"], r["text"]) for r in found) == ordered(want)
    assert any(r["n_repeated"] == 3 for r in found) and any(r["n_tokens"] > 600 for r in found)


@pytest.mark.parametrize("segment_bytes", [1500, 1 << 20])
def test_read_back(odd_chat, segment_bytes):
    """The same turns and the same loss however conversations are cut."""
    settings = dict(budget=200, history_tokens=9) if segment_bytes < 9999 else {}
    found = chat.read_back_all(odd_chat, PATH, segment_bytes=segment_bytes, **settings).collect()
    assert ordered(tuple(r)[:5] for r in found) == ordered(plain.chat_digests(odd_turns()))


def test_segments_know_system_turn_and_history(odd_chat):
    windows = chat.format_windows(odd_chat.filter("conv_id = 9"), PATH, budget=400, history_tokens=40, history_turns=1, segment_bytes=6000).collect()
    assert len({r["segment"] for r in windows}) > 3
    turns = sorted((t[1], t[2], t[3]) for t in odd_turns() if t[0] == 9)
    system, last = turns[0][1:], None
    for r in sorted(windows, key=lambda r: (r["segment"], r["window"])):
        own = chat.turns_of(r["text"])
        if r["segment"] or r["window"]:
            assert own[0] == system and r["n_repeated"] in (1, 2)
            assert r["n_repeated"] == 1 or own[1] == last
        last = own[-1]
    assert any(r["n_repeated"] == 2 and r["window"] == 0 for r in windows)


def test_small_blocks_carry_the_open_window(odd_chat, monkeypatch):
    from logclinic.llm import blocks

    want = ordered((r["conv_id"], r["window"], r["text"]) for r in chat.format_windows(odd_chat, PATH).collect())
    monkeypatch.setattr(blocks.blocks, "__defaults__", (500,))
    assert ordered((r["conv_id"], r["window"], r["text"]) for r in chat.format_windows(odd_chat, PATH).collect()) == want


def test_query(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SMALL}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    rows += [(-1, 0, "user", "</s>[INST] ok [/INST]"), (-1, 1, "assistant", "</s>[INST] ok [/INST]")]
    found = QUERIES["op13_chat_windows"](spark, SMALL).collect()
    assert ordered(tuple(r)[:5] for r in found) == ordered(plain.chat_digests(rows))


def test_empty(spark):
    nothing = spark.createDataFrame([], SCHEMA)
    assert chat.format_windows(nothing, PATH).count() == 0 and chat.read_back_all(nothing, PATH).count() == 0


def test_short_segments_are_refused(odd_chat):
    with pytest.raises(ValueError):
        chat.format_windows(odd_chat, PATH, segment_bytes=1000)

"""Substring dedup and the near-duplicate join against plain Python."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from logclinic.llm import jaccard_join, substring_dedup
from logclinic.llm.components import components
from logclinic.llm.queries import QUERIES
from tests.llm import plain
from tests.llm.conftest import SMALL, ordered, pairs_of


@pytest.mark.parametrize("table", ["odd", "small"])
def test_substring_dedup(table, request):
    docs = request.getfixturevalue(table)
    found = substring_dedup.dedup_substrings(docs).collect()
    assert ordered(found) == ordered(plain.kept_words(pairs_of(docs)))


def test_substring_query(spark, small):
    want = [(d, n, r, plain.digest(t)) for d, n, r, t in plain.kept_words(pairs_of(small))]
    assert ordered(QUERIES["op1_substring_dedup"](spark, SMALL).collect()) == ordered(want)


def test_buckets_in_many_passes(monkeypatch, small):
    monkeypatch.setattr(substring_dedup, "SLAB_WORDS", 500)
    found = substring_dedup.dedup_substrings(small).collect()
    assert ordered(found) == ordered(plain.kept_words(pairs_of(small)))


def test_equal_hashes_of_different_windows():
    codes = np.array([1, 2, 3, 1, 2, 4, 1, 2, 3])
    places, new = substring_dedup.equal_windows(codes, np.zeros(9, np.uint64), np.array([0, 3, 6]), 3)
    groups = [g.tolist() for g in np.split(places, np.flatnonzero(new)[1:])]
    assert sorted(sorted(g) for g in groups) == [[0, 2], [1]]


@pytest.mark.parametrize("table", ["odd", "small"])
def test_near_duplicates(table, request):
    docs = request.getfixturevalue(table)
    found = jaccard_join.near_duplicates(docs).collect()
    assert ordered(found) == ordered(plain.near_components(pairs_of(docs)))


def test_chains_of_edits(spark):
    """Neighbours link, ends do not: components need more than one center."""
    own = [f"w{k}" for k in range(200)]
    rows = []
    for step in range(12):
        rows.append((100 - step, " ".join(own)))
        for k in range(step * 3, step * 3 + 3):
            own[k * 5] = f"new{step}.{k}"
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert ordered(jaccard_join.near_duplicates(docs).collect()) == ordered(plain.near_components(rows))


def test_overlap_bound_holds():
    pick = np.random.default_rng(1)
    for _ in range(200):
        x, y = (np.unique(pick.integers(0, 300, size).astype(np.uint64)) for size in pick.integers(1, 200, 2))
        assert jaccard_join.overlap_bound(x, y) >= len(np.intersect1d(x, y))


def test_keep_first(odd):
    kept = jaccard_join.keep_first(odd).collect()
    assert kept and kept[0].__fields__ == odd.columns
    ids = [r["doc_id"] for r in kept]
    components_of = {d: c for d, _, c in plain.near_components(pairs_of(odd))}
    assert {i for i in ids if i is not None} == {d for d, c in components_of.items() if d is not None and c == d}
    assert ids.count(7) == 0 and ids.count(0) == 1


def test_rows_that_share_an_id_or_have_none(spark):
    """A near copy under a null or repeated id takes no other text of that id along."""
    say = lambda name, n=60: " ".join(f"{name}{k}" for k in range(n))
    rows = [(5, say("a")), (None, say("a") + " tail"), (None, say("b")), (None, say("c")), (9, say("a") + " end"), (9, say("d")), (12, say("d") + " more"), (9, say("e"))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert ordered(jaccard_join.near_duplicates(docs).collect()) == ordered(plain.near_components(rows))
    kept = {tuple(r) for r in jaccard_join.keep_first(docs).collect()}
    assert kept == {(5, say("a")), (None, say("b")), (None, say("c")), (9, say("d")), (9, say("e"))}


def test_components(spark):
    links = spark.createDataFrame([(k, k + 1) for k in range(1, 40)] + [(100, 101), (7, 7)], "a long, b long")
    found = {r["id"]: r["component"] for r in components(links).collect()}
    assert found == {**{k: 1 for k in range(1, 41)}, 100: 100, 101: 100}


def test_empty_tables(empty):
    assert substring_dedup.dedup_substrings(empty).count() == 0
    assert jaccard_join.near_duplicates(empty).count() == 0
    assert jaccard_join.keep_first(empty.withColumn("more", F.lit(1))).count() == 0

"""Merkle proofs against plain Python."""

from __future__ import annotations

import zlib
from hashlib import sha256

import pytest
from pyspark.sql import functions as F

from logclinic.llm.merkle import COLUMNS, fold, manifest, prove
from logclinic.llm.queries import QUERIES
from tests.llm import plain
from tests.llm.conftest import SMALL, ordered


@pytest.mark.parametrize(("table", "stride"), [("odd", 1), ("odd", 8), ("small", 3), ("small", 8)])
def test_proofs(table, stride, request):
    docs = request.getfixturevalue(table)
    want = plain.merkle([tuple(r) for r in docs.select(*COLUMNS).collect()])
    proved = prove(docs, stride).withColumn("folded", fold(F.col("leaf"), F.col("siblings"), F.col("path"))).collect()
    assert all(r["folded"] == r["root"] for r in proved)
    found = [(r["doc_id"], r["leaf"], r["top"], r["root"], sha256("".join(r["siblings"]).encode()).hexdigest(), r["siblings"]) for r in proved]
    assert ordered(found) == ordered(want)


def test_tampering_is_seen(spark):
    found = QUERIES["op12_merkle"](spark, SMALL).collect()
    assert {r["doc_id"] for r in found if not r["verified"]} == {r["doc_id"] for r in found if zlib.crc32(str(r["doc_id"]).encode()) % 7 == 0}


def test_any_change_breaks_the_proof(small):
    """A proof holds for its own leaf and path only."""
    proved = prove(small, 4)
    other = F.sha2(F.concat("leaf", F.lit("x")), 256)
    assert proved.filter(fold(other, F.col("siblings"), F.col("path")) == F.col("root")).count() == 0
    assert proved.filter((F.size("siblings") > 0) & (fold(F.col("leaf"), F.col("siblings"), F.col("path").bitwiseXOR(F.lit(1))) == F.col("root")) & (F.col("siblings")[0] != "")).count() == 0


def test_one_group_and_one_row(spark, small):
    one = small.filter("doc_id = 3")
    row = prove(one).first()
    assert row["siblings"] == [] and row["leaf"] == row["top"] == row["root"]
    english = small.filter("lang = 'en'")
    assert manifest(english).first()["root"] == manifest(english).first()["top"]
    assert sum(r["size"] for r in manifest(small, 2).collect()) == small.count()


def test_places_do_not_hang_on_the_layout(small):
    parts = [prove(small.repartition(n), 4).select("doc_id", "path", "root").collect() for n in (1, 7)]
    assert ordered(parts[0]) == ordered(parts[1])


def test_a_third_of_the_rows_alike(spark):
    rows = [(7, "same", "en", None, 4)] * 40 + [(k, f"text {k}", None, "s", None) for k in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    want = plain.merkle([tuple(r) for r in docs.select(*COLUMNS).collect()])
    found = [(r["doc_id"], r["leaf"], r["top"], r["root"], sha256("".join(r["siblings"]).encode()).hexdigest(), r["siblings"]) for r in prove(docs, 3).collect()]
    assert ordered(found) == ordered(want)


def test_empty(empty):
    assert prove(empty).count() == 0 and manifest(empty).count() == 0

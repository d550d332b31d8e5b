from __future__ import annotations

import random

import pytest
from pyspark.sql import DataFrame, SparkSession

SMALL = "/root/testdata/sf0.001"

ODD_SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, n int, hash long, bucket int, label string, score double"


def odd_rows() -> list[tuple]:
    """Nulls, empty texts, repeated rows and ids, ties, a very long text, copies, near copies and shared passages."""
    pick = random.Random(3)
    vocabulary = [f"{a}{b}" for a in "the of in ba ce di fo gu".split() for b in ("", "n", "rs", "té", "lix", "mo")]
    say = lambda n: " ".join(pick.choices(vocabulary, k=n))
    base, passage = say(120), say(40)
    edited = base.split(" ")
    edited[7] = "changed"
    texts: list[str | None] = [
        None, "", "   \n\t ", "one", "one two three", "One TWO three", base, base, base.upper(), " ".join(edited), base + " tail of words",
        f"{say(30)} {passage} {say(25)}", f"{passage}\n{say(60)}", f"{say(10)}\n{passage} {passage}", say(20_000), "a" * 30_000, "x\x00y 　 \x85 z\x1c ok", "same line\nsame line\nsame line",
        "Ünïcödé “quotes” and 😀 emoji " * 9, "mail me: joe.b@mail.example.com or +1 (555) 555-0100, card 4111 1111 1111 1111 at 10.0.0.255", '<|endoftext|> in a text <|endoftext|>', "word " * 400,
    ]
    rows = [(k, t, ("en", "fr", None, "xx")[k % 4], ("a.example.com", None, "", "b.example.fr")[k % 4], len(t or ""), 1, 2, 3, "x", 0.5) for k, t in enumerate(texts)]
    rows += [rows[6], rows[6], (6, "another text under a known id " * 8, "en", None, 1, 1, 2, 3, "y", None), (None, base, None, None, None, None, None, None, None, None), (None, None, None, None, None, None, None, None, None, None)]
    return rows


@pytest.fixture(scope="session")
def odd(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(odd_rows(), ODD_SCHEMA).repartition(5, "doc_id")


@pytest.fixture(scope="session")
def empty(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], ODD_SCHEMA)


@pytest.fixture(scope="session")
def small(spark: SparkSession) -> DataFrame:
    return spark.read.parquet(f"{SMALL}/documents.parquet")


def pairs_of(docs: DataFrame) -> list[tuple]:
    return [(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()]


def ordered(rows) -> list[tuple]:
    return sorted((tuple(r) for r in rows), key=lambda r: tuple((x is None, str(type(x)), x) for x in r))

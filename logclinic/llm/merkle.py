"""A Merkle manifest of a dataset: one tree per group of rows, one tree over the groups, and a proof for every row.

Checkpoint and recompute: of each tree only every `stride`-th level is written.  A proof needs nodes in between; the
aligned subtree below each stored node is hashed again from its stored descendants, gives its rows their siblings and
is forgotten.  A subtree has 2 ** stride nodes at most, so groups of any size are spread over tasks evenly, and the
levels above a subtree are proved once for all of its rows.

A leaf is the digest of the row's columns, each as `-` if null, else its UTF-8 length, `:` and its value.  In a tree,
every two neighbours become the digest of their joined hex digests, a last single one the digest of its own, until one
node remains.  Leaves ascend by id (null first, rows of one id by leaf), groups by name (null first, bytewise).  Equal
rows are alike and get neighbouring places.  A table without rows has no trees; other columns are ignored.
"""

from __future__ import annotations

from hashlib import sha256

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logclinic.llm.positions import positioned
from logclinic.llm.staging import staged

#: Levels between two stored ones.
STRIDE = 8
COLUMNS = ("doc_id", "source", "lang", "n_chars", "text")


def leaf(columns: dict[str, Column] | None = None) -> Column:
    """The digest of a row; `columns` replaces some of the values."""
    values = [(columns or {}).get(name, F.col(name)).cast("string") for name in COLUMNS]
    return F.sha2(F.concat(*(F.coalesce(F.concat(F.octet_length(v).cast("string"), F.lit(":"), v), F.lit("-")) for v in values)), 256)


def fold(start: Column, siblings: Column, path: Column) -> Column:
    """The root that a leaf and its siblings give; bit k of the path tells that the k-th sibling stands to the left."""
    turned = F.transform(siblings, lambda s, k: F.struct(s.alias("s"), F.call_function("shiftright", path, k).bitwiseAND(F.lit(1).cast("long")).alias("left")))
    return F.aggregate(turned, start, lambda held, x: F.sha2(F.when(x["left"] == 1, F.concat(x["s"], held)).otherwise(F.concat(held, x["s"])), 256))


def _parents(digests: list[str]) -> list[str]:
    return [sha256("".join(digests[i : i + 2]).encode()).hexdigest() for i in range(0, len(digests), 2)]


def _lifted(nodes: DataFrame, level: int, stride: int) -> DataFrame:
    """The nodes `stride` levels up, or the top of trees that end before."""

    def lift(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by("at")
        digests, levels = rows["digest"].to_pylist(), rows["levels"][0].as_py()
        for _ in range(min(stride, levels - level)):
            digests = _parents(digests)
        return pa.table([rows["tree"][:1], pa.array([rows["at"][0].as_py() >> stride], pa.int64()), digests[:1], rows["levels"][:1]], ["tree", "at", "digest", "levels"])

    keyed = nodes.select("tree", "at", "digest", "levels").withColumn("block", F.shiftright("at", stride))
    return keyed.groupBy("tree", "block").applyInArrow(lift, "tree long, at long, digest string, levels int")


def _spread(nodes: DataFrame, above: DataFrame, level: int, stride: int) -> DataFrame:
    """The nodes with their siblings up to the root: those of their own subtree, regenerated, and then its proof from `above`."""

    def spread(rows: pa.Table, tops: pa.Table) -> pa.Table:
        rows = rows.sort_by("at")
        digests, levels = rows["digest"].to_pylist(), rows["levels"][0].as_py()
        found: list[list[str]] = [[] for _ in digests]
        for step in range(min(stride, levels - level)):
            for k, own in enumerate(found):
                other = k >> step ^ 1
                own.append(digests[other] if other < len(digests) else "")
            digests = _parents(digests)
        rest = tops["siblings"][0].as_py()
        rows = rows.append_column("siblings", pa.array([own + rest for own in found], pa.list_(pa.string())))
        for name in ("top", "root", "turns"):
            rows = rows.append_column(name, pa.array([tops[name][0].as_py()] * len(rows), tops[name].type))
        return rows.drop_columns(["block"])

    keyed = nodes.withColumn("block", F.shiftright("at", stride)).groupBy("tree", "block")
    tops = above.select("tree", F.col("at").alias("block"), "siblings", "top", "root", "turns").groupBy("tree", "block")
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in nodes.schema) + ", siblings array<string>, top string, root string, turns long"
    return keyed.cogroup(tops).applyInArrow(spread, schema)


def _stored_levels(leaves: DataFrame, stride: int, label: str) -> list[DataFrame]:
    """Every `stride`-th level, the leaves first; the last one holds the top of each tree."""
    height = leaves.agg(F.max("levels")).first()[0] or 0
    stored = [leaves]
    for level in range(0, height, stride):
        stored.append(staged(_lifted(stored[-1], level, stride), f"{label}-{level + stride}"))
    return stored


def _proved(stored: list[DataFrame], above: DataFrame, stride: int, label: str) -> DataFrame:
    """The leaves with their siblings, from the proofs of the tops downward."""
    for k in range(len(stored) - 2, -1, -1):
        above = _spread(stored[k], above, k * stride, stride)
        if k:
            above = staged(above, f"{label}-proofs")
    return above


def _levels(n: Column) -> Column:
    """Levels above the leaves of a tree of n leaves."""
    return F.when(n > 1, F.length(F.bin(n - 1))).otherwise(0).cast("int")


def _forest(docs: DataFrame, stride: int, carry: dict[str, Column]) -> tuple[list[DataFrame], DataFrame]:
    """The stored levels of all groups' trees, and one proved row per group: tree, name, size, top, root, siblings, turns."""
    narrow = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("lang").cast("string").alias("name"), leaf().alias("digest"), *(c.alias(k) for k, c in carry.items()))
    # written once before it is sorted: finding the ranges must not read the texts again
    placed = positioned(staged(narrow, "leaves"), [F.col("name").asc_nulls_first(), F.col("doc_id").asc_nulls_first(), F.col("digest")], [], "placed")
    # a tree is known by the place of its first leaf
    trees = staged(placed.groupBy("name").agg(F.min("at").alias("tree"), F.count(F.lit(1)).alias("size")).withColumn("levels", _levels(F.col("size"))), "trees")
    named = trees.select(F.col("name").alias("_name"), "tree", "levels")
    leaves = placed.join(named, F.col("name").eqNullSafe(F.col("_name"))).drop("_name").withColumn("at", F.col("at") - F.col("tree"))
    stored = _stored_levels(leaves, stride, "nodes")
    tops = trees.join(stored[-1].select("tree", F.col("digest").alias("top")), "tree")
    ranked = positioned(tops, [F.col("tree")], [], "tops")
    height = _levels(F.lit(ranked.count()))
    upper = ranked.select(F.lit(0).cast("long").alias("tree"), "at", F.col("top").alias("digest"), height.alias("levels"), F.col("tree").alias("group"), "name", "size", F.col("levels").alias("own_levels"))
    stored_upper = _stored_levels(upper, stride, "upper")
    root = [F.array().cast("array<string>").alias("siblings"), F.col("digest").alias("top"), F.col("digest").alias("root"), F.lit(0).cast("long").alias("turns")]
    if len(stored_upper) == 1:  # a single group: its root is the root
        proved = upper.select("*", *root)
    else:
        proved = _proved(stored_upper, stored_upper[-1].select("tree", "at", *root), stride, "upper")
    turns = F.call_function("shiftleft", F.col("at"), F.col("own_levels"))
    return stored, proved.select(F.col("group").alias("tree"), "name", "size", F.col("digest").alias("top"), "root", "siblings", turns.alias("turns"))


def manifest(docs: DataFrame, stride: int = STRIDE) -> DataFrame:
    """name (of the group, `lang`), size, top (the group's root), root (of the dataset), siblings (up to the root)."""
    return _forest(docs, stride, {})[1].select("name", "size", "top", "root", "siblings")


def prove(docs: DataFrame, stride: int = STRIDE, carry: dict[str, Column] | None = None) -> DataFrame:
    """doc_id, name, leaf, siblings (hex digests from the leaf up, '' where a node has none), path, top, root.

    `fold` turns a leaf, its siblings and its path into a root again.  `carry`: further columns, from the row's own.
    """
    carry = carry or {}
    stored, groups = _forest(docs, stride, carry)
    above = groups.select("tree", F.lit(0).cast("long").alias("at"), "siblings", "top", "root", "turns")
    if len(stored) == 1:  # no tree has a second leaf
        rows = stored[0].join(above.drop("at"), "tree")
    else:
        rows = _proved(stored, above, stride, "nodes")
    return rows.select("doc_id", "name", F.col("digest").alias("leaf"), "siblings", (F.col("at") + F.col("turns")).alias("path"), "top", "root", *carry)

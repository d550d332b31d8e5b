"""N-gram Jaccard join: rare-first prefix filtering with length, positional and suffix filters.

1. One pass over the texts builds each document's set of shingle hashes.  Postings (hash, document) travel packed to the
   bucket of their hash; documents with equal sets are one class, named by the digest of the set.
2. A bucket sees all classes of a hash, so it knows the exact frequency.  Only hashes of two or more classes go on: the
   others come first in the rare-first order and can match nothing.
3. The prefix of a class, |x| - ceil(t |x|) + 1 shingles in rare-first order, mostly lies among its unique shingles; what is
   left of it are the join keys.
4. Near copies meet under hundreds of keys.  Each class is therefore first compared with the most typical class under
   its commonest keys, and the links found are closed to components.  Then only classes of different components that share a
   key are compared, after length and positional filter.  So every link between components is found, while the pairs
   inside a group of near copies are never written out.
5. A pair is verified once: a suffix filter bounds the overlap by parts of the sets, then the sets are intersected.

Null and empty texts have no shingle and no link.  A component is named by its smallest id at the end only, so rows with
equal or null ids are told apart by their sets; a null id counts as greater than all ids and is given back as null.  Other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logclinic.llm.blocks import blocks, coded, hashes_of, ranges, rolled, words_of
from logclinic.llm.components import components
from logclinic.llm.packs import packed, steps, unpacked
from logclinic.llm.staging import prepare, shuffle_partitions, staged

WORDS = 5
#: Similarity in hundredths.
PERCENT = 75
#: Commonest prefix keys under which a class is compared with the most typical class first.
STAR_KEYS = 3
NULL_ID = (1 << 63) - 1

POSTED = "bucket int, payload binary, doc_id long, text_key long, n int, class binary"
SHARED = "doc_id long, text_key long, n int, class binary, hash long, frequency int"


def shingle_sets(texts: pa.Array, width: int) -> tuple[np.ndarray, np.ndarray]:
    """The sorted distinct shingle hashes of all texts one after the other, and their number per text."""
    words, counts = words_of(pc.ascii_lower(texts.cast(pa.large_string())))
    codes, distinct = coded(words)
    hashes = hashes_of(distinct)[codes] if len(codes) else np.zeros(0, np.uint64)
    windows = rolled(hashes, width)
    heads = np.cumsum(counts) - counts
    sets = []
    for head, count in zip(heads.tolist(), counts.tolist(), strict=True):
        if count >= width:
            own = np.sort(windows[head : head + count - width + 1])
            sets.append(own[np.concatenate([[True], own[1:] != own[:-1]])])
        elif count:
            sets.append(np.array([xxhash.xxh3_64_intdigest(hashes[head : head + count].tobytes(), seed=count)], np.uint64))
        else:
            sets.append(np.zeros(0, np.uint64))
    return np.concatenate(sets) if sets else np.zeros(0, np.uint64), np.fromiter(map(len, sets), np.int64, len(sets))


def names_of(digests: np.ndarray, mask: np.ndarray | None = None) -> pa.Array:
    """Digests of two longs each as binary values; null where the mask says so."""
    named = pa.Array.from_buffers(pa.binary(16), len(digests), [None, pa.py_buffer(np.ascontiguousarray(digests).tobytes())]).cast(pa.binary())
    return named if mask is None else pc.if_else(pa.array(mask), pa.scalar(None, pa.binary()), named)


def _post(width: int, n_buckets: int):
    """Rows of each document, and packed postings of the classes of a block."""

    def post(batches):
        for block in blocks(batches):
            hashes, counts = shingle_sets(block.column("text"), width)
            ids = block.column("doc_id").to_numpy(zero_copy_only=False)
            heads = np.cumsum(counts) - counts
            digests = np.zeros((len(ids), 2), np.int64)
            first: dict[bytes, int] = {}
            for row in np.argsort(ids, kind="stable").tolist():
                if counts[row]:
                    digest = hashlib.blake2b(hashes[heads[row] : heads[row] + counts[row]].tobytes(), digest_size=16).digest()
                    digests[row] = np.frombuffer(digest, np.int64)
                    first.setdefault(digest, row)
            some = counts > 0
            yield _rows(np.zeros(len(ids), np.int32), [None] * len(ids), ids, block.column("text_key"), counts, names_of(digests, ~some))
            chosen = np.array(sorted(first.values()), np.int64)
            if not len(chosen):
                continue
            posted = hashes[ranges(heads[chosen], counts[chosen])]
            owner = np.repeat(np.arange(len(chosen)), counts[chosen])
            order = np.argsort(posted, kind="stable")
            posted, owner = posted[order], owner[order]
            bucket = ((posted >> np.uint64(40)) * np.uint64(n_buckets)) >> np.uint64(24)
            borders = np.searchsorted(bucket, np.arange(n_buckets + 1, dtype=np.uint64))
            names, blobs = [], []
            for b in range(n_buckets):
                part = slice(borders[b], borders[b + 1])
                if part.start < part.stop:
                    own, index = np.unique(owner[part], return_inverse=True)
                    rows = chosen[own]
                    index = index.astype(np.uint16 if len(own) < 1 << 16 else np.uint32)
                    blobs.append(packed(steps(posted[part]), index, digests[rows, 0], digests[rows, 1], counts[rows].astype(np.uint32)))
                    names.append(b)
            for at in range(0, len(names), 16):
                some = names[at : at + 16]
                empty = pa.nulls(len(some), pa.int64())
                yield _rows(np.array(some, np.int32), blobs[at : at + 16], empty, empty, None, pa.nulls(len(some), pa.binary()))

    def _rows(bucket, payload, ids, text_key, n, names):
        if n is not None and len(ids):
            bucket = (ids.view(np.uint64) % np.uint64(n_buckets)).astype(np.int32)
        return pa.RecordBatch.from_arrays(
            [pa.array(bucket), pa.array(payload, pa.binary()), pa.array(ids, pa.int64()), text_key, pa.nulls(len(bucket), pa.int32()) if n is None else pa.array(n, pa.int32()), names],
            ["bucket", "payload", "doc_id", "text_key", "n", "class"],
        )

    return post


def _count(batches):
    """One bucket: frequencies of its hashes; postings of the hashes that two or more classes have."""
    parts, classes, n_classes = [], [], 0
    for batch in batches:
        is_row = pc.is_null(batch.column("payload"))
        rows = batch.filter(is_row)
        if rows.num_rows:
            yield _shared(rows.column("doc_id"), rows.column("text_key"), rows.column("n"), rows.column("class"), pa.nulls(rows.num_rows, pa.int64()), pa.nulls(rows.num_rows, pa.int32()))
        for blob in batch.column("payload").filter(pc.invert(is_row)).to_pylist():
            moves, index, digest_a, digest_b, n = unpacked(blob)
            parts.append((np.cumsum(moves), (index.astype(np.uint32) + np.uint32(n_classes))))
            classes.append((digest_a, digest_b, n.astype(np.int32)))
            n_classes += len(n)
    if not parts:
        return
    hashes, owners = (np.concatenate([p[k] for p in parts]) for k in range(2))
    parts.clear()
    order = np.argsort(hashes)
    hashes = hashes[order]
    new = np.concatenate([[True], hashes[1:] != hashes[:-1]])
    several = ~(new & np.concatenate([new[1:], [True]]))
    hashes, owners = hashes[several], owners[order[several]]
    del order, new, several
    digest_a, digest_b, n = (np.concatenate([c[k] for c in classes])[owners] for k in range(3))
    order = np.lexsort((digest_b, digest_a, hashes))
    hashes, digest_a, digest_b, n = hashes[order], digest_a[order], digest_b[order], n[order]
    new_hash = np.concatenate([[True], hashes[1:] != hashes[:-1]])[: len(hashes)]
    new_class = new_hash | np.concatenate([[True], (digest_a[1:] != digest_a[:-1]) | (digest_b[1:] != digest_b[:-1])])[: len(hashes)]
    group = np.cumsum(new_hash) - 1
    frequency = np.bincount(group, weights=new_class).astype(np.int32) if len(group) else np.zeros(0, np.int32)
    kept = new_class & (frequency[group] >= 2)
    hashes, digests, n, frequency = hashes[kept], np.stack([digest_a[kept], digest_b[kept]], axis=1), n[kept], frequency[group[kept]]
    for at in range(0, len(hashes), 1 << 17):
        part = slice(at, at + (1 << 17))
        none = pa.nulls(len(n[part]), pa.int64())
        yield _shared(none, none, pa.array(n[part]), names_of(digests[part]), pa.array(hashes[part].view(np.int64)), pa.array(frequency[part]))


def _shared(ids, text_key, n, names, hashes, frequency):
    return pa.RecordBatch.from_arrays([ids, text_key, n, names, hashes, frequency], ["doc_id", "text_key", "n", "class", "hash", "frequency"])


def overlap_bound(x: np.ndarray, y: np.ndarray, parts: int = 8) -> int:
    """Suffix filter: sorted sets cut at the same values can share no more than the smaller of each two parts."""
    pivots = y[np.arange(1, parts) * len(y) // parts]
    in_x = np.diff(np.concatenate([[0], np.searchsorted(x, pivots), [len(x)]]))
    in_y = np.diff(np.concatenate([[0], np.searchsorted(y, pivots), [len(y)]]))
    return int(np.minimum(in_x, in_y).sum())


def _verify(percent: int):
    def verify(batches):
        for batch in batches:
            sides = []
            for name in ("set_a", "set_b"):
                column = batch.column(name)
                offsets = column.offsets.to_numpy()
                sides.append((column.values.to_numpy(zero_copy_only=False), offsets))
            n_a, n_b = (batch.column(x).to_numpy(zero_copy_only=False).astype(np.int64) for x in ("n_a", "n_b"))
            linked = np.zeros(batch.num_rows, bool)
            for k in range(batch.num_rows):
                x, y = (values[offsets[k] : offsets[k + 1]] for values, offsets in sides)
                if len(x) > len(y):
                    x, y = y, x
                total = int(n_a[k] + n_b[k])
                if overlap_bound(x, y) * (100 + percent) < percent * total:
                    continue
                at = np.searchsorted(y, x)
                at[at == len(y)] = 0
                both = int(np.count_nonzero(y[at] == x))
                linked[k] = both * (100 + percent) >= percent * total
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b")], ["a", "b"]).filter(pa.array(linked))

    return verify


def _verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs whose sets are similar; each set is fetched by a join of its own, the commoner side first."""
    side = lambda s: sets.select(F.col("class").alias(s), F.col("n").alias(f"n_{s}"), F.col("hashes").alias(f"set_{s}"))
    return pairs.join(side("b"), "b").join(side("a"), "a").select("a", "b", "n_a", "n_b", "set_a", "set_b").mapInArrow(_verify(percent), "a binary, b binary")


def _members(docs: DataFrame, width: int = WORDS, percent: int = PERCENT, doc_id: str = "doc_id", text: str = "text") -> tuple[DataFrame, DataFrame]:
    """doc_id, text_key, n, class of every row, and class, component (its smallest class) of every class."""
    spark = docs.sparkSession
    prepare(spark)
    rows = docs.select(F.coalesce(F.col(doc_id).cast("long"), F.lit(NULL_ID)).alias("doc_id"), F.col(text).cast("string").alias("text"), F.xxhash64(F.col(text).cast("string")).alias("text_key"))
    n_buckets = shuffle_partitions(spark)
    posted = rows.mapInArrow(_post(width, n_buckets), POSTED).repartitionById(n_buckets, "bucket")
    found = staged(posted.mapInArrow(_count, SHARED), "postings")
    members = found.filter("hash IS NULL").select("doc_id", "text_key", "n", "class")

    # a class can only link if enough of its shingles are shared at all
    least = F.ceil(F.col("n") * percent / 100).cast("int")
    shared = (
        found.filter("hash IS NOT NULL")
        .groupBy("class", "n")
        .agg(F.array_sort(F.collect_list(F.struct("frequency", "hash"))).alias("keys"))
        .filter(F.size("keys") >= least)
        .select(
            "class", "n",
            F.sort_array("keys.hash").alias("hashes"),
            F.slice("keys.hash", F.lit(1), F.size("keys") - least + 1).alias("prefix"),
            (F.col("n") - F.size("keys")).alias("n_unique"),
            (F.aggregate("keys", F.lit(0.0), lambda total, k: total + k["frequency"]) / F.col("n")).alias("commonness"),
        )
    )
    sets = staged(shared, "sets")
    entries = sets.select("class", "n", "n_unique", "commonness", F.size("prefix").alias("n_keys"), F.posexplode("prefix").alias("at", "hash"))

    star = _verified(staged(_star_pairs(entries, percent), "pairs"), sets, percent)
    star_links = staged(star, "links")
    labels = components(star_links)
    across = _verified(staged(_cross_pairs(entries, labels, percent), "pairs"), sets, percent)
    across_links = staged(across, "links")
    if not across_links.isEmpty():
        labels = components(star_links.union(across_links))

    classes = members.filter("class IS NOT NULL").select("class").distinct()
    return members, classes.join(labels.withColumnRenamed("id", "class"), "class", "left").select("class", F.coalesce("component", "class").alias("component"))


def near_duplicates(docs: DataFrame, width: int = WORDS, percent: int = PERCENT, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id of every row."""
    members, classes = _members(docs, width, percent, doc_id, text)
    known = staged(members.groupBy("class").agg(F.min("doc_id").alias("first_id")).join(classes, "class"), "classes")
    firsts = known.groupBy("component").agg(F.min("first_id").alias("component_id"))
    named = staged(known.join(firsts, "component").select("class", "component_id"), "classes")
    given = lambda c: F.when(F.col(c) != NULL_ID, F.col(c))
    return members.join(named, "class", "left").select(
        given("doc_id").alias("doc_id"), F.col("n").cast("long").alias("n_shingles"), F.coalesce(given("component_id"), given("doc_id")).alias("component_id")
    )


def keep_first(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", **parameters) -> DataFrame:
    """One document of each component, the one with the smallest id, with all its columns; equal rows stay once.

    Rows with one id, or none, and different texts are told apart by their texts.
    """
    kind = docs.schema[doc_id].dataType
    members, classes = _members(docs, doc_id=doc_id, text=text, **parameters)
    row = F.min(F.struct("doc_id", "text_key")).alias("row")
    of_class = members.filter("class IS NOT NULL").groupBy("class").agg(row)
    of_component = of_class.join(classes, "class").select("component", "row.*").groupBy("component").agg(row).select("row.*")
    first = of_component.union(members.filter("class IS NULL").select("doc_id", "text_key")).distinct().toDF("__key", "__text")
    keyed = docs.withColumn("__key", F.coalesce(F.col(doc_id).cast("long"), F.lit(NULL_ID))).withColumn("__text", F.xxhash64(F.col(text).cast("string")))
    kept = keyed.join(first, ["__key", "__text"], "left_semi")
    return kept.dropDuplicates(["__key", "__text"]).select(*(F.col(f"`{c}`").cast(kind) if c == doc_id else F.col(f"`{c}`") for c in docs.columns))


def _similar_lengths(x, y, percent: int):
    return F.least(x, y) * 100 >= F.greatest(x, y) * percent


def _star_pairs(entries: DataFrame, percent: int) -> DataFrame:
    """Each class with the most typical class under its commonest keys; keys are salted, as many classes may share one.

    The most typical class of a key is the one whose shingles are commonest on average: among edited copies of a text,
    the least edited one, which links to most others.
    """
    salted = entries.withColumn("salt", F.pmod(F.xxhash64("class"), F.lit(16)))
    typical = F.max(F.struct("commonness", "class", "n"))
    per_salt = salted.groupBy("hash", "salt").agg(typical.alias("own"))
    centers = per_salt.join(per_salt.groupBy("hash").agg(F.max("own").alias("center")), "hash").select("hash", "salt", F.col("center.class").alias("b"), F.col("center.n").alias("n_b"))
    late = salted.filter(F.col("at") >= F.col("n_keys") - STAR_KEYS)
    met = late.join(centers, ["hash", "salt"]).filter((F.col("class") != F.col("b")) & _similar_lengths(F.col("n"), F.col("n_b"), percent))
    return met.select(F.least("class", "b").alias("a"), F.greatest("class", "b").alias("b")).distinct()


def _cross_pairs(entries: DataFrame, labels: DataFrame, percent: int) -> DataFrame:
    """Pairs of classes of different components that share a prefix key and pass the length and positional filter."""
    labelled = entries.join(labels.withColumnRenamed("id", "class"), "class", "left").select(
        "hash", "class", "n", (F.col("n_unique") + F.col("at")).alias("place"), F.coalesce("component", "class").alias("component")
    )
    # of two components under a key, at most one is the largest there: one side of each pair is outside of it
    sizes = labelled.groupBy("hash", "component").agg(F.count("*").alias("size"))
    largest = sizes.groupBy("hash").agg(F.max(F.struct("size", "component")).alias("largest"), F.count("*").alias("n_components"))
    mixed = staged(largest.filter("n_components > 1").select("hash", F.col("largest.component").alias("largest")), "keys")
    met = staged(labelled.join(mixed, "hash"), "entries")
    side = lambda s, rows: rows.select("hash", F.col("component").alias(f"c_{s}"), "largest", F.col("class").alias(s), F.col("n").alias(f"n_{s}"), F.col("place").alias(f"p_{s}"))
    one = side("a", met.filter("component != largest")).drop("largest")
    two = side("b", met)
    n_a, n_b, p_a, p_b = (F.col(x) for x in ("n_a", "n_b", "p_a", "p_b"))
    reachable = F.least(n_a - p_a, n_b - p_b)
    near = _similar_lengths(n_a, n_b, percent) & (reachable * (100 + percent) >= (n_a + n_b) * percent)
    once = (F.col("c_a") != F.col("c_b")) & ((F.col("c_b") == F.col("largest")) | (F.col("a") < F.col("b")))
    pairs = one.join(two.withColumnRenamed("hash", "hash_b"), (F.col("hash") == F.col("hash_b")) & once & near)
    return pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()

"""Language identification by Bayesian evidence fusion.

Text: byte trigrams of words, hashed to a table of fixed size, with counts per language over all texts that declare one.
Markup: the language that the page or the record declares, right with a fixed probability.
Address: the language of a country suffix, if any.
Host: how the texts of a host were read by text alone, smoothed towards its domain, and that towards all texts; these
counts are grouped aggregations.
The log evidences add up; the most probable language wins, and a text is rejected if none is probable enough.

Null and empty texts have no evidence of their own and are rejected as `und`.  Rows with equal ids are judged one by one.
Texts without a host share one.  Other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logclinic.llm.blocks import blocks, coded, list_array, mixed, words_of
from logclinic.llm.staging import prepare, staged
from logclinic.llm.tokens import per_text

LANGUAGES = ("en", "fr", "de", "es")
UNKNOWN = "und"
TABLE = 1 << 14
#: Trigrams of a text are far from independent: their log likelihood counts in part.
TEMPER = 0.2
DECLARED_RIGHT = 0.9
SUFFIX_RIGHT = 0.8
#: Texts that a host's and a domain's prior are worth.
HOST_WEIGHT = 20.0
UNKNOWN_PRIOR = 0.01
LEAST_PROBABILITY = 0.5
#: Bytes of text judged together: a worker then peaks at 255 MB instead of 414.
BLOCK_BYTES = 4 << 20
#: Entities that letters and common signs are written as; `amp` last, so that nothing is decoded twice.
ENTITIES = {
    "nbsp": " ", "lt": "<", "gt": ">", "quot": '"', "#39": "'", "auml": "ä", "ouml": "ö", "uuml": "ü", "Auml": "Ä", "Ouml": "Ö", "Uuml": "Ü", "szlig": "ß",
    "agrave": "à", "acirc": "â", "aacute": "á", "ccedil": "ç", "eacute": "é", "egrave": "è", "ecirc": "ê", "iacute": "í", "ntilde": "ñ", "oacute": "ó", "ocirc": "ô",
    "uacute": "ú", "ugrave": "ù", "amp": "&",
}
SUFFIXES = {"uk": "en", "us": "en", "au": "en", "ie": "en", "fr": "fr", "de": "de", "at": "de", "es": "es", "mx": "es", "ar": "es"}


def trigram_slots(words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Table slots of the byte trigrams of each word between two spaces, and how many each word has."""
    joined = np.frombuffer((" " + "".join(f"{w} " for w in words.to_pylist())).lower().encode(), np.uint8).astype(np.uint64)
    if len(joined) < 3:
        return np.zeros(0, np.int64), np.zeros(len(words), np.int64)
    grams = joined[:-2] << np.uint64(16) | joined[1:-1] << np.uint64(8) | joined[2:]
    spaces = np.flatnonzero(joined == 32)
    lengths = np.diff(spaces) - 1
    slots = (mixed(grams) % np.uint64(TABLE)).astype(np.int64)
    # words with digits (numbers, keys) tell nothing; their trigrams are left out below
    # a trigram belongs to the word it starts in or before; those that start at a word's last letter do not count
    inside = np.ones(len(grams), bool)
    inside[spaces[1:-1] - 1] = False
    plain = ~pc.match_substring_regex(words, "[0-9]").to_numpy(zero_copy_only=False)
    return slots[inside][np.repeat(plain, lengths)], lengths * plain


def _count(languages: tuple[str, ...]):
    """Trigrams by declared language."""

    def count(batches):
        total = np.zeros((len(languages), TABLE))
        for block in blocks(batches, BLOCK_BYTES):
            words, counts = words_of(block.column("text"))
            codes, distinct = coded(words)
            if not len(codes):
                continue
            slots, n_slots = trigram_slots(distinct)
            place = {name: k for k, name in enumerate(languages)}
            own = np.array([place[x] for x in block.column("declared").to_pylist()], np.int64)
            of_word = np.repeat(own, counts)
            for k in range(len(languages)):
                uses = np.bincount(codes[of_word == k], minlength=len(distinct))
                total[k] += np.bincount(slots, weights=np.repeat(uses, n_slots), minlength=TABLE)
        language, slot = np.nonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(language, pa.int32()), pa.array(slot, pa.int32()), pa.array(total[language, slot].astype(np.int64))], ["language", "slot", "n"])

    return count


def _score(model: np.ndarray):
    """Log likelihood of each text under each language and under the even model, tempered."""

    def score(batches):
        for block in blocks(batches, BLOCK_BYTES):
            words, counts = words_of(block.column("text"))
            codes, distinct = coded(words)
            slots, n_slots = trigram_slots(distinct)
            columns = [TEMPER * per_text(per_text(row[slots], n_slots)[codes], counts) for row in model]
            flat = np.stack(columns, axis=1).reshape(-1)
            likelihoods = list_array(flat, np.full(block.num_rows, len(model)), pa.float64())
            rest = [name for name in block.schema.names if name != "text"]
            yield pa.RecordBatch.from_arrays([*(block.column(n) for n in rest), pa.array(counts), likelihoods], [*rest, "n_words", "likelihoods"])

    return score


def page_text(html: Column) -> Column:
    """What a page shows: without head, scripts, styles, comments and menus, tags as spaces, entities as letters."""
    shown = F.regexp_replace(html, r"(?is)<!--.*?-->", " ")
    shown = F.regexp_replace(shown, r"(?is)<(head|script|style|template|nav)\b[^>]*>.*?</\1\s*>", " ")
    shown = F.regexp_replace(shown, r"(?s)<[a-zA-Z/!?][^>]*>", " ")
    for entity, letter in ENTITIES.items():
        shown = F.replace(shown, F.lit(f"&{entity};"), F.lit(letter))
    return shown


def documents_and_pages(docs: DataFrame, pages: DataFrame) -> DataFrame:
    """Both tables as rows that `identify` can judge together: doc_id, page_id, text, source, lang, html, url.

    Pages take the ids -1, -2, ... by page_id, so that no document shares one.
    """
    missing = lambda *names: [F.lit(None).cast("string").alias(n) for n in names]
    number = F.col("page_id").cast("long")
    return docs.select("doc_id", F.lit(None).cast("long").alias("page_id"), "text", "source", "lang", *missing("html", "url")).unionByName(
        pages.select((-1 - number).alias("doc_id"), number.alias("page_id"), page_text(F.col("html")).alias("text"), *missing("source", "lang"), "html", "url")
    )


def text_model(rows: DataFrame, languages: tuple[str, ...]) -> np.ndarray:
    """Log probabilities of the table's slots per language, and an even row for the unknown; of bounded size."""
    declared = rows.filter(F.col("declared").isin(*languages)).select("text", "declared")
    counted = declared.mapInArrow(_count(languages), "language int, slot int, n long").groupBy("language", "slot").agg(F.sum("n").alias("n")).collect()
    counts = np.ones((len(languages) + 1, TABLE))
    for row in counted:
        counts[row["language"], row["slot"]] += row["n"]
    return np.log(counts / counts.sum(axis=1, keepdims=True))


def _smoothed(counts: list[Column], total: Column, prior: list[Column]) -> list[Column]:
    return [(c + F.lit(HOST_WEIGHT) * p) / (total + F.lit(HOST_WEIGHT)) for c, p in zip(counts, prior, strict=True)]


def host_priors(scored: DataFrame, n: int) -> DataFrame:
    """Host and the prior of each language: the host's counts, smoothed by its domain's, smoothed by all."""
    sums = lambda prefix, source: [F.sum(F.col(source[k])).alias(f"{prefix}{k}") for k in range(n)]
    read = [f"r{k}" for k in range(n)]
    by_host = scored.groupBy("host", "domain").agg(*(F.sum((F.col("read") == k).cast("long")).alias(f"r{k}") for k in range(n)))
    by_domain = by_host.groupBy(F.col("domain").alias("d")).agg(*sums("d", read))
    # one row: the counts of all texts
    read_all = [count or 0 for count in by_domain.agg(*sums("a", [f"d{k}" for k in range(n)])).first()]
    total = lambda prefix: sum((F.col(f"{prefix}{k}") for k in range(1, n)), F.col(f"{prefix}0"))
    rows = by_host.join(by_domain, F.col("domain").eqNullSafe(F.col("d")))
    top = [F.lit((count + 1) / (sum(read_all) + n)) for count in read_all]
    middle = _smoothed([F.col(f"d{k}") for k in range(n)], total("d"), top)
    return rows.select(F.col("host").alias("of_host"), F.array(*_smoothed([F.col(r) for r in read], total("r"), middle)).alias("prior"))


def identify(docs: DataFrame, languages: tuple[str, ...] = LANGUAGES, doc_id: str = "doc_id", text: str = "text", host: str = "source", declared: str | None = "lang", markup: str | None = None, url: str | None = None) -> DataFrame:
    """doc_id, language, probability, accepted of every row, and the hash of the row that was judged.

    `declared` or `markup` (a page's source, searched for its lang attribute) give the declared language, `url` the suffix.
    """
    spark = docs.sparkSession
    prepare(spark)
    missing = F.lit(None).cast("string")
    of_page = F.lower(F.nullif(F.regexp_extract(F.col(markup), r"(?is)<html\b[^>]*?\blang\s*=\s*[\"']?([a-z]{2})", 1), F.lit(""))) if markup else missing
    said = F.coalesce(F.lower(F.col(declared).cast("string")) if declared else missing, of_page)
    address = F.nullif(F.regexp_extract(F.lower(F.col(url)), r"^[a-z]+://(?:[^/@]*@)?([^/:?#]+)", 1), F.lit("")) if url else missing
    at = F.coalesce(address, F.col(host).cast("string") if host else missing)
    rows = docs.select(
        F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"), at.alias("host"), said.alias("declared"), row_hash(docs).alias("row_hash"),
        F.substring_index(at, ".", -2).alias("domain"), F.when(at.contains("."), F.substring_index(at, ".", -1)).alias("suffix"),
    )
    schema = "doc_id long, host string, declared string, row_hash long, domain string, suffix string, n_words long, likelihoods array<double>"
    n = len(languages)
    scored = rows.mapInArrow(_score(text_model(rows, languages)), schema)
    # host counts come from confident readings of the text alone
    best = F.array_max(F.slice("likelihoods", 1, n))
    read = F.when((F.col("n_words") > 0) & (best > F.col("likelihoods")[n]), F.array_position("likelihoods", best).cast("int") - 1).otherwise(-1)
    scored = staged(scored.withColumn("read", read), "likelihoods")
    priors = host_priors(scored, n).withColumn("of_salt", F.explode(F.sequence(F.lit(0), F.lit(15)).cast("array<bigint>")))
    salted = scored.withColumn("salt", F.pmod("row_hash", F.lit(16)))
    joined = salted.join(priors, F.col("host").eqNullSafe(F.col("of_host")) & (F.col("salt") == F.col("of_salt")))

    told = lambda column, mapping, right: F.coalesce(
        *(F.when(column == key, F.array(*(F.lit(float(np.log(right if x == name else (1 - right) / n))) for x in (*languages, UNKNOWN)))) for key, name in mapping.items()),
        F.array(*[F.lit(0.0)] * (n + 1)),
    )
    by_name = {x: x for x in languages}
    by_suffix = {s: x for s, x in SUFFIXES.items() if x in languages}
    known = F.transform("prior", lambda p: F.log(p * (1 - UNKNOWN_PRIOR)))
    evidence = F.zip_with(F.col("likelihoods"), F.concat(known, F.array(F.lit(float(np.log(UNKNOWN_PRIOR))))), lambda a, b: a + b)
    for more in (told(F.col("declared"), by_name, DECLARED_RIGHT), told(F.col("suffix"), by_suffix, SUFFIX_RIGHT)):
        evidence = F.zip_with(evidence, more, lambda a, b: a + b)
    fused = joined.select("doc_id", "row_hash", "n_words", evidence.alias("evidence"))
    top = F.array_max("evidence")
    weight = F.aggregate("evidence", F.lit(0.0), lambda total, x: total + F.exp(x - F.array_max("evidence")))
    named = F.get(F.array(*(F.lit(x) for x in (*languages, UNKNOWN))), (F.array_position("evidence", top) - 1).cast("int"))
    found = fused.select("doc_id", "row_hash", F.when(F.col("n_words") > 0, named).otherwise(UNKNOWN).alias("language"), F.when(F.col("n_words") > 0, 1 / weight).otherwise(0.0).alias("probability"))
    return found.withColumn("accepted", (F.col("language") != UNKNOWN) & (F.col("probability") >= LEAST_PROBABILITY))


def row_hash(docs: DataFrame) -> Column:
    """A hash of all columns: tells rows with one id apart."""
    return F.xxhash64(*(F.col(f"`{c}`") for c, kind in docs.dtypes if "map<" not in kind and kind != "void"))


def accepted_rows(docs: DataFrame, doc_id: str = "doc_id", **columns) -> DataFrame:
    """The rows whose language is accepted, with all their columns."""
    rejected = identify(docs, doc_id=doc_id, **columns).filter("NOT accepted").select(F.col("doc_id").alias("__id"), F.col("row_hash").alias("__hash"))
    keyed = docs.withColumn("__row", row_hash(docs))
    same = keyed[doc_id].cast("long").eqNullSafe(F.col("__id")) & (F.col("__row") == F.col("__hash"))
    return keyed.join(rejected, same, "left_anti").drop("__row")

"""Documents to packed training sequences: language, near duplicates, benchmark leaks, personal data, packing.

Every stage reads what its predecessor kept, whole, and writes Parquet in the shared folder; all but the last return the
columns of documents.  No stage is random: the same documents give the same rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from logclinic.llm.decontaminate import without_leaks
from logclinic.llm.jaccard_join import keep_first
from logclinic.llm.language_id import accepted_rows
from logclinic.llm.packing import pack
from logclinic.llm.pii import redact
from logclinic.llm.queries import tokenizer_path
from logclinic.llm.staging import staged


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in one of the known languages.

    Null and empty texts have no language and go; equal rows stay or go together; an empty table stays empty.
    """
    return accepted_rows(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of documents linked by similar shingle sets, the one with the smallest id.

    Equal rows stay once.  Null and empty texts have no link and stay; rows with one id, or none, and different texts are
    told apart by their texts; an empty table stays empty.
    """
    return keep_first(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item.

    Null and empty texts hold none and stay, as do all rows if there is no item; equal rows are judged one by one.
    """
    return without_leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, personal data masked; n_chars follows the text, and is null where the text is.

    Null texts stay null, empty ones empty; equal rows give equal rows.
    """
    return redact(docs).withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents and their places in sequences.

    A null or empty text gives one piece, the separator; equal rows are packed one by one; no documents, no pieces.
    """
    return pack(docs, tokenizer_path())


STAGES = [
    ("language", language),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("personal_data", personal_data),
    ("packing", packing),
]

#: Packing and edit distances are beyond SQL; tests/llm holds the stages against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = staged(stage(spark, docs, sf_dir), name)
    name, stage = STAGES[-1]
    return stage(spark, docs, sf_dir)

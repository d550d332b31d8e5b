"""Raw inputs: files or table rows holding whole texts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from logclinic import schema
from logclinic.functions.text import first_line, is_blank, lines, stack_lines

#: Accepted size of one input.
MAX_INPUT_BYTES = 10 * 1024 * 1024
FORMATS = ("text", "json", "jsonl")
_LISTINGS_PER_CORE = 8


def detect_format(path: Column) -> Column:
    """Format by file suffix, upper or lower case; everything unknown is text."""
    suffix = F.regexp_extract(F.lower(path), r"[^/](\.[^./]+)$", 1)
    return F.when(suffix == ".json", "json").when(suffix.isin(".jsonl", ".ndjson"), "jsonl").otherwise("text")


def decode_tolerant(content: Column) -> Column:
    """Bytes to text; invalid UTF-8 becomes the replacement character and never fails."""
    return F.make_valid_utf8(content.cast("string"))


def no_files(path: str) -> FileNotFoundError:
    return FileNotFoundError(f"no input files matched {path!r}")


def read_inputs(spark: SparkSession, path: str, pattern: str | None = None) -> DataFrame:
    """(source, size, content) for one file, a directory tree or a glob; an input without files is refused."""
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", "true")
    if pattern:
        reader = reader.option("pathGlobFilter", pattern)
    # folders are listed by a job that has a task for each folder, up to this many
    tasks = "spark.sql.sources.parallelPartitionDiscovery.parallelism"
    before = spark.conf.get(tasks)
    spark.conf.set(tasks, min(int(before), _LISTINGS_PER_CORE * spark.sparkContext.defaultParallelism))
    try:
        files = reader.load(path)
    finally:
        spark.conf.set(tasks, before)
    if files.isEmpty():
        raise no_files(path)
    return files.select(F.col("path").alias("source"), F.col("length").alias("size"), "content")


def split_oversized(inputs: DataFrame, limit: int = MAX_INPUT_BYTES) -> tuple[DataFrame, DataFrame]:
    """Accepted inputs and rejects (source, reason) by byte size."""
    rejects = inputs.where(F.col("size") > limit).select("source", F.lit("too_large").alias("reason"))
    return inputs.where(F.col("size") <= limit), rejects


def text_events(texts: DataFrame) -> DataFrame:
    """(source, text) to one event per non-blank text; blank texts give no event."""
    derived = {
        "seq": F.lit(1).cast("bigint"),
        "platform": F.lit("unknown"),
        "severity": F.lit("ERROR"),
        "error_message": first_line(F.col("all_lines")),
        "stacktrace": stack_lines(F.col("all_lines")),
        "payload_text": F.col("text"),
        "source": F.col("source"),
    }
    columns = [
        derived.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in schema.EVENTS.fields
    ]
    split = texts.select("source", "text", lines(F.col("text")).alias("all_lines"))
    return split.where(~is_blank(F.col("text"))).select(columns)

"""Small builders for hand-written inputs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from logclinic import schema


def events(spark: SparkSession, *rows: dict) -> DataFrame:
    """Event rows from partial dictionaries; ``source`` and ``seq`` default to one source in order."""
    filled = []
    for i, row in enumerate(rows):
        values = {"source": "s", "seq": i + 1, "platform": "unknown", "resource_attributes": {}, "event_attributes": {}, **row}
        filled.append(tuple(values.get(c) for c in schema.EVENT_COLUMNS))
    return spark.createDataFrame(filled, schema.EVENTS)


def texts(spark: SparkSession, **contents: str) -> DataFrame:
    return spark.createDataFrame(list(contents.items()), "source string, text string")

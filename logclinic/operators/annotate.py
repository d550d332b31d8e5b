"""Filling unknown event fields from what their source revealed."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logclinic.functions.platforms import UNKNOWN


def annotate_events(events: DataFrame, features: DataFrame) -> DataFrame:
    """Unknown platforms become the platform of the source, missing error types its first exception."""
    known = features.select(
        "source", F.col("platform").alias("source_platform"), F.col("first_exception").alias("source_exception")
    )
    return (
        events.join(known, "source")
        .withColumn(
            "platform", F.when(F.col("platform") == UNKNOWN, F.col("source_platform")).otherwise(F.col("platform"))
        )
        .withColumn("error_type", F.coalesce("error_type", "source_exception"))
        .drop("source_platform", "source_exception")
    )

"""Connected components of links between rows, by smallest labels and pointer jumping.

Each round is a few joins and one aggregation; labels are written to the shared folder, never gathered on the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logclinic.llm.staging import staged


def components(links: DataFrame) -> DataFrame:
    """id, component (the smallest id reachable) of every id in the links a, b."""
    both = staged(links.select("a", "b").union(links.select("b", "a")).distinct(), "links")
    labels = staged(both.groupBy(F.col("a").alias("id")).agg(F.least(F.min("b"), F.first("a")).alias("component")), "labels")
    while True:
        offered = (
            both.join(labels.select(F.col("id").alias("b"), F.col("component").alias("offer")), "b")
            .groupBy(F.col("a").alias("id"))
            .agg(F.min("offer").alias("offer"))
        )
        lowered = staged(
            labels.join(offered, "id", "left").select("id", F.col("component").alias("before"), F.least("component", F.coalesce("offer", "component")).alias("component")), "labels"
        )
        jumped = staged(
            lowered.join(lowered.select(F.col("id").alias("component"), F.col("component").alias("further")), "component", "left").select(
                "id", "before", F.least("component", F.coalesce("further", "component")).alias("component")
            ),
            "labels",
        )
        labels = jumped.select("id", "component")
        if jumped.filter("component != before").isEmpty():
            return labels

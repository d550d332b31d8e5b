"""Positions of rows in a global order, without a window over all rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from logclinic.llm.staging import shuffle_partitions, staged

#: monotonically_increasing_id keeps the partition above these bits and the row's place in it below.
ROW_BITS = 33


def positioned(frame: DataFrame, order: list[Column], weights: list[str], label: str) -> DataFrame:
    """The rows with `at`, their place (from 0) in the order, and for each weight `<weight>_before`, its sum over all rows before.

    Rows are sorted in ranges and written once; only one row per range is summed in order, so no task sees more than
    its range.  Rows equal under `order` get places in an arbitrary order: make it total, or let equal rows be alike.
    """
    spark = frame.sparkSession
    # a hot key with many rows is divided too: rows that `order` leaves equal are dealt by their number
    tied = frame.withColumn("_tie", F.monotonically_increasing_id())
    ranges = tied.repartitionByRange(shuffle_partitions(spark), *order, F.col("_tie")).sortWithinPartitions(*order, F.col("_tie"))
    rows = staged(ranges.drop("_tie").withColumn("_slot", F.monotonically_increasing_id()).withColumn("_range", F.shiftright("_slot", ROW_BITS)), label)
    in_range = Window.partitionBy("_range").orderBy("_slot").rowsBetween(Window.unboundedPreceding, -1)
    for name in weights:
        rows = rows.withColumn(f"{name}_before", F.coalesce(F.sum(name).over(in_range), F.lit(0)))
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)  # one row per range: a few thousand at most
    totals = rows.groupBy("_range").agg(F.count(F.lit(1)).alias("_n"), *(F.sum(w).alias(f"_{w}") for w in weights))
    totals = totals.select("_range", *(F.coalesce(F.sum(c).over(before), F.lit(0)).alias(f"{c}_o") for c in ("_n", *(f"_{w}" for w in weights))))
    joined = rows.join(F.broadcast(totals), "_range")
    mask = F.lit((1 << ROW_BITS) - 1)
    sums = {f"{w}_before": F.col(f"{w}_before") + F.col(f"_{w}_o") for w in weights}
    return joined.withColumns({"at": F.col("_slot").bitwiseAND(mask) + F.col("_n_o"), **sums}).select(*frame.columns, "at", *sums)

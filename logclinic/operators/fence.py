"""Keeping filters above expensive computed columns."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def fenced(rows: DataFrame) -> DataFrame:
    """Same rows, but filters stated later stay above this point.

    A filter on a computed column (joins and explodes add null checks on their own) would otherwise be pushed below
    the computation, repeating it once per mention.
    """
    row = F.struct(*rows.columns)
    return rows.select(F.explode_outer(F.array(row)).alias("row")).select("row.*")

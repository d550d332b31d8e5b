"""Joining the events of one source into texts of bounded size, without ever building an unbounded group.

Events are pooled in pieces: neighbouring positions share a piece until it holds ``piece_bytes`` of text.  A piece is
known by its place (``fine``, ``part``), which needs no other event of its source but the neighbours in its own bucket of
``FINE_ROWS`` positions, so one shuffle of the events does it, and the heaviest source is spread over many tasks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from logclinic.functions.platforms import UNKNOWN

PIECE_BYTES = 10 * 1024 * 1024
#: Neighbouring positions whose events may share a piece.
FINE_ROWS = 1 << 16
# every event costs a little even without text, so that the number of events of a piece is bounded as well
_EVENT_COST = 64


def event_text() -> Column:
    """Message, stack trace and raw text of one event, empty ones left out."""
    return F.concat_ws("\n", *[F.nullif(F.col(c), F.lit("")) for c in ("error_message", "stacktrace", "payload_text")])


def has_metadata() -> Column:
    filled = [F.coalesce(F.col(c), F.lit("")) != "" for c in ("job", "stage", "service", "task")]
    maps = [F.coalesce(F.size(c), F.lit(0)) > 0 for c in ("resource_attributes", "event_attributes")]
    first, *rest = filled + maps
    for test in rest:
        first = first | test
    return first


def _parts(events: DataFrame) -> DataFrame:
    """The per-event facts pooling needs; every other column is pruned here."""
    return events.select(
        "source",
        "seq",
        event_text().alias("text"),
        F.nullif(F.col("payload_text"), F.lit("")).alias("payload_text"),
        F.when(
            (F.coalesce(F.col("platform"), F.lit("")) != "") & (F.col("platform") != UNKNOWN), F.col("platform")
        ).alias("platform"),
        F.nullif(F.col("error_type"), F.lit("")).alias("error_type"),
        (F.coalesce(F.col("stacktrace"), F.lit("")) != "").alias("has_stack"),
        has_metadata().alias("has_metadata"),
    )


def pool_single(events: DataFrame) -> DataFrame:
    """Pooled form of sources that hold exactly one event each (raw text logs): no shuffle at all."""
    return _parts(events).select(
        "source",
        "text",
        "payload_text",
        F.lit(1).cast("bigint").alias("n_events"),
        F.col("platform").alias("event_platform"),
        F.when(F.col("error_type").isNotNull(), F.array("error_type"))
        .otherwise(F.array().cast("array<string>"))
        .alias("event_error_types"),
        "has_stack",
        "has_metadata",
    )


def pool(events: DataFrame, piece_bytes: int = PIECE_BYTES) -> DataFrame:
    """One row per piece of a source, in the order of (fine, part)."""
    size = (F.octet_length("text") + _EVENT_COST).cast("bigint")
    order = Window.partitionBy("source", "fine").orderBy("seq", "text", "payload_text")
    before = F.coalesce(F.sum(size).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    # pieces are small for what scanning them costs, so a number of tasks chosen by bytes leaves cores idle
    tasks = int(events.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    placed = _parts(events).withColumn("fine", F.floor(F.col("seq") / FINE_ROWS)).repartition(tasks, "source", "fine")
    return (
        placed.withColumn("part", F.floor(before / piece_bytes))
        .groupBy("source", "fine", "part")
        .agg(
            F.array_sort(F.collect_list(F.struct("seq", "text", "payload_text"))).alias("items"),
            F.count("*").alias("n_events"),
            F.expr("min_by(platform, seq) filter (where platform is not null)").alias("event_platform"),
            F.array_sort(F.collect_set("error_type")).alias("event_error_types"),
            F.bool_or("has_stack").alias("has_stack"),
            F.bool_or("has_metadata").alias("has_metadata"),
        )
        .withColumn("text", _joined("text"))
        .withColumn("payload_text", F.nullif(_joined("payload_text"), F.lit("")))
        .drop("items")
    )


def _joined(field: str) -> Column:
    texts = F.filter(F.transform("items", lambda x: x[field]), lambda t: t != "")
    return F.array_join(texts, "\n")

"""From matches to one report row per source."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logclinic.functions.scoring import MEDIUM_FROM, NO_MATCH_MESSAGE
from logclinic.operators.evidence import evidence_items
from logclinic.operators.matching import match_rules
from logclinic.rules.base import RuleBase

MATCH_FIELDS = [
    "severity_rank", "rule_id", "name", "category", "score", "band", "matched_signals", "matched_exceptions",
    "evidence", "n_actions",
]


def reports(features: DataFrame, rules: RuleBase, keep: tuple[str, ...] = ()) -> DataFrame:
    """One row per source with its ranked matches, status and message.

    The only shuffle moves facts and matches (never text) to one place per source; a source has at most as many
    matches as there are rules.  The columns ``keep`` of the features go along.
    """
    candidates = match_rules(features, rules, keep_unmatched=True).withColumn(
        "evidence", F.when(F.col("rule_id").isNotNull(), evidence_items())
    )
    # descending score first, so that the natural order of the struct is the ranking
    ordered = F.struct((-F.col("score")).alias("order"), *MATCH_FIELDS)
    grouped = candidates.groupBy("source").agg(
        F.first("platform").alias("platform"),
        F.first("n_events").alias("event_count"),
        F.first("error_types").alias("error_types"),
        F.array_sort(F.collect_list(F.when(F.col("rule_id").isNotNull(), ordered))).alias("matches"),
        *[F.first(c).alias(c) for c in keep],
    )
    return with_status(grouped)


def with_status(grouped: DataFrame) -> DataFrame:
    """Status, band and message from the leading match."""
    return (
        grouped.withColumn("top", F.get("matches", F.lit(0)))
        .withColumn(
            "status",
            F.when(F.col("top.score") >= MEDIUM_FROM, F.lit("diagnosed")).otherwise(F.lit("insufficient_evidence")),
        )
        .withColumn("top_band", F.col("top.band"))
        .withColumn("message", status_message())
        .drop("top")
    )


def status_message() -> Column:
    top, others = F.col("top"), F.size("matches") - 1
    chosen = F.concat(
        top["rule_id"], F.lit(" selected with "), top["band"], F.lit(" confidence ("), top["score"].cast("string"),
        F.lit("/100) based on "), F.size(top["evidence"]).cast("string"), F.lit(" evidence item(s)."),
        F.when(others > 0, F.concat(F.lit(" "), others.cast("string"), F.lit(" competing diagnosis(es) considered.")))
        .otherwise(F.lit("")),
    )
    weak = F.concat(
        F.lit("Best candidate "), top["rule_id"], F.lit(" reached only "), top["band"], F.lit(" confidence ("),
        top["score"].cast("string"), F.lit("/100). Insufficient evidence for a conclusion."),
    )
    return F.when(top.isNull(), F.lit(NO_MATCH_MESSAGE)).when(top["score"] >= MEDIUM_FROM, chosen).otherwise(weak)


def ranked_matches(report: DataFrame) -> DataFrame:
    """Matches as rows, ``rank`` from 1."""
    return report.select("source", F.posexplode("matches").alias("pos", "m")).select(
        "source", (F.col("pos") + 1).alias("rank"), *[F.col(f"m.{c}").alias(c) for c in MATCH_FIELDS]
    )


def top_matches(report: DataFrame) -> DataFrame:
    """The leading match of every source that has one."""
    return report.where(F.size("matches") > 0).select(
        "source", *[F.col("matches")[0][c].alias(c) for c in MATCH_FIELDS]
    )

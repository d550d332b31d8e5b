"""Evidence items of a match: what was seen, what it weighs, which lines show it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from logclinic.functions.scoring import MAX_SCORE, WEIGHTS, band
from logclinic.functions.text import first_excerpt


def _item(kind: str, description: Column, origin: Column, excerpt: Column) -> Column:
    return F.struct(
        F.lit(kind).alias("type"),
        F.lit(WEIGHTS[kind]).alias("weight"),
        description.alias("description"),
        origin.alias("origin"),
        excerpt.alias("excerpt"),
    )


def _optional(condition: Column, item: Column) -> Column:
    return F.filter(F.array(F.when(condition, item)), lambda x: x.isNotNull())


def evidence_items() -> Column:
    """Ordered array over a match row: exact signals, heuristic signals, exceptions, platform, metadata."""
    cited = F.coalesce("exception_excerpt", "signal_excerpt")
    names = F.array_join("matched_exceptions", ", ")
    where = F.when(F.col("has_stack"), "stack trace").otherwise("failure text")

    def per_signal(column: str, kind: str, words: str) -> Column:
        return F.transform(
            column,
            lambda s: _item(
                kind, F.concat(F.lit(words + ": "), s), F.concat(F.lit("signal:"), s), F.col("signal_excerpt")
            ),
        )

    return F.concat(
        per_signal("exact_signals", "error_signature", "Exact error signature matched"),
        per_signal("heuristic_signals", "correlated_signal", "Supporting signal observed"),
        _optional(
            F.size("matched_exceptions") > 0,
            _item(
                "stacktrace_evidence",
                F.concat(F.lit("Declared exception observed in "), where, F.lit(": "), names),
                F.concat(F.lit("exception:"), F.array_join("matched_exceptions", ",")),
                F.col("exception_excerpt"),
            ),
        ),
        _optional(
            F.col("platform_match"),
            _item(
                "platform_match",
                F.concat(
                    F.lit("Platform detected: "), F.col("platform"),
                    F.lit(" (diagnosis supports: "), F.array_join("platforms", ", "), F.lit(")"),
                ),
                F.lit("platform:detect"),
                cited,
            ),
        ),
        _optional(
            F.col("has_metadata"),
            _item(
                "supporting_metadata",
                F.lit("Runtime metadata present (job/stage/service/attributes)"),
                F.lit("metadata:event"),
                cited,
            ),
        ),
    )


def evidence_rows(matches: DataFrame) -> DataFrame:
    """One row per evidence item, numbered from 1 within its match."""
    return matches.select("source", "rule_id", F.posexplode(evidence_items()).alias("pos", "item")).select(
        "source", "rule_id", (F.col("pos") + 1).alias("ev_no"), "item.*"
    )


def score_evidence(evidence: DataFrame) -> DataFrame:
    """Capped weight sum and band per match."""
    return (
        evidence.groupBy("source", "rule_id")
        .agg(F.least(F.lit(MAX_SCORE), F.sum("weight")).cast("int").alias("score"), F.count("*").alias("n_evidence"))
        .withColumn("band", band(F.col("score")))
    )


def dedupe_evidence(evidence: DataFrame) -> DataFrame:
    """Mark items whose cited line was already shown: ``same_as`` is the first item with that line."""
    same = Window.partitionBy("source", "rule_id", "shown_line").orderBy("ev_no")
    line = F.coalesce(first_excerpt(F.col("excerpt")), F.lit(""))
    return (
        evidence.withColumn("shown_line", line)
        .withColumn("first_no", F.first("ev_no").over(same))
        .withColumn(
            "same_as", F.when((F.col("shown_line") != "") & (F.col("first_no") < F.col("ev_no")), F.col("first_no"))
        )
        .drop("first_no")
    )

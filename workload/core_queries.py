"""Queries over derived failure events: features, matches, evidence, reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from logclinic.functions import exceptions, platforms, redaction, text
from logclinic.functions import signals as S
from logclinic.operators import evidence as E
from logclinic.operators import features as X
from logclinic.operators import reports as P
from logclinic.operators.annotate import annotate_events
from logclinic.operators.matching import match_exceptions, match_positive, match_uncontradicted, match_rules, with_rule_attributes
from logclinic.operators.pooling import has_metadata, pool, pool_single
from logclinic.plans.diagnose import diagnose_events
from logclinic.rules.base import RuleBase
from workload import tables as W

RULES = RuleBase.shipped()


def joined(column: str | Column) -> Column:
    return F.array_join(column, ",")


def features(spark: SparkSession, sf: str) -> DataFrame:
    return X.source_features(W.failure_events(spark, sf), RULES)


def matches(spark: SparkSession, sf: str) -> DataFrame:
    return match_rules(features(spark, sf), RULES)


def reports(spark: SparkSession, sf: str) -> DataFrame:
    return diagnose_events(W.failure_events(spark, sf), RULES)


def single_reports(spark: SparkSession, sf: str) -> DataFrame:
    """One report per event: sources are single events, so nothing is pooled."""
    return P.reports(X.text_features(pool_single(W.single_events(spark, sf)), RULES), RULES)


def pool_text(spark: SparkSession, sf: str) -> DataFrame:
    """The pieces of every source; small ones, so that sources of the given tables have several."""
    return pool(W.failure_events(spark, sf), piece_bytes=1000).select("source", "fine", "part", "n_events", "text")


def detect_platform(spark: SparkSession, sf: str) -> DataFrame:
    """The marked platform of highest priority in any piece of a source."""
    ranked = F.array(*[F.lit(p) for p in [*platforms.MARKERS, platforms.UNKNOWN]])
    of_piece = pool(W.failure_events(spark, sf)).select("source", platforms.detect_platform(F.lower("text")).alias("platform"))
    best = of_piece.groupBy("source").agg(F.min(F.array_position(ranked, F.col("platform"))).cast("int").alias("rank"))
    return best.select("source", F.element_at(ranked, F.col("rank")).alias("platform"))


def resolve_platform(spark: SparkSession, sf: str) -> DataFrame:
    return features(spark, sf).select("source", "platform")


def annotated(spark: SparkSession, sf: str) -> DataFrame:
    events = W.failure_events(spark, sf)
    return annotate_events(events, X.source_features(events, RULES)).select("source", "seq", "platform", "error_type")


def extract_exceptions(spark: SparkSession, sf: str) -> DataFrame:
    pooled = pool(W.failure_events(spark, sf))
    return pooled.select("source", F.explode(exceptions.exception_types(F.col("text"))).alias("exception")).distinct()


def observed_exceptions(spark: SparkSession, sf: str) -> DataFrame:
    return features(spark, sf).select("source", F.explode("observed").alias("exception"))


def extract_signals(spark: SparkSession, sf: str) -> DataFrame:
    return features(spark, sf).select("source", F.explode("signals").alias("signal"))


def metadata_flag(spark: SparkSession, sf: str) -> DataFrame:
    return W.failure_events(spark, sf).groupBy("source").agg(F.bool_or(has_metadata()).alias("has_metadata"))


def positive(spark: SparkSession, sf: str) -> DataFrame:
    return match_positive(features(spark, sf), RULES)


def negative_anti(spark: SparkSession, sf: str) -> DataFrame:
    return match_uncontradicted(features(spark, sf), RULES)


def declared_exceptions(spark: SparkSession, sf: str) -> DataFrame:
    return match_exceptions(features(spark, sf), RULES)


def matched_rules(spark: SparkSession, sf: str) -> DataFrame:
    return matches(spark, sf).select(
        "source", "rule_id", "platform", "platform_match", joined("matched_signals").alias("matched_signals"),
        joined("matched_exceptions").alias("matched_exceptions"),
    )


def enriched(spark: SparkSession, sf: str) -> DataFrame:
    return with_rule_attributes(matches(spark, sf).select("source", "rule_id", "score"), RULES).select(
        "source", "rule_id", F.col("score").cast("bigint").alias("score"), "name", "category", "severity",
        joined("platforms").alias("platforms"), joined("hypotheses").alias("hypotheses"),
    )


def evidence_rows(spark: SparkSession, sf: str) -> DataFrame:
    return E.evidence_rows(matches(spark, sf)).select(
        "source", "rule_id", F.col("ev_no").cast("bigint").alias("ev_no"), "type",
        F.col("weight").cast("bigint").alias("weight"), "description", "origin", "excerpt",
    )


def evidence_dedupe(spark: SparkSession, sf: str) -> DataFrame:
    return E.dedupe_evidence(E.evidence_rows(matches(spark, sf))).select(
        "source", "rule_id", F.col("ev_no").cast("bigint").alias("ev_no"), "shown_line",
        F.col("same_as").cast("bigint").alias("same_as"),
    )


def score_evidence(spark: SparkSession, sf: str) -> DataFrame:
    return E.score_evidence(E.evidence_rows(matches(spark, sf))).select(
        "source", "rule_id", F.col("score").cast("bigint").alias("score"), "n_evidence"
    )


def confidence_band(spark: SparkSession, sf: str) -> DataFrame:
    return matches(spark, sf).groupBy("band").agg(
        F.count("*").alias("n_matches"), F.min("score").cast("bigint").alias("low"),
        F.max("score").cast("bigint").alias("high"),
    )


def signal_line(spark: SparkSession, sf: str) -> DataFrame:
    cited = F.array_min(F.filter("signal_cites", lambda c: F.array_contains("matched_signals", c["name"])))
    return _cited_matches(spark, sf).select("source", "rule_id", cited["no"].alias("line_no"))


def exception_line(spark: SparkSession, sf: str) -> DataFrame:
    cited = F.array_min(F.filter("exception_cites", lambda c: F.array_contains("matched_exceptions", c["name"])))
    return _cited_matches(spark, sf).select("source", "rule_id", cited["no"].alias("line_no"))


def _cited_matches(spark: SparkSession, sf: str) -> DataFrame:
    return match_rules(features(spark, sf), RULES, keep_cites=True)


def evidence_excerpt(spark: SparkSession, sf: str) -> DataFrame:
    return matches(spark, sf).select("source", "rule_id", "signal_excerpt", "exception_excerpt")


def error_types(spark: SparkSession, sf: str) -> DataFrame:
    return features(spark, sf).select("source", joined("error_types").alias("error_types"))


def report_status(spark: SparkSession, sf: str) -> DataFrame:
    return _status_columns(reports(spark, sf))


def report_status_single(spark: SparkSession, sf: str) -> DataFrame:
    return _status_columns(single_reports(spark, sf))


def _status_columns(report: DataFrame) -> DataFrame:
    top = F.get("matches", F.lit(0))
    return report.select(
        "source", "platform", "event_count", joined("error_types").alias("error_types"),
        F.size("matches").cast("bigint").alias("n_matches"), top["rule_id"].alias("top_rule"),
        top["score"].cast("bigint").alias("top_score"), "top_band", "status", "message",
    )


def rank_matches(spark: SparkSession, sf: str) -> DataFrame:
    return P.ranked_matches(reports(spark, sf)).select(
        "source", F.col("rank").cast("bigint").alias("rank"), "rule_id", F.col("score").cast("bigint").alias("score"),
        "band", F.col("severity_rank").cast("bigint").alias("severity_rank"),
    )


def top_match(spark: SparkSession, sf: str) -> DataFrame:
    return P.top_matches(single_reports(spark, sf)).select(
        "source", "rule_id", F.col("score").cast("bigint").alias("score"), "band"
    )


def redact_text(spark: SparkSession, sf: str) -> DataFrame:
    templates = W.inputs(spark, sf).select("source", "text")
    return templates.unionByName(W.document_texts(spark, sf)).select(
        "source", redaction.redact(F.col("text")).alias("text")
    )


def redact_lines(spark: SparkSession, sf: str) -> DataFrame:
    return W.inputs(spark, sf).select("source", redaction.redact_lines(F.col("text"), 60).alias("text"))


def number_lines(spark: SparkSession, sf: str) -> DataFrame:
    both = W.inputs(spark, sf).select("source", "text").unionByName(W.document_texts(spark, sf))
    return both.select("source", F.explode(text.numbered_lines(F.col("text"))).alias("l")).select("source", "l.no", "l.line")


QUERIES = {
    "pool_text": pool_text,
    "detect_platform": detect_platform,
    "resolve_platform": resolve_platform,
    "annotate_events": annotated,
    "extract_exceptions": extract_exceptions,
    "observed_exceptions": observed_exceptions,
    "extract_signals": extract_signals,
    "metadata_flag": metadata_flag,
    "match_positive": positive,
    "match_negative_anti": negative_anti,
    "match_exceptions": declared_exceptions,
    "match_rules": matched_rules,
    "enrich_matches": enriched,
    "evidence_rows": evidence_rows,
    "evidence_dedupe": evidence_dedupe,
    "score_evidence": score_evidence,
    "confidence_band": confidence_band,
    "signal_line": signal_line,
    "exception_line": exception_line,
    "evidence_excerpt": evidence_excerpt,
    "error_types": error_types,
    "report_status": report_status,
    "report_status_single": report_status_single,
    "rank_matches": rank_matches,
    "top_match": top_match,
    "redact_text": redact_text,
    "redact_lines": redact_lines,
    "number_lines": number_lines,
}

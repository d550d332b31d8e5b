"""Queries over labelled cases, rule tables and rendered reports."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from logclinic.operators import evaluate as Q
from logclinic.operators import validate as V
from logclinic.plans.ingest import diagnose_inputs
from logclinic.rules.base import RuleBase
from logclinic.session import ensure_checkpoint_dir
from logclinic.sinks import render as R
from logclinic.plans.diagnose import diagnose_events
from workload import tables as W

RULES = RuleBase.shipped()


def graded(spark: SparkSession, sf: str) -> DataFrame:
    files = W.inputs(spark, sf).select("source", "text").withColumn("size", F.octet_length("text").cast("bigint"))
    return Q.grade(W.eval_cases(spark, sf), diagnose_inputs(files, RULES))


def eval_cases(spark: SparkSession, sf: str) -> DataFrame:
    return W.eval_cases(spark, sf).select(
        "name", "kind", "label", "expected_status", F.array_join("expected_ids", ",").alias("expected_ids"), "expected_band"
    )


def eval_grade(spark: SparkSession, sf: str) -> DataFrame:
    return graded(spark, sf).select(
        "name", "kind", "predicted_status", F.array_join("matched_ids", ",").alias("matched_ids"), "predicted_band",
        F.col("top_score").cast("bigint").alias("top_score"), "has_evidence", "has_remediation",
        F.array_join("notes", "; ").alias("notes"), "ok",
    )


def eval_regressions(spark: SparkSession, sf: str) -> DataFrame:
    return Q.regressions(graded(spark, sf), W.baseline(spark, sf))


def eval_metrics(spark: SparkSession, sf: str) -> DataFrame:
    result = Q.metrics(graded(spark, sf), W.baseline(spark, sf))
    return result.withColumns({r: F.round(r, 6) for r in Q.RATIOS})


def eval_render(spark: SparkSession, sf: str) -> DataFrame:
    """The summary, every failing case and every regression, as lines."""
    frame, earlier = graded(spark, sf), W.baseline(spark, sf)
    summary = Q.render_metrics(Q.metrics(frame, earlier)).select(F.lit("summary").alias("section"), F.lit("").alias("name"), F.col("text").alias("line"))
    return summary.unionByName(Q.render_findings(frame, earlier))


def baseline_roundtrip(spark: SparkSession, sf: str) -> DataFrame:
    """Results written as a baseline in the shared folder and read again."""
    ensure_checkpoint_dir(spark)
    path = f"{spark.sparkContext.getCheckpointDir()}/baseline-{uuid.uuid4().hex}"
    Q.write_baseline(graded(spark, sf), path)
    return Q.read_baseline(spark, path)


def _user_rules(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    return V.scan_rules(W.rule_texts(spark, sf))


def _all_rules(spark: SparkSession, sf: str) -> DataFrame:
    return _user_rules(spark, sf)[0].unionByName(RULES.table(spark).drop("severity_rank"))


def rules_scan(spark: SparkSession, sf: str) -> DataFrame:
    good, problems = _user_rules(spark, sf)
    kept = good.select("rule_id", F.size("positive").cast("bigint").alias("n_positive"), F.lit(None).cast("string").alias("problem"))
    return kept.unionByName(problems.withColumn("n_positive", F.lit(None).cast("bigint")))


def validate_rules(spark: SparkSession, sf: str) -> DataFrame:
    return V.validate_rules(_all_rules(spark, sf))


def validate_refs(spark: SparkSession, sf: str) -> DataFrame:
    cases = W.eval_cases(spark, sf)
    named = cases.select(F.explode("expected_ids").alias("rule_id"), F.col("label").alias("fixture")).distinct()
    gone = W.read(spark, sf, "benchmark").select(
        F.lit("SPARK-001").alias("rule_id"), F.concat(F.lit("gone/"), F.col("item_id").cast("string")).alias("fixture")
    )
    return V.validate_refs(_all_rules(spark, sf), cases, named.unionByName(gone))


def catalog_list(spark: SparkSession, sf: str) -> DataFrame:
    return V.catalog_list(_all_rules(spark, sf))


def catalog_groups(spark: SparkSession, sf: str) -> DataFrame:
    return V.catalog_groups(_all_rules(spark, sf))


def catalog_text(spark: SparkSession, sf: str) -> DataFrame:
    return V.catalog_text(_all_rules(spark, sf).where("name IS NOT NULL"))


def _reports(spark: SparkSession, sf: str) -> DataFrame:
    return diagnose_events(W.failure_events(spark, sf), RULES)


def report_json(spark: SparkSession, sf: str) -> DataFrame:
    return R.report_json(_reports(spark, sf), RULES)


def report_markdown(spark: SparkSession, sf: str) -> DataFrame:
    return R.report_markdown(_reports(spark, sf), RULES)


def report_text(spark: SparkSession, sf: str) -> DataFrame:
    return R.report_text(_reports(spark, sf), RULES)


def prompt_blocks(spark: SparkSession, sf: str) -> DataFrame:
    events = W.failure_events(spark, sf)
    return R.prompt_blocks(diagnose_events(events, RULES), events, RULES)


QUERIES = {
    "eval_cases": eval_cases,
    "eval_grade": eval_grade,
    "eval_regressions": eval_regressions,
    "eval_metrics": eval_metrics,
    "eval_render": eval_render,
    "baseline_roundtrip": baseline_roundtrip,
    "rules_scan": rules_scan,
    "validate_rules": validate_rules,
    "validate_refs": validate_refs,
    "catalog_list": catalog_list,
    "catalog_groups": catalog_groups,
    "catalog_text": catalog_text,
    "report_json": report_json,
    "report_markdown": report_markdown,
    "report_text": report_text,
    "prompt_blocks": prompt_blocks,
}

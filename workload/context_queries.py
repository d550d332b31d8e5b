"""Queries over structured context and the investigation of leading diagnoses."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from logclinic.operators import context_tools as C
from logclinic.operators import investigate as I
from logclinic.operators.reports import top_matches
from logclinic.plans.investigate import investigation
from logclinic.rules.base import RuleBase
from logclinic.sources.context import context_rows
from workload import tables as W
from workload.core_queries import reports, single_reports

RULES = RuleBase.shipped()


def get_logs(spark: SparkSession, sf: str) -> DataFrame:
    texts = W.document_texts(spark, sf)
    return C.get_logs(C.context_lines(W.log_lines(spark, sf), texts), limit=5)


def search_logs(spark: SparkSession, sf: str) -> DataFrame:
    """The first three hits of every source with the number of all its hits."""
    hits, counts = C.search_logs(C.context_lines(W.log_lines(spark, sf)), "Spark", limit=3)
    return hits.join(counts, "source").select("source", "n", "line", "matches", "first_no")


def get_run(spark: SparkSession, sf: str) -> DataFrame:
    runs = W.runs(spark, sf)
    named = W.read(spark, sf, "orders").groupBy("o_custkey").agg(F.min("o_orderkey").alias("k")).select(
        F.concat(F.lit("c"), F.col("o_custkey").cast("string")).alias("source"),
        F.concat(F.lit("run-"), F.col("k").cast("string")).alias("run_id"),
    )
    return C.get_run(runs).withColumn("asked", F.lit("current")).unionByName(
        C.get_run(runs, named).withColumn("asked", F.lit("named"))
    )


def run_history(spark: SparkSession, sf: str) -> DataFrame:
    return C.run_history(W.runs(spark, sf), limit=3)


def compare_runs(spark: SparkSession, sf: str) -> DataFrame:
    return C.compare_runs(W.runs(spark, sf))


def get_schema(spark: SparkSession, sf: str) -> DataFrame:
    return C.get_schema(W.schemas(spark, sf)).select("source", "table_name", "column_name", "data_type")


def compare_schema(spark: SparkSession, sf: str) -> DataFrame:
    return C.compare_schema(W.schemas(spark, sf))


def schema_added_removed(spark: SparkSession, sf: str) -> DataFrame:
    return C.schema_added_removed(W.schemas(spark, sf))


def _shown(metrics: DataFrame) -> DataFrame:
    return metrics.select("source", "name", C.metric_line().alias("shown"))


def get_metrics(spark: SparkSession, sf: str) -> DataFrame:
    return _shown(C.get_metrics(W.metrics(spark, sf), "error, purchase,"))


def stage_metrics(spark: SparkSession, sf: str) -> DataFrame:
    return _shown(C.stage_metrics(W.metrics(spark, sf), W.context(spark, sf).runs))


def executor_metrics(spark: SparkSession, sf: str) -> DataFrame:
    return _shown(C.executor_metrics(W.metrics(spark, sf), "1"))


def plan_preview(spark: SparkSession, sf: str) -> DataFrame:
    return C.plan_preview(W.plans(spark, sf))


def search_rules(spark: SparkSession, sf: str) -> DataFrame:
    """Knowledge search for the family of every event's leading diagnosis."""
    asked = top_matches(single_reports(spark, sf)).select("source", F.split("category", r"\.")[0].alias("query"))
    return C.search_rules(asked, RULES).select(
        "source", "query", F.col("rank").cast("bigint").alias("rank"), F.col("found_id").alias("rule_id")
    )


def plan_probes(spark: SparkSession, sf: str) -> DataFrame:
    return _numbered(I.plan_probes(_parts(spark, sf).plan))


def run_probes(spark: SparkSession, sf: str) -> DataFrame:
    return _numbered(_parts(spark, sf).results)


def verify_probes(spark: SparkSession, sf: str) -> DataFrame:
    verified = _parts(spark, sf).verified
    return verified.select(
        "source", F.col("probe_no").cast("bigint").alias("probe_no"), "tool", "contradiction",
        F.array_join("supports", ",").alias("supports"),
    )


def corroborate(spark: SparkSession, sf: str) -> DataFrame:
    """Findings in order, one row each."""
    record = _parts(spark, sf).record
    return record.select("source", "rule_id", F.posexplode("findings").alias("pos", "f")).select(
        "source", "rule_id", (F.col("pos") + 1).cast("bigint").alias("finding_no"), "f.tool", "f.signal"
    )


def investigate(spark: SparkSession, sf: str) -> DataFrame:
    return _parts(spark, sf).record.select(
        "source", "rule_id", "status", F.col("tool_calls").cast("bigint").alias("tool_calls"), "reason",
        "contradicted", "contradiction", "contradicted_by",
    )


def _parts(spark: SparkSession, sf: str):  # noqa: ANN202 - a named tuple of frames
    return investigation(reports(spark, sf), W.context(spark, sf), RULES)


def _numbered(rows: DataFrame) -> DataFrame:
    return rows.withColumn("probe_no", F.col("probe_no").cast("bigint"))


def context_normalize(spark: SparkSession, sf: str) -> DataFrame:
    """All context tables and rejects as one long table."""
    rows = context_rows(W.context_texts(spark, sf))

    def listed(items: str, kind: str, order: str, *columns: str) -> str:
        content = ", ".join(f"coalesce(CAST({c} AS STRING), '-')" for c in columns)
        return f"transform(coalesce({items}, array()), x -> named_struct('kind', '{kind}', 'ord', CAST({order} AS BIGINT), 'content', concat_ws('/', {content})))"

    parts = [
        listed("runs", "run", "x.ordinal", "x.is_current", "x.run_id", "x.status", "x.job", "x.stage"),
        listed("columns", "schema", "x.pos", "x.tbl_ord", "x.table_name", "x.column_name", "x.data_type"),
        listed("metrics", "metric", "x.ord", "x.name", "x.value", "x.unit", "try_element_at(x.labels, 'stage')"),
        listed("plans", "plan", "0", "x.plan"),
        listed("logs", "log", "x.n", "x.line"),
        listed("filter(array(reason), r -> r IS NOT NULL)", "error", "0", "x"),
    ]
    return rows.selectExpr("source", f"inline(concat({', '.join(parts)}))")


QUERIES = {
    "context_normalize": context_normalize,
    "get_logs": get_logs,
    "search_logs": search_logs,
    "get_run": get_run,
    "run_history": run_history,
    "compare_runs": compare_runs,
    "get_schema": get_schema,
    "compare_schema": compare_schema,
    "schema_added_removed": schema_added_removed,
    "get_metrics": get_metrics,
    "stage_metrics": stage_metrics,
    "executor_metrics": executor_metrics,
    "plan_preview": plan_preview,
    "search_rules": search_rules,
    "plan_probes": plan_probes,
    "run_probes": run_probes,
    "verify_probes": verify_probes,
    "corroborate": corroborate,
    "investigate": investigate,
}

"""Grading reports against labelled cases."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from logclinic.functions.scoring import MEDIUM_FROM

CASES = (
    "name string, kind string, label string, source string, expected_status string, expected_ids array<string>, "
    "expected_band string"
)
BASELINE = "name string, ok boolean"
RATIOS = [
    "accuracy", "precision", "recall", "abstention_quality", "confidence_calibration", "evidence_coverage",
    "unsupported_claim_rate", "remediation_coverage", "regression_rate", "tool_efficiency",
]


def grade(cases: DataFrame, reports: DataFrame) -> DataFrame:
    """One row per case: prediction next to expectation, and a note for every difference."""
    top = F.get("matches", F.lit(0))
    predicted = reports.select(
        "source",
        F.col("status").alias("predicted_status"),
        F.coalesce(F.transform("matches", lambda m: m["rule_id"]), F.array().cast("array<string>")).alias("matched_ids"),
        F.col("top_band").alias("predicted_band"),
        top["score"].alias("top_score"),
        F.coalesce(F.size(top["evidence"]) > 0, F.lit(False)).alias("has_evidence"),
        F.coalesce(top["n_actions"] > 0, F.lit(False)).alias("has_remediation"),
    )
    quoted = lambda c: F.coalesce(F.concat(F.lit("'"), c, F.lit("'")), F.lit("none"))
    listed = lambda c: F.concat(F.lit("["), F.array_join(c, ", "), F.lit("]"))
    status = F.concat(F.lit("status "), quoted("predicted_status"), F.lit(" != expected "), quoted("expected_status"))
    ids = F.concat(F.lit("matches "), listed("matched_ids"), F.lit(" != expected "), listed("expected_ids"))
    band = F.concat(F.lit("band "), quoted("predicted_band"), F.lit(" != expected "), quoted("expected_band"))
    notes = F.array(
        F.when(~F.col("predicted_status").eqNullSafe(F.col("expected_status")), status),
        F.when(F.col("matched_ids") != F.col("expected_ids"), ids),
        F.when(
            F.col("expected_band").isNotNull() & ~F.col("predicted_band").eqNullSafe(F.col("expected_band")), band
        ),
    )
    return (
        cases.join(predicted, "source", "left")
        .withColumn("matched_ids", F.coalesce("matched_ids", F.array().cast("array<string>")))
        .withColumn("notes", F.array_compact(notes))
        .withColumn("ok", F.size("notes") == 0)
    )


def regressions(graded: DataFrame, baseline: DataFrame) -> DataFrame:
    """Names that passed before and are now missing or failing."""
    now = graded.select("name", F.col("ok").alias("ok_now"))
    return (
        baseline.where("ok").select("name").join(now, "name", "left").where(~F.coalesce("ok_now", F.lit(False))).select("name")
    )


def metrics(graded: DataFrame, baseline: DataFrame | None = None) -> DataFrame:
    """One row of counts and ratios; a ratio without any case to judge is null.

    The graded cases meet the baseline once, by name, and one aggregation counts everything.
    """
    rows = graded.withColumn("is_case", F.lit(True))
    if baseline is None:
        rows = rows.withColumn("passed_before", F.lit(False))
    else:
        earlier = baseline.where("ok").select("name", F.lit(True).alias("passed_before"))
        rows = rows.join(earlier, "name", "full")
    is_case, before, ok = (F.coalesce(c, F.lit(False)) for c in ("is_case", "passed_before", "ok"))
    positive = F.col("kind") == "positive"
    emitted = F.coalesce(F.col("predicted_status") == "diagnosed", F.lit(False))
    abstains = (F.col("expected_status") == "input_error") | (F.size("expected_ids") == 0)
    banded = positive & F.col("expected_band").isNotNull()
    remedied, evidenced = F.coalesce("has_remediation", F.lit(False)), F.coalesce("has_evidence", F.lit(False))

    def ratio(hits: Column, base: Column) -> Column:
        return F.try_divide(F.count_if(base & hits), F.count_if(base))

    return rows.agg(
        F.count_if(is_case).alias("total"),
        F.count_if(ok).alias("passed"),
        *[F.count_if(F.col("kind") == k).alias(k) for k in ("positive", "negative", "malformed")],
        ratio(ok, is_case).alias("accuracy"),
        ratio(ok, emitted).alias("precision"),
        ratio(ok & emitted, positive).alias("recall"),
        ratio(ok, abstains).alias("abstention_quality"),
        ratio(F.coalesce(F.col("predicted_band") == F.col("expected_band"), F.lit(False)), banded).alias("confidence_calibration"),
        ratio(evidenced, emitted).alias("evidence_coverage"),
        ratio(~evidenced | F.coalesce(F.col("top_score") < MEDIUM_FROM, F.lit(False)), emitted).alias("unsupported_claim_rate"),
        ratio(remedied, emitted).alias("remediation_coverage"),
        ratio(~ok, before).alias("regression_rate"),
        F.lit(None).cast("double").alias("tool_efficiency"),
    )


def baseline_of(graded: DataFrame) -> DataFrame:
    return graded.select("name", "ok")


def write_baseline(graded: DataFrame, path: str) -> None:
    baseline_of(graded).write.mode("errorifexists").json(path)


def read_baseline(spark: SparkSession, path: str) -> DataFrame:
    """(name, ok); a value that is not a boolean or a missing name is refused when read."""
    return spark.read.schema(BASELINE).option("mode", "FAILFAST").json(path)


def render_metrics(result: DataFrame) -> DataFrame:
    """The one metrics row as text and as JSON."""
    shown = lambda c: F.when(c.isNotNull(), F.format_string("%.3f", c)).otherwise("n/a")
    rows = [F.concat(F.rpad(F.lit("  " + r.replace("_", " ")), 27, " "), shown(F.col(r))) for r in RATIOS]
    head = [
        F.format_string("Cases: %d (%d positive, %d negative, %d malformed)", "total", "positive", "negative", "malformed"),
        F.format_string("Result: %d/%d passed", "passed", "total"),
        F.lit(""),
        F.lit("Metrics"),
    ]
    return result.select(
        F.concat_ws("\n", *head, *rows).alias("text"),
        F.to_json(F.struct(*result.columns), {"ignoreNullFields": "false"}).alias("json"),
    )


def render_findings(graded: DataFrame, baseline: DataFrame | None = None) -> DataFrame:
    """(section, name, line): a row for every failing case with its notes and for every regression."""
    failing = graded.where(~F.col("ok")).select(
        F.lit("failure").alias("section"), "name", F.concat(F.lit("FAIL "), "name", F.lit(": "), F.array_join("notes", "; ")).alias("line")
    )
    if baseline is None:
        return failing
    lost = regressions(graded, baseline)
    return failing.unionByName(lost.select(F.lit("regression").alias("section"), "name", F.concat(F.lit("REGRESSED "), "name").alias("line")))


_CASE_FILE = "name string, kind string, expected struct<status: string, diagnosis_ids: array<string>, confidence_band: string>"


def read_corpus(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Labelled cases below a folder, and their inputs (source, size, content).

    A case is a folder with ``case.json`` and an ``input.*`` file, the first by name; its name and kind default to the
    folder's name and the parent folder's.  A case without expected status or input is refused.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    placed = files.select(
        F.regexp_extract("path", r"^(.*)/[^/]*$", 1).alias("folder"), F.regexp_extract("path", r"([^/]*)$", 1).alias("file"), F.col("path").alias("source"), F.col("length").alias("size"), "content"
    )
    described = placed.where("file = 'case.json'").select("folder", F.from_json(F.col("content").cast("string"), _CASE_FILE).alias("c"))
    inputs = placed.where("file LIKE 'input.%'").groupBy("folder").agg(F.min_by(F.struct("source", "size", "content"), "file").alias("i"))
    both = described.join(inputs, "folder", "left")
    folder = F.split("folder", "/")
    refused = F.raise_error(F.concat(F.lit("case without expected status or input file: "), "folder"))
    cases = both.select(
        F.coalesce("c.name", F.element_at(folder, -1)).alias("name"),
        F.coalesce("c.kind", F.element_at(folder, -2)).alias("kind"),
        F.concat_ws("/", F.element_at(folder, -2), F.element_at(folder, -1)).alias("label"),
        F.col("i.source").alias("source"),
        F.when(F.col("c.expected.status").isNull() | F.col("i").isNull(), refused.cast("string")).otherwise(F.col("c.expected.status")).alias("expected_status"),
        F.coalesce("c.expected.diagnosis_ids", F.array().cast("array<string>")).alias("expected_ids"),
        F.col("c.expected.confidence_band").alias("expected_band"),
    )
    return cases, both.where("i IS NOT NULL").select("i.*")

"""Read-only questions about the structured context of a source, answered for all sources at once.

Context tables follow ``schema.RUNS``, ``SCHEMAS``, ``METRICS``, ``PLANS`` and ``LOG_LINES``.  Every answer is a join,
a filter or an aggregation with map-side combine; where only the first few rows per source count, ``row_number`` with a
constant bound lets Spark drop the others before the shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from logclinic.functions.redaction import redact
from logclinic.functions.text import is_blank, lines
from logclinic.rules.base import RuleBase

PLAN_PREVIEW_CHARS = 2000
KNOWLEDGE_LIMIT = 10


def first_rows(rows: DataFrame, order: str, limit: int | None) -> DataFrame:
    """First ``limit`` rows per source; none or 0 keeps all, a negative limit keeps nothing."""
    if not limit:
        return rows
    if limit < 0:
        return rows.limit(0)
    rank = F.row_number().over(Window.partitionBy("source").orderBy(order))
    return rows.withColumn("_rank", rank).where(F.col("_rank") <= limit).drop("_rank")


# --- logs -----------------------------------------------------------------------------------------------------


def context_lines(log_lines: DataFrame, texts: DataFrame | None = None) -> DataFrame:
    """Non-blank lines (source, n, line): the log lines, then the lines of the failure text, numbered on."""
    numbered = log_lines.select("source", "n", "line")
    if texts is not None:
        offset = log_lines.groupBy("source").agg(F.max("n").alias("last"))
        added = texts.join(offset, "source", "left").select(
            "source", F.coalesce("last", F.lit(0)).alias("last"), F.posexplode(lines(F.col("text"))).alias("pos", "line")
        )
        numbered = numbered.unionByName(
            added.select("source", (F.col("last") + F.col("pos") + 1).cast("bigint").alias("n"), "line")
        )
    return numbered.where(~is_blank(F.col("line")))


def get_logs(numbered: DataFrame, limit: int | None = None) -> DataFrame:
    return first_rows(numbered, "n", limit).withColumn("line", redact(F.col("line")))


def search_logs(numbered: DataFrame, query: str, limit: int | None = None) -> tuple[DataFrame, DataFrame]:
    """Matching lines (redacted, the first ``limit`` per source) and (source, matches) over all of them."""
    if not query.strip():
        raise ValueError("the query must not be empty")
    hits = numbered.where(F.contains(F.lower("line"), F.lit(query.strip().lower())))
    counts = hits.groupBy("source").agg(F.count("*").alias("matches"), F.min("n").alias("first_no"))
    return get_logs(hits, limit), counts


# --- runs -----------------------------------------------------------------------------------------------------

_RUN = ["run_id", "status", "job", "stage", "error"]


def _run_struct() -> Column:
    return F.struct(*_RUN)


def current_runs(runs: DataFrame) -> DataFrame:
    return runs.where("is_current").select("source", *_RUN)


def get_run(runs: DataFrame, wanted: DataFrame | None = None) -> DataFrame:
    """The current run per source, or the named one of ``wanted`` (source, run_id): previous runs go first."""
    if wanted is None:
        found = current_runs(runs)
    else:
        found = (
            runs.join(wanted.select("source", "run_id"), ["source", "run_id"])
            .groupBy("source")
            .agg(F.min_by(_run_struct(), F.struct("is_current", "ordinal")).alias("run"))
            .select("source", "run.*")
        )
    return found.withColumn("error", redact(F.col("error")))


def run_history(runs: DataFrame, limit: int | None = None) -> DataFrame:
    previous = first_rows(runs.where(~F.col("is_current")), "ordinal", limit)
    return previous.select("source", "ordinal", *_RUN).withColumn("error", redact(F.col("error")))


def compare_runs(runs: DataFrame, wanted: DataFrame | None = None) -> DataFrame:
    """Current run next to the first previous one; sources without both are left out.

    ``wanted`` (source, base, other) names the runs instead; an id that is null there keeps its default, and among runs
    of one name previous ones go first.
    """
    if wanted is None:
        named = runs.withColumns({"base_name": F.lit(None).cast("string"), "other_name": F.lit(None).cast("string")})
    else:
        named = runs.join(wanted.select("source", F.col("base").alias("base_name"), F.col("other").alias("other_name")), "source")
    order = F.struct("is_current", "ordinal")

    def chosen(name: str, default: Column) -> Column:
        fits = F.when(F.col(name).isNull(), default).otherwise(F.col("run_id") == F.col(name))
        return F.min_by(F.when(fits, _run_struct()), F.when(fits, order))

    return (
        named.groupBy("source")
        .agg(
            chosen("base_name", F.col("is_current")).alias("base"),
            chosen("other_name", ~F.col("is_current")).alias("other"),
        )
        .where(F.col("base").isNotNull() & F.col("other").isNotNull())
        .select(
            "source",
            F.col("base.run_id").alias("base_run"),
            F.col("other.run_id").alias("other_run"),
            F.col("base.status").alias("base_status"),
            F.col("other.status").alias("other_status"),
            F.col("base.stage").alias("base_stage"),
            F.col("other.stage").alias("other_stage"),
        )
    )


# --- schemas --------------------------------------------------------------------------------------------------


def get_schema(columns: DataFrame, table: str | None = None) -> DataFrame:
    """Columns of the named snapshot, or of the first one of every source."""
    wanted = F.col("table_name") == table if table else F.col("tbl_ord") == 0
    return columns.where(wanted).select("source", "table_name", "pos", "column_name", "data_type")


def compare_schema(columns: DataFrame, first: int = 0, second: int = 1) -> DataFrame:
    """Differences between two snapshots of a source: one row per added, removed or retyped column."""
    a, b = (
        columns.where(F.col("tbl_ord") == t).select("source", "column_name", F.col("data_type").alias(f"{side}_type"), F.lit(True).alias(side))
        for t, side in ((first, "a"), (second, "b"))
    )
    both = columns.groupBy("source").agg(
        F.bool_or(F.col("tbl_ord") == first).alias("has_a"), F.bool_or(F.col("tbl_ord") == second).alias("has_b")
    )
    change = (
        F.when(F.col("a").isNull(), "added")
        .when(F.col("b").isNull(), "removed")
        .when(~F.col("a_type").eqNullSafe(F.col("b_type")), "retyped")
    )
    return (
        a.join(b, ["source", "column_name"], "full_outer")
        .withColumn("change", change)
        .where(F.col("change").isNotNull())
        .join(both.where("has_a AND has_b"), "source", "left_semi")
        .select("source", "column_name", "change", F.col("a_type").alias("old_type"), F.col("b_type").alias("new_type"))
    )


def schema_added_removed(columns: DataFrame) -> DataFrame:
    """(source, added, removed) as sorted comma lists, for sources with two snapshots."""
    sides = columns.groupBy("source").agg(
        F.collect_set(F.when(F.col("tbl_ord") == 0, F.col("column_name"))).alias("a"),
        F.collect_set(F.when(F.col("tbl_ord") == 1, F.col("column_name"))).alias("b"),
    )
    names = lambda x, y: F.array_join(F.array_sort(F.array_except(x, y)), ",")
    return sides.where((F.size("a") > 0) & (F.size("b") > 0)).select(
        "source", names("b", "a").alias("added"), names("a", "b").alias("removed")
    )


# --- metrics --------------------------------------------------------------------------------------------------


def metric_line() -> Column:
    return F.concat(
        "name", F.lit("="), F.col("value").cast("string"),
        F.when(F.coalesce("unit", F.lit("")) != "", F.concat(F.lit(" "), "unit")).otherwise(""),
        F.when(F.coalesce("window", F.lit("")) != "", F.concat(F.lit(" ["), "window", F.lit("]"))).otherwise(""),
    )


def get_metrics(metrics: DataFrame, names: str = "") -> DataFrame:
    """Samples named in a comma list, or all."""
    wanted = [n.strip() for n in names.split(",") if n.strip()]
    return metrics.where(F.col("name").isin(wanted)) if wanted else metrics


def stage_metrics(metrics: DataFrame, runs: DataFrame, stage: str | None = None) -> DataFrame:
    """Samples labelled with the stage given, else with the stage of the current run; all where there is none."""
    staged = metrics.join(current_runs(runs).select("source", F.col("stage").alias("_stage")), "source", "left")
    wanted = F.coalesce(F.lit(stage or None), F.nullif("_stage", F.lit("")))
    kept = wanted.isNull() | F.coalesce(F.try_element_at("labels", F.lit("stage")) == wanted, F.lit(False))
    return staged.where(kept).drop("_stage")


def executor_metrics(metrics: DataFrame, executor: str | None = None) -> DataFrame:
    """Samples labelled with the executor, or all."""
    if not executor:
        return metrics
    label = F.coalesce(F.nullif(F.try_element_at("labels", F.lit("executor")), F.lit("")), F.try_element_at("labels", F.lit("executor_id")))
    return metrics.where(label == executor)


# --- plans and knowledge -----------------------------------------------------------------------------------------


def plan_preview(plans: DataFrame) -> DataFrame:
    """Redacted start of every plan and its full length."""
    filled = plans.where(F.coalesce("plan", F.lit("")) != "")
    return filled.select(
        "source", F.substring(redact(F.col("plan")), 1, PLAN_PREVIEW_CHARS).alias("preview"), F.length("plan").cast("bigint").alias("n_chars")
    )


def search_rules(queries: DataFrame, rules: RuleBase, limit: int = KNOWLEDGE_LIMIT) -> DataFrame:
    """Rules whose id, category or name contains ``query``; the first ``limit`` by id, as rows added to ``queries``.

    The size-checked rule list is part of the expression, so nothing is joined or moved.
    """
    listed = F.array(
        *[F.struct(*[F.lit(row[i]).alias(n) for i, n in enumerate(("found_id", "found_name", "found_category"))]) for row in rules.rows]
    )
    wanted = F.lower(F.trim("query"))
    hit = lambda r: F.contains(F.lower(F.concat_ws("\n", r["found_id"], r["found_category"], r["found_name"])), wanted)
    return queries.select("*", F.posexplode(F.slice(F.filter(listed, hit), 1, limit)).alias("pos", "r")).select(
        *queries.columns, (F.col("pos") + 1).alias("rank"), "r.*"
    )

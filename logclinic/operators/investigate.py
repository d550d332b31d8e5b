"""Bounded investigation: question the leading diagnosis with the structured context of its source."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from logclinic import schema
from logclinic.functions.redaction import redact
from logclinic.functions.text import clamp
from logclinic.operators import context_tools as C
from logclinic.operators.features import source_features
from logclinic.operators.fence import fenced
from logclinic.rules.base import RuleBase

MAX_ITERATIONS = 8
MAX_CALLS = 20
NO_CONTEXT = "no structured context (runs/schemas/metrics/query plan/logs) was provided beyond the input file"
COMPLETED = "investigation of the available structured context completed; no contradictory evidence found"


class Context(NamedTuple):
    runs: DataFrame
    schemas: DataFrame
    metrics: DataFrame
    plans: DataFrame
    log_lines: DataFrame


def targets(top: DataFrame, rules: RuleBase) -> DataFrame:
    """Leading diagnosis per source with the parts of its rule that are put to the test."""
    rule = rules.table(top.sparkSession).select("rule_id", "category", "platforms", "positive", "negative")
    return top.select("source", "rule_id").join(F.broadcast(rule), "rule_id")


def context_summary(context: Context) -> DataFrame:
    """What context exists per source: one aggregation per table, each with map-side combine."""
    runs = context.runs.groupBy("source").agg(
        F.bool_or("is_current").alias("has_current"),
        F.bool_or(~F.col("is_current")).alias("has_previous"),
        F.max(F.when(F.col("is_current"), F.nullif("stage", F.lit("")))).alias("stage"),
    )
    schemas = context.schemas.groupBy("source").agg(
        F.max(F.when(F.col("tbl_ord") == 0, F.col("table_name"))).alias("table1"),
        F.max(F.when(F.col("tbl_ord") == 1, F.col("table_name"))).alias("table2"),
    )
    summary = runs.join(schemas, "source", "full_outer")
    for table, flag in ((context.metrics, "has_metrics"), (context.plans.where("plan <> ''"), "has_plan"), (context.log_lines, "has_logs")):
        summary = summary.join(table.groupBy("source").agg(F.bool_or(F.lit(True)).alias(flag)), "source", "full_outer")
    return summary


def planned(asked: DataFrame, summary: DataFrame) -> DataFrame:
    """Targets with ``probes``: the ordered, distinct (tool, arg1, arg2) worth asking."""
    known = asked.join(summary, "source", "left")
    flags = ["has_current", "has_previous", "has_metrics", "has_plan", "has_logs"]
    known = fenced(known.withColumns({f: F.coalesce(f, F.lit(False)) for f in flags}))
    about = lambda *families: " OR ".join(f"startswith(category, '{f}')" for f in families)
    probe = lambda tool, a="NULL", b="NULL": f"named_struct('tool', '{tool}', 'arg1', CAST({a} AS STRING), 'arg2', CAST({b} AS STRING))"
    runtime = about("spark", "performance", "connectivity")
    shapes = about("schema", "delta", "quality")
    history = about("spark", "delta", "connectivity")
    any_run = f"(has_current OR has_previous) AND ({history})"
    steps = [
        (f"has_plan AND ({about('spark', 'performance')})", [probe("inspect_query_plan")]),
        (f"table1 IS NOT NULL AND ({shapes})", [probe("get_schema", "table1")]),
        (f"table2 IS NOT NULL AND ({shapes})", [probe("get_schema", "table2"), probe("compare_schema", "table1", "table2")]),
        (f"has_metrics AND ({runtime})", [probe("get_metrics")]),
        (f"has_metrics AND ({runtime}) AND array_contains(platforms, 'spark')", [probe("get_executor_metrics")]),
        (f"has_metrics AND ({runtime}) AND stage IS NOT NULL", [probe("get_stage_metrics", "stage")]),
        (any_run, [probe("get_pipeline_run")]),
        (f"has_previous AND ({any_run})", [probe("get_previous_runs"), probe("compare_runs")]),
        ("has_logs AND size(positive) > 0", [probe("search_logs", "replace(positive[0], '_', ' ')")]),
        ("has_logs AND size(positive) > 1", [probe("search_logs", "replace(positive[1], '_', ' ')")]),
        (about("spark", "delta"), [probe("search_knowledge_base", "category")]),
    ]
    parts = [f"if({condition}, array({', '.join(items)}), array())" for condition, items in steps]
    return known.withColumn("probes", F.expr(f"array_distinct(concat({', '.join(parts)}))")).withColumn(
        "has_context",
        F.expr("has_current OR has_previous OR table1 IS NOT NULL OR has_metrics OR has_plan OR has_logs"),
    )


def plan_probes(plan: DataFrame) -> DataFrame:
    """(source, probe_no, tool, arg1, arg2)."""
    return plan.select("source", "rule_id", F.posexplode("probes").alias("pos", "p")).select(
        "source", "rule_id", (F.col("pos") + 1).alias("probe_no"), "p.tool", "p.arg1", "p.arg2"
    )


def probe_lines(probes: DataFrame, context: Context, rules: RuleBase) -> DataFrame:
    """What each probe returns, line by line: (source, probe_no, tool, seq, line), redacted."""

    def ask(tool: str, answer: DataFrame, seq: Column | None = None, line: Column | None = None, on: Column | None = None) -> DataFrame:
        wanted = probes.where(F.col("tool") == tool).alias("q")
        match = F.col("q.source") == F.col("a.source")
        joined = wanted.join(answer.alias("a"), match if on is None else match & on)
        return joined.select(
            "q.source", "q.probe_no", "q.tool", (F.lit(1) if seq is None else seq).cast("bigint").alias("seq"), line.alias("line")
        )

    runs, previous = context.runs, context.runs.where(~F.col("is_current"))
    state = F.concat("a.run_id", F.lit(" status="), "a.status", F.coalesce(F.concat(F.lit(" error="), F.nullif("a.error", F.lit(""))), F.lit("")))
    single = F.concat(F.lit("run_id="), "a.run_id", F.lit("\nstatus="), "a.status", F.coalesce(F.concat(F.lit("\nerror="), F.nullif("a.error", F.lit(""))), F.lit("")))
    both = F.concat(
        F.lit("compare base="), "a.base_run", F.lit(" (other="), "a.other_run", F.lit(")\nstatus: "), "a.base_status", F.lit(" -> "), "a.other_status"
    )
    measured = context.metrics.withColumn("shown", C.metric_line())
    in_stage = F.try_element_at("a.labels", F.lit("stage")) == F.col("q.arg1")
    diff = C.schema_added_removed(context.schemas)
    names = lambda c: F.regexp_replace(F.when(F.col(c) == "", "none").otherwise(F.col(c)), ",", ", ")
    asked = probes.where("tool = 'search_knowledge_base'").select("source", "probe_no", "tool", F.col("arg1").alias("query"))
    answers = [
        ask("inspect_query_plan", C.plan_preview(context.plans), line=F.col("a.preview")),
        ask("get_schema", context.schemas, F.col("a.pos"), F.col("a.column_name"), F.col("a.table_name") == F.col("q.arg1")),
        ask("compare_schema", diff, line=F.concat(F.lit("added: "), names("a.added"), F.lit("\nremoved: "), names("a.removed"))),
        ask("get_metrics", measured, F.col("a.ord"), F.col("a.shown")),
        ask("get_executor_metrics", measured, F.col("a.ord"), F.col("a.shown")),
        ask("get_stage_metrics", measured, F.col("a.ord"), F.col("a.shown"), in_stage),
        ask("get_pipeline_run", C.current_runs(runs), line=single),
        ask("get_previous_runs", previous, F.col("a.ordinal"), state),
        ask("compare_runs", C.compare_runs(runs), line=both),
        ask("search_logs", C.context_lines(context.log_lines), F.col("a.n"), F.concat(F.col("a.n").cast("string"), F.lit(": "), "a.line"),
            F.contains(F.lower("a.line"), F.lower("q.arg1"))),
        C.search_rules(asked, rules).select(
            "source", "probe_no", "tool", F.col("rank").cast("bigint").alias("seq"),
            F.concat("found_id", F.lit(" "), "found_name", F.lit(" ["), "found_category", F.lit("]")).alias("line"),
        ),
    ]
    lines = answers[0]
    for more in answers[1:]:
        lines = lines.unionByName(more)
    return lines.withColumn("line", redact(F.col("line")))


def run_probes(probes: DataFrame, lines: DataFrame) -> DataFrame:
    """One row per probe: status (a log search without hits succeeds, any other empty answer is unavailable)."""
    counted = lines.groupBy("source", "probe_no").agg(F.count("*").alias("n_lines"))
    found = F.coalesce("n_lines", F.lit(0))
    return probes.join(counted, ["source", "probe_no"], "left").select(
        "source", "rule_id", "probe_no", "tool", "arg1", "arg2",
        F.when((found > 0) | F.col("tool").isin("search_logs", "search_knowledge_base"), "success").otherwise("unavailable").alias("status"),
        found.alias("n_lines"),
    )


def probe_signals(lines: DataFrame, rules: RuleBase) -> DataFrame:
    """(source, probe_no, signals, head): what the returned text of each probe shows.

    Returned text is pooled like any other source, so a probe with a very long answer is cut and rejoined.  Only
    returned data counts, never the wording of the question; the knowledge base quotes rule names and is left out.
    """
    returned = lines.where(F.col("tool") != "search_knowledge_base")
    key = F.concat_ws("\x1f", "source", F.col("probe_no").cast("string"))
    given = {"source": key, "seq": F.col("seq"), "error_message": F.col("line")}
    events = returned.select(
        *[given.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in schema.EVENTS.fields]
    )
    # the number holds no separator, a source may
    number = F.substring_index("source", "\x1f", -1)
    own = F.left("source", F.length("source") - F.length(number) - 1)
    return source_features(events, rules).select(own.alias("source"), number.cast("int").alias("probe_no"), "signals", "head")


def verify_probes(results: DataFrame, signals: DataFrame, asked: DataFrame) -> DataFrame:
    """Per probe: the first negative signal of the target it shows (a contradiction) and its positive ones."""
    return (
        results.join(signals, ["source", "probe_no"], "left")
        .join(asked.select("source", "positive", "negative"), "source")
        .withColumn("signals", F.coalesce("signals", F.array().cast("array<string>")))
        .select(
            "source", "rule_id", "probe_no", "tool", "arg1", "arg2", "status", "n_lines", "head",
            F.get(F.array_intersect("negative", "signals"), F.lit(0)).alias("contradiction"),
            F.array_intersect("positive", "signals").alias("supports"),
        )
    )


def investigate(
    plan: DataFrame,
    verified: DataFrame,
    max_iterations: int = MAX_ITERATIONS,
    max_calls: int = MAX_CALLS,
    allowed: list[str] | None = None,
) -> DataFrame:
    """One record per target: status, calls, reason, findings and contradiction.

    A source has a dozen probes at most, so its probes are folded in order inside one row.
    """
    limit = min(max_iterations, max_calls)
    may_run = verified if allowed is None else verified.where(F.col("tool").isin(allowed))
    order = Window.partitionBy("source").orderBy("probe_no")
    executed = (
        may_run.withColumn("call_no", F.row_number().over(order))
        .withColumn("stopped_at", F.min(F.when(F.col("contradiction").isNotNull(), F.col("call_no"))).over(Window.partitionBy("source")))
        .where((F.col("call_no") <= limit) & (F.col("stopped_at").isNull() | (F.col("call_no") <= F.col("stopped_at"))))
    )
    fields = ["probe_no", "tool", "arg1", "arg2", "status", "n_lines", "contradiction", "supports", "head"]
    folded = executed.groupBy("source").agg(F.array_sort(F.collect_list(F.struct(*fields))).alias("calls"))
    record = fenced(plan.join(folded, "source", "left"))
    last = "element_at(calls, -1)"
    fresh = "array_except(p.supports, transform(acc, f -> f.signal))"
    new = (
        f"if(p.contradiction IS NULL AND size({fresh}) > 0, array(named_struct('tool', p.tool, 'signal', {fresh}[0], "
        "'evidence', substring(p.head, 1, 160))), CAST(array() AS ARRAY<STRUCT<tool:STRING,signal:STRING,evidence:STRING>>))"
    )
    record = record.withColumns(
        {
            "tool_calls": F.expr("if(has_context, coalesce(size(calls), 0), 0)"),
            "contradiction": F.expr(f"if(has_context AND size(calls) > 0, {last}.contradiction, NULL)"),
            "contradicted_by": F.expr(f"if(size(calls) > 0 AND {last}.contradiction IS NOT NULL, {last}.tool, NULL)"),
            "contradiction_evidence": F.when(
                F.expr(f"size(calls) > 0 AND {last}.contradiction IS NOT NULL"), clamp(F.expr(f"{last}.head"), 180)
            ),
            "findings": F.expr(
                "aggregate(coalesce(calls, array()), CAST(array() AS ARRAY<STRUCT<tool:STRING,signal:STRING,evidence:STRING>>), "
                f"(acc, p) -> concat(acc, {new}))"
            ),
            "exhausted": F.expr(f"size(calls) >= {limit} AND {last}.probe_no < size(probes)"),
        }
    )
    spent = f"{max_iterations} iteration(s)" if max_iterations <= max_calls else f"{max_calls} tool call(s)"
    return record.select(
        "source",
        "rule_id",
        F.when(~F.col("has_context"), "insufficient_context")
        .when(F.col("contradiction").isNotNull(), "success")
        .when(F.col("exhausted"), "limit_reached")
        .otherwise("success")
        .alias("status"),
        F.col("tool_calls").alias("iterations"),
        "tool_calls",
        F.when(~F.col("has_context"), NO_CONTEXT)
        .when(
            F.col("contradiction").isNotNull(),
            F.concat(F.lit("investigation found evidence contradicting "), "rule_id", F.lit("; the top explanation is challenged")),
        )
        .when(F.col("exhausted"), f"investigation stopped after {spent}")
        .otherwise(COMPLETED)
        .alias("reason"),
        F.col("contradiction").isNotNull().alias("contradicted"),
        "contradiction",
        "contradicted_by",
        "contradiction_evidence",
        "findings",
        # what was asked in order, with the number of returned lines and the start of the answer
        F.when(
            F.col("has_context"),
            F.transform(
                F.coalesce("calls", F.filter(F.array(F.get("calls", F.lit(0))), lambda c: c.isNotNull())),
                lambda c: F.struct(
                    c["tool"].alias("tool"), F.array_compact(F.array(c["arg1"], c["arg2"])).alias("params"), c["status"].alias("status"),
                    c["n_lines"].alias("lines"), clamp(F.coalesce(c["head"], F.lit("")), 160).alias("detail"),
                ),
            ),
        ).alias("calls"),
        F.lit(max_iterations).alias("max_iterations"),
        F.lit(max_calls).alias("max_tool_calls"),
    )

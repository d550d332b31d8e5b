from __future__ import annotations

from helpers import events

from logclinic import schema
from logclinic.operators import context_tools as C
from logclinic.operators.investigate import Context
from logclinic.plans.diagnose import diagnose_events
from logclinic.plans.investigate import investigation
from logclinic.rules.base import RuleBase

RULES = RuleBase.shipped()
MESSAGES = {
    "oom": "org.apache.spark java.lang.OutOfMemoryError: heap",
    "fetch": "org.apache.spark.FetchFailedException: x",
    "schema": "org.apache.spark.sql.AnalysisException: data type mismatch",
    "bare": "org.apache.spark.FetchFailedException: y",
    "calm": "all good",
}


def _context(spark) -> Context:
    return Context(
        spark.createDataFrame([("fetch", 0, True, "r1", "failed", None, "3", "token=abcdefghi"), ("fetch", 1, False, "r0", "done", None, "2", None)], schema.RUNS),
        spark.createDataFrame([("schema", i, t, p, c, d) for i, t, p, c, d in [(0, "t1", 0, "id", "int"), (0, "t1", 1, "name", "string"), (1, "t2", 0, "id", "long"), (1, "t2", 1, "email", "string")]], schema.SCHEMAS),
        spark.createDataFrame([("fetch", 0, "rows", 5.0, None, {"stage": "3"}, None), ("fetch", 1, "bytes", 1.0, "mb", {"executor": "7"}, "1h")], schema.METRICS),
        spark.createDataFrame([("oom", "Scan t\nauthentication failed"), ("fetch", "Exchange: Missing an output location for shuffle 3")], schema.PLANS),
        spark.createDataFrame([("fetch", 1, "shuffle fetch failed for block"), ("fetch", 2, "  ")], schema.LOG_LINES),
    )


def _records(spark, **limits):
    rows = [{"source": s, "error_message": m} for s, m in MESSAGES.items()]
    found = investigation(diagnose_events(events(spark, *rows), RULES), _context(spark), RULES, **limits)
    return {r["source"]: r for r in found.record.collect()}


def test_contradiction_corroboration_and_abstention(spark):
    got = _records(spark)
    assert set(got) == {"oom", "fetch", "schema", "bare"}  # no match, no investigation
    assert (got["oom"]["contradiction"], got["oom"]["tool_calls"], got["oom"]["contradicted_by"]) == ("authentication_failure", 1, "inspect_query_plan")
    assert got["oom"]["contradiction_evidence"].startswith("Scan t") and got["oom"]["status"] == "success"
    assert [(f["tool"], f["signal"]) for f in got["fetch"]["findings"]] == [("inspect_query_plan", "shuffle_fetch_failed")]
    assert (got["fetch"]["status"], got["fetch"]["tool_calls"]) == ("limit_reached", 8)
    assert (got["schema"]["tool_calls"], got["schema"]["contradicted"]) == (3, False)
    assert (got["bare"]["status"], got["bare"]["tool_calls"]) == ("insufficient_context", 0)


def test_budgets_and_allow_list(spark):
    got = _records(spark, max_iterations=2)
    assert (got["fetch"]["status"], got["fetch"]["tool_calls"], got["fetch"]["reason"]) == ("limit_reached", 2, "investigation stopped after 2 iteration(s)")
    got = _records(spark, max_calls=20, max_iterations=20, allowed=["get_metrics", "search_logs"])
    assert (got["fetch"]["status"], got["fetch"]["tool_calls"], got["fetch"]["findings"]) == ("success", 2, [])


def test_context_questions(spark):
    context = _context(spark)
    changes = {r["column_name"]: (r["change"], r["old_type"], r["new_type"]) for r in C.compare_schema(context.schemas).collect()}
    assert changes == {"id": ("retyped", "int", "long"), "name": ("removed", "string", None), "email": ("added", None, "string")}
    assert [r["name"] for r in C.stage_metrics(context.metrics, context.runs).collect()] == ["rows"]
    assert [r["name"] for r in C.executor_metrics(context.metrics, "7").collect()] == ["bytes"]
    assert {r["s"] for r in context.metrics.select(C.metric_line().alias("s")).collect()} == {"rows=5.0", "bytes=1.0 mb [1h]"}
    assert C.get_run(context.runs).first()["error"] == "token=[REDACTED]"
    compared = C.compare_runs(context.runs).first()
    assert (compared["base_run"], compared["other_run"], compared["base_status"]) == ("r1", "r0", "failed")
    named = spark.createDataFrame([("fetch", "r0")], "source string, run_id string")
    assert C.get_run(context.runs, named).first()["status"] == "done"
    texts = spark.createDataFrame([("fetch", "tail\n\nshuffle end")], "source string, text string")
    numbered = C.context_lines(context.log_lines, texts)
    assert sorted((r["n"], r["line"]) for r in C.get_logs(numbered).collect()) == [(1, "shuffle fetch failed for block"), (3, "tail"), (5, "shuffle end")]
    assert [r["n"] for r in C.get_logs(numbered, 1).collect()] == [1] and C.get_logs(numbered, -1).count() == 0
    hits, counts = C.search_logs(numbered, "SHUFFLE", 1)
    assert (counts.first()["matches"], [r["n"] for r in hits.collect()]) == (2, [1])
    asked = spark.createDataFrame([("a", "spark."), ("b", "")], "source string, query string")
    found = C.search_rules(asked, RULES).groupBy("source").count().collect()
    assert {r["source"]: r["count"] for r in found} == {"a": 8, "b": 10}

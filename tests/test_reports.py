from __future__ import annotations

from helpers import events, texts

from logclinic.operators import evaluate as Q
from logclinic.operators import validate as V
from logclinic.plans.diagnose import diagnose_events, diagnose_texts
from logclinic.rules.base import RuleBase
from logclinic.sinks import render as R
from logclinic.streaming.reports import stream_reports
from workload.templates import TEMPLATES

RULES = RuleBase.shipped()
SF = "/root/testdata/sf0.001"


def test_every_template_is_diagnosed_as_labelled(spark):
    """Each template alone, as the event it describes."""
    rows = [
        {"source": name, **{k: v.replace("{user}", "7") for k, v in t.fields.items() if k != "event_attributes"},
         "event_attributes": {k: str(v) for k, v in t.fields.get("event_attributes", {}).items()}}
        for name, t in TEMPLATES.items() if t.kind != "malformed"
    ]
    got = {r["source"]: r for r in diagnose_events(events(spark, *rows), RULES).collect()}
    for name, t in TEMPLATES.items():
        if t.kind != "malformed":
            found = got[name]
            assert [m["rule_id"] for m in found["matches"]] == list(t.ids), t.name
            assert (found["status"], found["top_band"]) == (t.status, t.band), t.name
    covered = {i for t in TEMPLATES.values() for i in t.ids}
    assert covered == {r[0] for r in RULES.rows}


def test_ranking_conflicts_and_excerpts(spark):
    logs = {
        "context": "first\norg.apache.spark data skew\n\nlast password=x",
        "frames": "\tat org.apache.spark.A.b(FetchFailedException.scala:1)\n    at c.d(E.java:2)\norg.apache.spark.FetchFailedException: x",
        "foreign": "quiet",
    }
    got = {r["source"]: r for r in diagnose_texts(texts(spark, **logs), RULES).collect()}
    skew = got["context"]["matches"][0]
    assert (skew["rule_id"], skew["score"], skew["band"], got["context"]["status"]) == ("SPARK-005", 35, "LOW", "insufficient_evidence")
    assert skew["evidence"][0]["excerpt"] == "line 2: org.apache.spark data skew | line 1: first | line 4: last password=[REDACTED]"
    fetch = got["frames"]["matches"][0]
    assert [e["excerpt"].split(":")[0] for e in fetch["evidence"]] == ["line 1", "line 3", "line 3"]
    assert got["foreign"]["message"].startswith("No diagnosis matched")


def test_user_rules_match_on_dotted_exceptions(spark):
    rule = ("OWN-001", "Own", "own.thing", "critical", ["spark"], ["pay.LateError"], [], [], ["h"], ["a"], [], [], [("t", "u")])
    table = spark.createDataFrame([rule], RULES.table(spark).drop("severity_rank").schema)
    own = RuleBase.from_table(table)
    rows = [{"source": "a", "error_type": "com.pay.LateError"}, {"source": "b", "error_type": "com.xpay.LateError"}]
    got = {r["source"]: [m["rule_id"] for m in r["matches"]] for r in diagnose_events(events(spark, *rows), own).collect()}
    assert got == {"a": ["OWN-001"], "b": []}


def test_rendered_reports(spark):
    frame = events(spark, {"error_message": "org.apache.spark.FetchFailedException: token=abcdef data skew"}).select("*")
    report = diagnose_events(frame, RULES)
    markdown = R.report_markdown(report, RULES).first()["markdown"]
    plain = R.report_text(report, RULES).first()["text"]
    prompt = R.prompt_blocks(report, frame, RULES).first()["prompt"]
    assert "## SPARK-006 - Shuffle Fetch Failure" in markdown and "(same lines as evidence item 1)" in markdown
    assert markdown.index("SPARK-006") < markdown.index("## SPARK-005") and "### References" in markdown
    assert "Candidate scoreboard:" in plain and "Other candidates considered:" in plain and "What to do next:" in plain
    assert "## Input excerpt (redacted)" in prompt and "hypotheses: remote_block_lost" in prompt
    for rendered in (markdown, plain, prompt, R.report_json(report, RULES).first()["json"]):
        assert "abcdef" not in rendered and "SPARK-006" in rendered


def test_grading_and_baseline(spark, tmp_path):
    report = diagnose_texts(texts(spark, a="org.apache.spark.FetchFailedException: x", b="calm"), RULES)
    cases = spark.createDataFrame(
        [("a", "positive", "positive/a", "a", "diagnosed", ["SPARK-006"], "LOW"), ("b", "negative", "negative/b", "b", "insufficient_evidence", [], None)],
        Q.CASES,
    )
    graded = Q.grade(cases, report).cache()
    notes = {r["name"]: r["notes"] for r in graded.collect()}
    assert notes == {"a": ["band 'HIGH' != expected 'LOW'"], "b": []}
    baseline = spark.createDataFrame([("b", True), ("ghost", True), ("a", False)], Q.BASELINE)
    row = Q.metrics(graded, baseline).first()
    assert (row["accuracy"], row["precision"], row["abstention_quality"], row["regression_rate"]) == (0.5, 0.0, 1.0, 0.5)
    assert row["tool_efficiency"] is None and Q.metrics(graded).first()["regression_rate"] is None
    assert "n/a" in Q.render_metrics(Q.metrics(graded)).first()["text"]
    Q.write_baseline(graded, str(tmp_path / "base"))
    assert {(r["name"], r["ok"]) for r in Q.read_baseline(spark, str(tmp_path / "base")).collect()} == {("a", False), ("b", True)}
    graded.unpersist()


def test_shipped_rules_are_valid(spark):
    assert V.validate_rules(RULES.table(spark)).count() == 0


def test_stream_equals_batch(spark, tmp_path):
    source = tmp_path / "in"
    source.mkdir()
    (source / "a.log").write_text("org.apache.spark.FetchFailedException: x")
    (source / "b.log").write_text("calm")
    out = str(tmp_path / "out")
    query = stream_reports(spark, str(source), out, str(tmp_path / "cp"))
    query.awaitTermination(120)
    got = {r["source"].rsplit("/", 1)[-1]: r["status"] for r in spark.read.parquet(out).collect()}
    assert got == {"a.log": "diagnosed", "b.log": "insufficient_evidence"}


def test_investigation_is_shown_in_every_report(spark):
    from logclinic.operators.investigate import Context
    from logclinic.plans.investigate import investigation

    frame = events(spark, {"source": "s", "error_message": "org.apache.spark.FetchFailedException: data skew", "platform": "spark"})
    report = diagnose_events(frame, RULES)
    none = lambda schema: spark.createDataFrame([], schema)
    context = Context(
        none("source string, ordinal long, is_current boolean, run_id string, status string, job string, stage string, error string"),
        none("source string, tbl_ord int, table_name string, pos int, column_name string, data_type string"),
        none("source string, ord long, name string, value double, unit string, labels map<string,string>, window string"),
        none("source string, plan string"),
        spark.createDataFrame([("s", 1, "Missing an output location for shuffle 3")], "source string, n long, line string"),
    )
    record = investigation(report, context, RULES).record
    first = record.first()
    assert first["calls"] and first["max_tool_calls"] == 20 and first["max_iterations"] == 8
    assert {c["tool"] for c in first["calls"]} >= {"search_logs"} and all(c["status"] for c in first["calls"])
    shown = R.report_json(report, RULES, record).first()["json"]
    assert '"investigation":{"rule_id"' in shown and '"calls":[{' in shown
    markdown, plain = R.report_markdown(report, RULES, record).first()["markdown"], R.report_text(report, RULES, record).first()["text"]
    for text in (markdown, plain):
        assert "Investigation" in text and "of 20 tool calls" in text and "search_logs" in text
    assert '"investigation":null' in R.report_json(report, RULES).first()["json"]


def test_remediation_needs_actions(spark):
    from logclinic.operators.evaluate import grade

    rules = [("OWN-001", "Own", "own.thing", "critical", ["spark"], ["LateError"], [], [], ["h"], [], [], [], [("t", "u")]),
             ("OWN-002", "Other", "own.thing", "high", ["spark"], ["EarlyError"], [], [], ["h"], [], ["do"], [], [("t", "u")])]
    own = RuleBase.from_table(spark.createDataFrame(rules, RULES.table(spark).drop("severity_rank").schema))
    found = diagnose_events(events(spark, {"source": "a", "error_type": "LateError"}, {"source": "b", "error_type": "EarlyError"}), own)
    cases = spark.createDataFrame([(s, "positive", s, s, "insufficient_evidence", ["OWN"], None) for s in "ab"], "name string, kind string, label string, source string, expected_status string, expected_ids array<string>, expected_band string")
    assert {r["name"]: r["has_remediation"] for r in grade(cases, found).collect()} == {"a": False, "b": True}


def test_labelled_folders(spark, tmp_path):
    from logclinic.operators.evaluate import grade, metrics, read_corpus
    from logclinic.plans.ingest import decode_inputs, diagnose_inputs

    log = "org.apache.spark java.lang.OutOfMemoryError: Java heap space"
    for kind, name, case, text in [
        ("positive", "oom", '{"expected": {"status": "diagnosed", "diagnosis_ids": ["SPARK-001"]}}', log),
        ("negative", "calm", '{"name": "quiet", "expected": {"status": "insufficient_evidence"}}', "all good"),
    ]:
        folder = tmp_path / kind / name
        folder.mkdir(parents=True)
        (folder / "case.json").write_text(case)
        (folder / "input.log").write_text(text)
    cases, files = read_corpus(spark, str(tmp_path))
    graded = grade(cases, diagnose_inputs(decode_inputs(files), RULES))
    found = {r["name"]: (r["kind"], r["label"], r["predicted_status"]) for r in graded.collect()}
    assert found == {"oom": ("positive", "positive/oom", "diagnosed"), "quiet": ("negative", "negative/calm", "insufficient_evidence")}
    assert metrics(graded).first()["total"] == 2

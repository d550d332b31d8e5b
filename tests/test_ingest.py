from __future__ import annotations

import datetime as dt

from helpers import texts
from pyspark.sql import functions as F

from logclinic.operators.batch import batch_verdict
from logclinic.plans.ingest import decode_inputs, diagnose_inputs, ingest
from logclinic.sources.context import parse_context
from logclinic.sources.text_logs import read_inputs


def _sized(frame):
    return frame.withColumn("size", F.octet_length("text").cast("bigint"))


def test_json_forms_and_field_checks(spark):
    given = _sized(texts(spark, **{
        "ok.JSON": '[{"timestamp": 1700000000000, "msg": "", "message": "m", "severity": "warn", "eventAttributes": {"a": 1, "b": true}},'
                   ' {"timestamp": "2024-01-02T03:04:05Z", "stackTrace": "s", "errorType": "x.E", "source": "own"}]',
        "cut.json": '{"message": "x',
        "scalar.json": '"text"',
        "item.json": '[{"message": "a"}, 5]',
        "stage.json": '{"stage": 3}',
        "severity.json": '{"severity": "loud"}',
        "time.json": '{"timestamp": "noon"}',
        "nested.json": '{"resource_attributes": {"a": [1]}}',
        "empty.json": "[]",
        "lines.ndjson": '{"message": "a"}\n\n{"message": "b"}\n',
        "bad.jsonl": '{"message": "a"}\n{"message"\n7',
        "twice.json": '{"message": "a", "message": "b"}',
    }))
    parts = ingest(given)
    errors = {r["source"]: (r["seq"], r["reason"]) for r in parts.errors.collect()}
    assert errors == {
        "cut.json": (1, "invalid_json"), "scalar.json": (1, "not_object_or_array"), "item.json": (2, "item_not_object"),
        "stage.json": (1, "invalid_field:stage"), "severity.json": (1, "invalid_field:severity"),
        "time.json": (1, "invalid_field:timestamp"), "nested.json": (1, "invalid_field:resource_attributes"),
        "bad.jsonl": (2, "invalid_json"),
    }
    rows = {(r["source"], r["seq"]): r for r in parts.structured.collect()}
    first, second = rows["ok.JSON", 1], rows["ok.JSON", 2]
    assert first["timestamp"] == dt.datetime(2023, 11, 14, 22, 13, 20) and first["severity"] == "WARN"
    assert first["error_message"] == "m" and first["event_attributes"] == {"a": "1", "b": "true"}
    assert second["timestamp"] == dt.datetime(2024, 1, 2, 3, 4, 5) and second["platform"] == "unknown"
    assert (second["error_type"], second["stacktrace"], second["severity"]) == ("x.E", "s", "ERROR")
    assert ("lines.ndjson", 3) in rows and rows["twice.json", 1]["error_message"] == "b"


def test_files_of_every_kind(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    (tmp_path / "sub" / "oom.log").write_bytes(b"org.apache.spark\n\xff\xfe\njava.lang.OutOfMemoryError: heap\n")
    (tmp_path / "blank.txt").write_text(" \n\n")
    (tmp_path / "broken.json").write_text("{")
    report = diagnose_inputs(decode_inputs(read_inputs(spark, str(tmp_path)))).cache()
    rows = {r["source"].rsplit("/", 1)[-1]: r for r in report.collect()}
    assert rows["oom.log"]["status"] == "diagnosed" and rows["oom.log"]["matches"][0]["rule_id"] == "SPARK-001"
    assert rows["oom.log"]["matches"][0]["evidence"][0]["excerpt"].startswith("line 3: java.lang.OutOfMemoryError")
    assert (rows["blank.txt"]["status"], rows["blank.txt"]["event_count"]) == ("insufficient_evidence", 0)
    assert (rows["broken.json"]["status"], rows["broken.json"]["message"]) == ("input_error", "invalid_json at 1")
    verdict = batch_verdict(report).first()
    assert (verdict["total"], verdict["diagnosed"], verdict["errors"], verdict["fail_never"]) == (3, 1, 1, False)
    report.unpersist()


def test_size_guard_and_format_override(spark):
    given = _sized(texts(spark, **{"a.log": '{"message": "data skew"}', "b.log": "x" * 100}))
    parts = ingest(given, input_format="json", max_bytes=50)
    assert {r["source"]: r["reason"] for r in parts.errors.collect()} == {"b.log": "too_large"}
    assert parts.structured.first()["error_message"] == "data skew"


def test_context_forms(spark):
    found, errors = parse_context(texts(
        spark,
        a='{"current_run": "r1", "runs": [{"status": "ok"}, "r0"], "logs": ["x"], "metrics": {"m": 3, "k": {"value": 1, "name": "n"}},'
          ' "schemas": {"z": {"columns": ["c", "d"], "data_types": {"c": "int"}}, "y": {}}, "query_plan": "p"}',
        b='{"metrics": {"m": "many"}}',
        c="[1]",
    ))
    assert {r["source"]: r["reason"] for r in errors.collect()} == {"b": "metrics", "c": "not_a_mapping"}
    assert sorted((r["is_current"], r["run_id"], r["status"]) for r in found.runs.collect()) == [
        (False, "", "ok"), (False, "r0", "unknown"), (True, "r1", "unknown")]
    assert {(r["name"], r["value"]) for r in found.metrics.collect()} == {("m", 3.0), ("n", 1.0)}
    assert [(r["tbl_ord"], r["table_name"], r["column_name"], r["data_type"]) for r in found.schemas.orderBy("tbl_ord", "pos").collect()] == [
        (0, "z", "c", "int"), (0, "z", "d", None), (1, "y", None, None)]
    assert found.plans.count() == 1 and found.log_lines.first()["line"] == "x"


def test_one_scan_per_table_and_no_join_of_inputs(spark):
    """Inputs are parsed, validated and pooled inside their rows."""
    from workload.input_queries import input_status

    plan = input_status(spark, "/root/testdata/sf0.001")._jdf.queryExecution().sparkPlan().toString()
    assert plan.count("FileScan parquet") == 2
    assert "SortMergeJoin" not in plan and "anti" not in plan.lower()


def test_repeated_lines_and_wrong_items_keep_their_places(spark):
    rows = [
        ("a.jsonl", '\n{"message": "one"}\n\n[1]\n{'),
        ("b.json", '[{"message": "x"}, 5, {"severity": "loud"}]'),
        ("c.json", '{"severity": "loud"}'),
        ("d.json", "7"),
        ("e.jsonl", ""),
        ("f.json", '[]'),
        ("g.log", " \n"),
    ]
    given = spark.createDataFrame([(n, len(t), t) for n, t in rows], "source string, size long, text string")
    found = {r["source"]: (r["status"], r["message"], r["event_count"]) for r in diagnose_inputs(given).collect()}
    assert found["a.jsonl"][:2] == ("input_error", "not_object at 4")
    assert found["b.json"][:2] == ("input_error", "item_not_object at 2")
    assert found["c.json"][:2] == ("input_error", "invalid_field:severity at 1")
    assert found["d.json"][:2] == ("input_error", "not_object_or_array at 1")
    assert {n: found[n][0] for n in ("e.jsonl", "f.json", "g.log")} == dict.fromkeys(("e.jsonl", "f.json", "g.log"), "insufficient_evidence")
    assert all(found[n][2] == 0 for n in ("e.jsonl", "f.json", "g.log"))
    small = {r["source"]: r["message"] for r in diagnose_inputs(given, max_bytes=10).collect()}
    assert small["a.jsonl"] == "too_large"


def test_contexts_are_parsed_in_one_pass_by_many_tasks(spark):
    """All tables come from one scan; texts are dealt before they are parsed, as the given table may be a single file."""
    from workload.context_queries import context_normalize

    plan = context_normalize(spark, "/root/testdata/sf0.001")._jdf.queryExecution().sparkPlan().toString()
    assert plan.count("FileScan parquet") == 1
    assert "REPARTITION_BY_NUM" in context_normalize(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "Union" not in plan


def test_an_event_is_read_in_one_pass_over_its_keys(spark):
    """No search per key and alias; keys that differ in case only, JSON nulls and null items keep their meaning."""
    rows = [
        ("a.json", '[{"stackTrace": "s1", "error_type": null, "errorType": "x.AError", "job": "j"}, null]'),
        ("b.json", '{"stacktrace": "", "stackTrace": "java.lang.OutOfMemoryError: org.apache.spark", "msg": null, "severity": null, "platform": null}'),
        ("c.jsonl", '{"stacktrace": "one", "stackTrace": "two", "message": "", "errorMessage": "data skew", "platform": "spark"}\n'),
        ("d.json", "null"),
        ("e.json", '{"message": "data skew", "other": {"message": 5}, "timestamp": true, "event_attributes": {}}'),
    ]
    given = spark.createDataFrame([(n, len(t), t) for n, t in rows], "source string, size long, text string")
    report = diagnose_inputs(given)
    found = {r["source"]: r for r in report.collect()}
    shown = {n: (r["status"], r["message"]) for n, r in found.items() if r["status"] == "input_error"}
    assert shown == {"a.json": ("input_error", "item_not_object at 2"), "d.json": ("input_error", "not_object_or_array at 1")}
    assert found["b.json"]["matches"][0]["rule_id"] == "SPARK-001" and found["b.json"]["platform"] == "spark"
    assert found["c.jsonl"]["matches"][0]["rule_id"] == "SPARK-005" and found["c.jsonl"]["platform"] == "spark"
    assert found["e.json"]["matches"][0]["rule_id"] == "SPARK-005"
    plan = report._jdf.queryExecution().optimizedPlan().toString()
    assert "$.message" not in plan and "$.errorType" not in plan

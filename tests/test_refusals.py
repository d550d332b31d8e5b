"""Nothing is lost in silence: wrong containers, absent lists, unknown severities, long names."""

from __future__ import annotations

import json
import re

import pytest

from logclinic.functions.exceptions import NAME_PATTERN, exception_types
from logclinic.operators.context_tools import compare_runs
from logclinic.operators.validate import scan_rules, validate_rules
from logclinic.rules.base import RuleBase
from logclinic.sources.context import parse_context

GOOD_RULE = {"rule_id": "OWN-001", "name": "Own", "category": "own.thing", "platforms": ["spark"], "exceptions": ["LateError"], "hypotheses": ["h"], "refs": [{"title": "t", "url": "u"}]}


@pytest.mark.parametrize(
    ("given", "reason"),
    [
        ({"logs": "one line"}, "log_lines"),
        ({"log_lines": ["a", 1]}, "log_lines"),
        ({"previous_runs": {"a": 1}}, "previous_runs"),
        ({"runs": [{"run_id": "a", "status": 5}]}, "previous_runs"),
        ({"current_run": {"job": []}}, "current_run"),
        ({"metrics": [1]}, "metrics"),
        ({"metrics": {"m": {"value": "many"}}}, "metrics"),
        ({"metrics": {"m": {"value": 1, "labels": {"a": 1}}}}, "metrics"),
        ({"schemas": "s"}, "schemas"),
        ({"schemas": {"t": {"columns": "a"}}}, "schemas"),
        ({"schemas": {"t": {"columns": ["a"], "data_types": ["int"]}}}, "schemas"),
        ({"query_plan": 7}, "query_plan"),
        ([], "not_a_mapping"),
        ({"logs": None, "metrics": None, "schemas": None, "previous_runs": None, "current_run": None, "query_plan": None}, None),
        ({"logs": ["a"], "metrics": {"m": 1, "n": {"value": 2.5}}, "schemas": {"t": {"columns": ["a"]}}, "runs": ["r", {"run_id": "s"}], "query_plan": "Scan"}, None),
    ],
)
def test_context_of_a_wrong_kind_is_rejected(spark, given, reason):
    errors = parse_context(spark.createDataFrame([("s", json.dumps(given))], "source string, text string")).errors.collect()
    assert [r["reason"] for r in errors] == ([reason] if reason else [])


def problems(spark, **changes):
    rule = {k: v for k, v in {**GOOD_RULE, **changes}.items() if v is not None}
    good, _ = scan_rules(spark.createDataFrame([(json.dumps(rule),)], "text string"))
    return good, sorted(r["problem"] for r in validate_rules(good).collect())


@pytest.mark.parametrize(
    ("changes", "found"),
    [
        ({}, []),
        ({"platforms": None}, ["no_platform"]),
        ({"exceptions": None}, ["no_trigger"]),
        ({"hypotheses": None, "refs": None}, ["no_hypothesis", "no_reference"]),
        ({"severity": "bogus"}, ["invalid_severity"]),
        ({"name": None, "category": None}, ["invalid_category", "no_name"]),
        ({"positive": ["BAD NAME"], "negative": None}, ["invalid_signal"]),
        ({"positive": ["data_skew", "data_skew"]}, ["duplicate_signal"]),
    ],
)
def test_rule_problems(spark, changes, found):
    good, seen = problems(spark, **changes)
    assert seen == found
    if set(found) - {"no_trigger", "no_hypothesis", "no_reference"}:
        with pytest.raises(ValueError, match=found[0]):
            RuleBase.from_table(good)
    else:
        assert RuleBase.from_table(good).table(spark).first()["severity_rank"] == 2


def test_all_bad_rules_are_reported_together(spark):
    rules = [{**GOOD_RULE, "severity": "bogus"}, {**GOOD_RULE, "rule_id": "bad", "platforms": []}]
    good, _ = scan_rules(spark.createDataFrame([(json.dumps(r),) for r in rules], "text string"))
    with pytest.raises(ValueError, match=r"(?s)OWN-001: invalid_severity.*bad: invalid_id.*bad: no_platform"):
        RuleBase.from_table(good)


def test_exception_names_of_any_length(spark):
    long = ".".join(f"p{k}" for k in range(200)) + ".DeepError"
    texts = [
        long, f"x {'y.' * 3000}TallFailure: z", "a..bError", "1a.bError c.1d.eError", "FooError.1x", "FooErrorBar FooErrorBarError", "Error a.Error MyError", "éFooError a.FooError.",
        "a.FooException.bar.Baz", ".x.MyException, y.OtherFailure.z.ThirdError.w", "no names", "_x.A_bError-cError",
    ]
    frame = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "k int, t string")
    got = {r["k"]: r["names"] for r in frame.select("k", exception_types(frame.t).alias("names")).collect()}
    for k, t in enumerate(texts):
        want = []
        for name in re.findall(NAME_PATTERN, t):
            want += [name, name.rsplit(".", 1)[-1]]
        assert got[k] == list(dict.fromkeys(want)), t


def test_named_runs(spark):
    runs = spark.createDataFrame(
        [("s", 0, True, "now", "failed", "j", "1", None), ("s", 1, False, "old", "done", "j", "2", None), ("s", 2, False, "older", "done", "j", "3", None)],
        "source string, ordinal long, is_current boolean, run_id string, status string, job string, stage string, error string",
    )
    plain = compare_runs(runs).first()
    assert (plain["base_run"], plain["other_run"]) == ("now", "old")
    wanted = spark.createDataFrame([("s", "older", None), ("t", "now", "old")], "source string, base string, other string")
    named = compare_runs(runs, wanted).collect()
    assert [(r["base_run"], r["other_run"]) for r in named] == [("older", "old")]
    assert compare_runs(runs, spark.createDataFrame([("s", "gone", "old")], wanted.schema)).count() == 0

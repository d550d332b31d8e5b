"""A source cut into many pieces must give the report of the whole source."""

from __future__ import annotations

import random
import re

import pytest
from helpers import events
from pyspark.sql import functions as F

from logclinic.operators.pooling import pool
from logclinic.operators import features, pooling
from logclinic.plans.diagnose import diagnose_events
from logclinic.rules.base import RuleBase
from logclinic.sinks import render
from workload.templates import FAILURES, QUIET

FIELDS = ["platform", "event_count", "error_types", "matches", "status", "message"]


def _rows(spark, piece_bytes):
    rng = random.Random(7)
    rows = []
    for source in range(6):
        for seq in range(60):
            quiet = rng.random() < 0.8
            template = rng.choice(list(QUIET.values()) if quiet else FAILURES)
            fields = {k: v for k, v in template.fields.items() if k != "event_attributes"}
            rows.append({"source": f"s{source}", "seq": seq * 3, **fields})
    # words of one signal spread over neighbouring events, and a blank event in between
    for source, words in {"x1": ["data", "skew"], "x2": ["too many", "  ", "small", "files"], "x3": ["call to a.collect", "x" * 50, "OutOfMemoryError"]}.items():
        rows += [{"source": source, "seq": i, "error_message": w} for i, w in enumerate(words)]
        rows += [{"source": source, "seq": 10 + i, "error_message": f"calm line {i}"} for i in range(20)]
    frame = diagnose_events(events(spark, *rows), piece_bytes=piece_bytes)
    return {r["source"]: {f: r[f] for f in FIELDS} for r in frame.collect()}


@pytest.fixture
def small_buckets(monkeypatch):
    """Few positions to a bucket, few buckets to a merge: every level of the tree has work."""
    monkeypatch.setattr(pooling, "FINE_ROWS", 8)
    monkeypatch.setattr(features, "MERGE_BITS", 2)


def test_cut_sources_give_the_same_reports(spark, small_buckets):
    whole = _rows(spark, pooling.PIECE_BYTES)
    cut = _rows(spark, 200)
    assert whole.keys() == cut.keys()
    for source in whole:
        assert cut[source] == whole[source], source
    assert [m["rule_id"] for m in whole["x1"]["matches"]] == ["SPARK-005"]
    assert [m["rule_id"] for m in whole["x2"]["matches"]] == ["PERF-001"]
    assert [m["rule_id"] for m in whole["x3"]["matches"]] == ["SPARK-002"]


def _facts(frame, piece_bytes):
    found = features.source_features(frame, RuleBase.shipped(), piece_bytes)
    ordered = ["error_types", "observed", "exception_keys", "signal_cites", "exception_cites"]
    return {r["source"]: {k: sorted(map(str, r[k])) if k in ordered else r[k] for k in r.asDict()} for r in found.collect()}


NOISE = ["\n", "\n\n", "  \n ", "\t", " ", "", "plain", "words here", "\r", "\u2028", "'", "lines\nof\ntext\n" * 12]
#: Words that make up phrases together.
FAMILIES = [
    ["column", "reference", "'", '"', "'x'", "'a\nb'", "cannot", "be resolved", "cannot be resolved", "is ambiguous", "is"],
    ["column '", "' cannot", "' cannot be resolved", "be resolved", "cannot resolve `", "` in given schema", "in", "given schema", "x" * 30],
    ["table or view", "the table or view", "'", "'x'", "not found", "not", "found", "cannot be found", "some name", "cannot"],
    ["data", "skew", "data skew", "ſkew", "too many", "small", "files", "invalid", "authentication", "invalid authentication", "failed"],
    ["cannot be cast to", "cannot be", "cast to", "due to an overflow", "date", "int", "12", "due", "to an overflow"],
    ["access", "token", "expired", "token is expired", "activity", "timed", "out", "timed out", "linked", "service", "service failed"],
    ["call to", "x.collect", "OutOfMemoryError", "java.lang.OutOfMemoryError", "driver", "stack trace", "out of", "memory on the driver"],
    ["failed 4", "times, most recent failure", "times;", "aborting job", "failed", "7 times;", "the activity", "did not", "complete", "within the configured timeout"],
    ["  at", "at", "at ", "  at a.B.c(D.java:1)", "a.B.c(D.java:1)", "\n  ", "a.b.FooException", "java.lang.IllegalStateException: x", "org.apache.spark", "FetchFailedException", "at FetchFailedException"],
]


@pytest.mark.parametrize("seed", [1, 2])
def test_any_cuts_give_the_facts_of_the_whole(spark, small_buckets, seed):
    """Words of phrases, quotation marks and white space in any order; every event a piece of its own."""
    rng = random.Random(seed)
    rows = []
    for source in range(400):
        words = [*FAMILIES[source % len(FAMILIES)], *rng.sample(NOISE, 3)]
        for seq in range(rng.randrange(2, 40)):
            message = rng.choice([" ", "\n", ""]).join(rng.choices(words, k=rng.randrange(1, 4)))
            column = "payload_text" if source % 4 == 0 and rng.random() < 0.5 else "error_message"
            rows.append({"source": f"s{source}", "seq": seq, column: message})
    frame = events(spark, *rows).repartition(4).cache()
    pooling.FINE_ROWS = 1 << 16  # all of a source in one bucket
    whole = _facts(frame, pooling.PIECE_BYTES)
    pooling.FINE_ROWS = 8
    cut = _facts(frame, 1)
    shown = {s for facts in whole.values() for s in facts["signals"]}
    assert {"data_skew", "resolved_column_not_found", "ambiguous_reference", "driver_oom", "stacktrace_present", "table_or_view_not_found", "adf_activity_timeout", "task_failure_repeated", "invalid_numeric_value"} <= shown
    for source in whole:
        assert cut[source] == whole[source], source


@pytest.mark.parametrize("piece_bytes", [500, 70_000, 400_000])
def test_matches_a_mebibyte_long(spark, piece_bytes):
    calm = [f"calm line {i} of many" for i in range(1000)]
    blank = [" \n\t" * 40] * 9000
    sources = {
        "name": ["column 'a", *calm * 45, "z' cannot", "be resolved"],
        "broken name": ["column 'a", *calm * 45, "it's here", *calm, "z' cannot be resolved"],
        "phrase": ["we saw data", *blank, "skew in the stage"],
        "broken phrase": ["we saw data", *blank[:4000], "x", *blank[:4000], "skew in the stage"],
        "memory": ["java.lang.OutOfMemoryError", *calm * 45, "driver stack trace"],
    }
    rows = [{"source": s, "seq": i, "error_message": m} for s, own in sources.items() for i, m in enumerate(own)]
    frame = events(spark, *rows)
    found = {s: set(f["signals"]) for s, f in _facts(frame, piece_bytes).items()}
    assert "resolved_column_not_found" in found["name"] and "resolved_column_not_found" not in found["broken name"]
    assert "data_skew" in found["phrase"] and "data_skew" not in found["broken phrase"]
    assert {"driver_oom", "executor_oom"} <= found["memory"]


def test_pieces_are_bounded_and_ordered(spark):
    rows = [{"source": "big", "seq": i, "error_message": f"{i:04d}" + "y" * 96} for i in range(500)]
    frame = events(spark, *rows, {"source": "small", "seq": 0, "error_message": "z"})
    pieces = pooling.pool(frame, 2000).withColumn("n", F.length("text")).orderBy("source", "fine", "part").collect()
    big = [p for p in pieces if p["source"] == "big"]
    assert max(p["n"] for p in big) <= 2000 + 200 and len(big) > 20
    assert "\n".join(p["text"] for p in big) == "\n".join(r["error_message"] for r in rows)
    assert [p["text"] for p in pieces if p["source"] == "small"] == ["z"]


def test_the_plan_needs_no_job_and_no_window_over_a_source(spark):
    frame = events(spark, {"source": "a", "seq": 0, "error_message": "data skew"})
    tracker = spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup("plan", "building the plan")
    found = features.source_features(frame, RuleBase.shipped())
    assert not tracker.getJobIdsForGroup("plan")
    spark.sparkContext.setJobGroup("run", "running it")
    windows = re.findall(r"windowspecdefinition\(([^)]*)", found._jdf.queryExecution().analyzed().toString())
    assert windows and all(re.match(r"source#\d+, fine#", w) for w in windows)


def test_leading_text_of_cut_sources(spark, small_buckets):
    rng = random.Random(4)
    rows = []
    for source in range(60):
        for seq in range(rng.randrange(1, 40)):
            rows.append({"source": f"s{source}", "seq": seq, "error_message": rng.choice(["", "x", "line\n", "\n", "cr\r", "two\nlines", "w" * rng.choice([10, 900]), " \r\n"])})
    rows += [{"source": "long", "seq": i, "error_message": f"{i} " + "w" * 300} for i in range(200)]
    frame = events(spark, *rows)
    want = {r["source"]: r["excerpt"] for r in render._input_excerpt(frame).collect()}
    pooling.FINE_ROWS = 1 << 16
    assert {r["source"]: r["excerpt"] for r in render._input_excerpt(frame, 1).collect()} == want
    pooling.FINE_ROWS = 8
    assert any(len(x) == render.PROMPT_CHARS for x in want.values()) and all(x is not None for x in want.values())


def test_scanning_tasks_are_not_merged_by_their_bytes(spark):
    """One shuffle of the events, into the session's number of tasks: pieces are small for what scanning them costs."""
    rows = events(spark, {"error_message": "a", "seq": 1}, {"error_message": "b", "seq": 2})
    plan = pool(rows)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and "REPARTITION_BY_NUM" in plan
    assert pool(rows).rdd.getNumPartitions() == int(spark.conf.get("spark.sql.shuffle.partitions"))

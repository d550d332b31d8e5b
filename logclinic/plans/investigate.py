"""Reports plus context tables to investigation records."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import DataFrame

from logclinic.operators import investigate as I
from logclinic.operators.reports import top_matches
from logclinic.rules.base import RuleBase
from logclinic.session import ensure_checkpoint_dir


class Investigation(NamedTuple):
    plan: DataFrame
    results: DataFrame
    verified: DataFrame
    record: DataFrame


def investigation(
    reports: DataFrame,
    context: I.Context,
    rules: RuleBase | None = None,
    max_iterations: int = I.MAX_ITERATIONS,
    max_calls: int = I.MAX_CALLS,
    allowed: list[str] | None = None,
) -> Investigation:
    """Investigate the leading diagnosis of every report that has one.

    The probe plan is read by every tool, so it is checkpointed: one small row per source instead of a diagnosis
    repeated a dozen times.
    """
    rules = rules or RuleBase.shipped()
    ensure_checkpoint_dir(reports.sparkSession)
    asked = I.targets(top_matches(reports), rules)
    plan = I.planned(asked, I.context_summary(context)).checkpoint()
    probes = I.plan_probes(plan)
    lines = I.probe_lines(probes, context, rules).checkpoint()
    results = I.run_probes(probes, lines)
    verified = I.verify_probes(results, I.probe_signals(lines, rules), plan)
    record = I.investigate(plan, verified, max_iterations, max_calls, allowed)
    return Investigation(plan, results, verified, record)

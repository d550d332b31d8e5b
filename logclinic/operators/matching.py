"""Rules applied to source facts: one broadcast join, no shuffle."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logclinic.functions import scoring
from logclinic.functions.platforms import UNKNOWN
from logclinic.functions.signals import HEURISTIC
from logclinic.operators.features import excerpt_block
from logclinic.rules.base import RuleBase, signal_table


def trigger_keys() -> Column:
    return F.concat(
        F.transform("signals", lambda s: F.concat(F.lit("signal:"), s)),
        F.transform("exception_keys", lambda e: F.concat(F.lit("exception:"), e)),
    )


def _first_cite(cites: str, matched: str) -> Column:
    """Excerpt of the earliest citation that belongs to the match; the struct order is the line order."""
    first = F.array_min(F.filter(cites, lambda c: F.array_contains(matched, c["name"])))
    return F.when(first.isNotNull(), excerpt_block(first))


def match_rules(
    features: DataFrame, rules: RuleBase, keep_unmatched: bool = False, keep_cites: bool = False
) -> DataFrame:
    """One row per (source, matching rule) with score and evidence inputs.

    With ``keep_unmatched`` every source appears at least once, ``rule_id`` being null on rows without a match.
    """
    keyed = features.withColumn("keys", trigger_keys()).withColumn("trigger", F.explode_outer("keys"))
    applies = (
        (F.col("f.trigger") == F.col("r.trigger"))
        & ((F.col("f.platform") == UNKNOWN) | F.array_contains("r.platforms", F.col("f.platform")))
        & ~F.arrays_overlap("f.signals", "r.negative")
        # several observations may trigger one rule: only the first of them speaks for it
        & (F.get(F.array_intersect("r.rule_keys", "f.keys"), F.lit(0)) == F.col("f.trigger"))
    )
    joined = keyed.alias("f").join(
        F.broadcast(rules.triggers(features.sparkSession)).alias("r"), applies, "left" if keep_unmatched else "inner"
    )
    heuristic = F.array(*[F.lit(s) for s in sorted(HEURISTIC)])
    matched = (
        joined.select("f.*", *[F.col(f"r.{c}") for c in _RULE_COLUMNS])
        .withColumn("matched_signals", F.array_sort(F.array_intersect("positive", "signals")))
        .withColumn("exact_signals", F.array_except("matched_signals", heuristic))
        .withColumn("heuristic_signals", F.array_intersect("matched_signals", heuristic))
        .withColumn("matched_exceptions", F.array_sort(F.array_intersect("exceptions", "exception_keys")))
        .withColumn("platform_match", F.col("platform") != UNKNOWN)
        .withColumn("signal_excerpt", _first_cite("signal_cites", "matched_signals"))
        .withColumn("exception_excerpt", _first_cite("exception_cites", "matched_exceptions"))
        .withColumn(
            "score",
            scoring.score(
                F.size("exact_signals"),
                F.size("heuristic_signals"),
                F.size("matched_exceptions") > 0,
                F.col("platform_match"),
                F.col("has_metadata"),
            ),
        )
        .withColumn("band", scoring.band(F.col("score")))
    )
    if keep_cites:
        return matched
    return matched.drop("keys", "trigger", "signal_cites", "exception_cites", "positive", "exceptions")


def match_positive(features: DataFrame, rules: RuleBase) -> DataFrame:
    """(source, rule_id, signal) for every observed signal that supports a rule."""
    return _by_signal(features, rules, "positive")


def match_uncontradicted(features: DataFrame, rules: RuleBase) -> DataFrame:
    """(source, rule_id, signal) for every supporting signal of a rule none of whose negative signals was observed."""
    declared = rules.table(features.sparkSession).select("rule_id", "negative", F.explode("positive").alias("signal"))
    observed = features.select("source", "signals", F.explode("signals").alias("signal"))
    joined = observed.join(F.broadcast(declared), "signal").where(~F.arrays_overlap("signals", "negative"))
    return joined.select("source", "rule_id", "signal")


def match_negative(features: DataFrame, rules: RuleBase) -> DataFrame:
    """(source, rule_id) for every rule one of whose negative signals was observed."""
    return _by_signal(features, rules, "negative").select("source", "rule_id").distinct()


def _by_signal(features: DataFrame, rules: RuleBase, polarity: str) -> DataFrame:
    declared = signal_table(rules.table(features.sparkSession), polarity).select("rule_id", "signal")
    observed = features.select("source", F.explode("signals").alias("signal"))
    return observed.join(F.broadcast(declared), "signal").select("source", "rule_id", "signal")


def match_exceptions(features: DataFrame, rules: RuleBase) -> DataFrame:
    """(source, rule_id, exception) where an observed name is, or ends in a dot and, the declared one."""
    declared = rules.table(features.sparkSession).select("rule_id", F.explode("exceptions").alias("exception"))
    observed = features.select("source", F.explode("exception_keys").alias("exception"))
    return observed.join(F.broadcast(declared), "exception").select("source", "rule_id", "exception")


def with_rule_attributes(matches: DataFrame, rules: RuleBase) -> DataFrame:
    """Add the descriptive attributes of the rules."""
    return matches.join(F.broadcast(rules.table(matches.sparkSession)), "rule_id")


_RULE_COLUMNS = ["rule_id", "name", "category", "severity_rank", "platforms", "exceptions", "positive", "n_actions"]

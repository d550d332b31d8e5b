"""The rule base as a small, size-checked dimension."""

from __future__ import annotations

from collections import Counter
from collections.abc import Sequence
from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from logclinic import schema
from logclinic.functions.scoring import SEVERITY_ORDER, severity_rank
from logclinic.rules.catalog import FAMILY_ACTIONS, FAMILY_REFERENCES, RULES, Rule

#: Rules are held in memory and broadcast; a larger table is refused instead of broadcast.
MAX_RULES = 10_000


# --- fixed values -----------------------------------------------------------------------------------------
RULE_ID = r"^[A-Z0-9]+-\d{3}$"
SIGNAL_NAME = r"^[a-z][a-z0-9_]*$"
CATEGORY = r"^[a-z0-9]+(\.[a-z0-9_]+)*$"
PLATFORM = r"^[a-z][a-z0-9_-]*$"
DEFAULT_SEVERITY = "medium"
# ----------------------------------------------------------------------------------------------------------


def with_defaults(rules: DataFrame) -> DataFrame:
    """Absent lists become empty ones, an absent severity the default one."""
    lists = [f for f in schema.RULES.fields if f.dataType.typeName() == "array"]
    filled = {f.name: F.coalesce(f.name, F.array().cast(f.dataType)) for f in lists}
    return rules.withColumns({**filled, "severity": F.coalesce("severity", F.lit(DEFAULT_SEVERITY))})


def format_checks() -> dict[str, Column]:
    """What makes a definition unusable, over rules with defaults."""
    bad = lambda names, pattern: F.exists(names, lambda n: n.isNull() | ~F.rlike(n, F.lit(pattern)))
    repeated = lambda names: F.size(F.array_distinct(names)) < F.size(names)
    missing = lambda c, pattern: F.col(c).isNull() | ~F.rlike(c, F.lit(pattern))
    return {
        "invalid_id": missing("rule_id", RULE_ID),
        "no_name": F.col("name").isNull(),
        "invalid_category": missing("category", CATEGORY),
        "invalid_severity": ~F.col("severity").isin(*SEVERITY_ORDER),
        "no_platform": F.size("platforms") == 0,
        "invalid_platform": bad("platforms", PLATFORM),
        "duplicate_platform": repeated("platforms"),
        "invalid_signal": bad(F.concat("positive", "negative"), SIGNAL_NAME),
        "duplicate_signal": repeated("positive") | repeated("negative"),
    }


def problems_of(rules: DataFrame, checks: dict[str, Column]) -> DataFrame:
    """(rule_id, problem) for every check that a rule fails."""
    found = F.array_compact(F.array(*[F.when(broken, F.lit(name)) for name, broken in checks.items()]))
    return with_defaults(rules).select("rule_id", F.explode(found).alias("problem"))


def format_problems(rules: DataFrame) -> DataFrame:
    return problems_of(rules, format_checks())


class RuleBase:
    """Declarative diagnoses, shipped or read from a table with the columns of ``schema.RULES``."""

    def __init__(self, rows: Sequence[tuple]) -> None:
        self.rows = sorted(rows, key=lambda r: r[0])

    @classmethod
    def shipped(cls) -> RuleBase:
        return cls([_row(rule) for rule in RULES])

    @classmethod
    def from_table(cls, rules: DataFrame, max_rules: int = MAX_RULES) -> RuleBase:
        rows = rules.select(schema.RULES.fieldNames()).limit(max_rules + 1).collect()
        if not rows:
            raise ValueError("the rule table is empty")
        if len(rows) > max_rules:
            raise ValueError(f"the rule table holds more than {max_rules} rules")
        problems = [f"{i}: duplicate_id" for i, n in Counter(r["rule_id"] for r in rows).items() if n > 1]
        # at most max_rules rows, all their problems reported together
        wrong = format_problems(rules.sparkSession.createDataFrame(rows, schema.RULES)).collect()
        problems += [f"{r['rule_id']}: {r['problem']}" for r in wrong]
        if problems:
            raise ValueError("invalid rules:\n" + "\n".join(sorted(problems)))
        return cls([tuple(r) for r in rows])

    @cached_property
    def declared_exceptions(self) -> list[str]:
        return sorted({name for row in self.rows for name in row[5] or []})

    def table(self, spark: SparkSession) -> DataFrame:
        """One row per rule, ordered lists as arrays, plus ``severity_rank``."""
        rules = with_defaults(spark.createDataFrame(self.rows, schema.RULES))
        return rules.withColumn("severity_rank", severity_rank(F.col("severity")))

    def triggers(self, spark: SparkSession) -> DataFrame:
        """(key, rule...) with one row per observation that can make a rule match.

        A rule with positive signals needs one of them; only a rule without any may match on its exceptions.
        """
        keyed = F.when(
            F.size("positive") > 0, F.transform("positive", lambda s: F.concat(F.lit("signal:"), s))
        ).otherwise(F.transform("exceptions", lambda e: F.concat(F.lit("exception:"), e)))
        return (
            self.table(spark)
            .withColumn("rule_keys", keyed)
            .withColumn("trigger", F.explode("rule_keys"))
            .withColumn("n_actions", F.size("immediate") + F.size("recommended") + F.size("prevention"))
            .drop("hypotheses", "immediate", "recommended", "prevention", "refs", "severity")
        )


def _row(rule: Rule) -> tuple:
    now, later, never = (list(pair) for pair in zip(rule.actions, FAMILY_ACTIONS[rule.family], strict=True))
    return (
        rule.rule_id, rule.name, rule.category, rule.severity, rule.platforms, rule.exceptions, rule.positive,
        rule.negative, rule.hypotheses, now, later, never, FAMILY_REFERENCES[rule.family],
    )


def signal_table(rules: DataFrame, polarity: str) -> DataFrame:
    """(rule_id, signal, ordinal) of one polarity, ``positive`` or ``negative``."""
    return rules.select("rule_id", F.posexplode(polarity).alias("ordinal", "signal"))

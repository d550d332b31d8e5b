"""Checks of a rule table against its format, the signal registry and the labelled cases."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from logclinic import schema
from logclinic.functions.signals import ALL_SIGNALS
from logclinic.functions.text import padded
from logclinic.rules.base import format_checks, problems_of, signal_table, with_defaults
from logclinic.rules.catalog import FAMILIES

def scan_rules(texts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """JSON rule texts to rules (absent lists empty) and problems; an id given twice is a problem and none of its rules is kept."""
    parsed = texts.select(F.from_json("text", schema.RULES).alias("rule")).select("rule.*")
    unreadable = parsed.where("rule_id IS NULL").select(F.lit(None).cast("string").alias("rule_id"), F.lit("unreadable").alias("problem"))
    counts = parsed.where("rule_id IS NOT NULL").groupBy("rule_id").agg(F.count("*").alias("n"))
    twice = counts.where("n > 1").select("rule_id", F.lit("duplicate_id").alias("problem"))
    good = parsed.join(counts.where("n = 1").select("rule_id"), "rule_id", "left_semi")
    return with_defaults(good), twice.unionByName(unreadable)


def validate_rules(rules: DataFrame) -> DataFrame:
    """(rule_id, problem) for every format rule a definition breaks and for everything it lacks."""
    complete = {
        "no_trigger": (F.size("exceptions") == 0) & (F.size("positive") == 0),
        "no_hypothesis": F.size("hypotheses") == 0,
        "no_reference": F.size("refs") == 0,
    }
    return problems_of(rules, {**format_checks(), **complete})


def registry(spark: SparkSession) -> DataFrame:
    """The signals an extractor exists for; a fixed table of a few dozen rows."""
    return spark.createDataFrame([(s,) for s in ALL_SIGNALS], "signal string")


def validate_refs(rules: DataFrame, cases: DataFrame, fixtures: DataFrame) -> DataFrame:
    """(rule_id, problem, subject): signals without extractor, unused signals, rules no positive case expects, and
    fixtures (rule_id, fixture) that are not among the cases."""
    known = registry(rules.sparkSession)
    declared = signal_table(rules, "positive").unionByName(signal_table(rules, "negative")).select("rule_id", "signal").distinct()
    dangling = declared.join(F.broadcast(known), "signal", "left_anti").select(
        "rule_id", F.lit("unknown_signal").alias("problem"), F.col("signal").alias("subject")
    )
    unused = known.join(declared, "signal", "left_anti").select(
        F.lit(None).cast("string").alias("rule_id"), F.lit("unused_signal").alias("problem"), F.col("signal").alias("subject")
    )
    expected = cases.where("kind = 'positive'").select(F.explode("expected_ids").alias("rule_id")).distinct()
    uncovered = rules.select("rule_id").join(expected, "rule_id", "left_anti").select(
        "rule_id", F.lit("no_positive_case").alias("problem"), F.col("rule_id").alias("subject")
    )
    missing = fixtures.join(cases.select(F.col("label").alias("fixture")).distinct(), "fixture", "left_anti").select(
        "rule_id", F.lit("unknown_fixture").alias("problem"), F.col("fixture").alias("subject")
    )
    return dangling.unionByName(unused).unionByName(uncovered).unionByName(missing)


def catalog_list(rules: DataFrame) -> DataFrame:
    return rules.select("rule_id", "name", "category", "severity", F.array_join("platforms", ", ").alias("platforms"))


def catalog_groups(rules: DataFrame) -> DataFrame:
    """Rules per family with its title; known families in display order, others behind them by first id."""
    family = F.split("category", r"\.")[0]
    order = F.array(*[F.lit(f) for f in FAMILIES])
    titles = F.create_map(*[F.lit(x) for pair in FAMILIES.items() for x in pair])
    place = F.array_position(order, F.col("family"))
    return (
        rules.groupBy(family.alias("family"))
        .agg(F.count("*").alias("n_rules"), F.max(F.length("name")).cast("bigint").alias("name_width"), F.min("rule_id").alias("first_id"))
        .withColumn("title", F.coalesce(F.try_element_at(titles, F.col("family")), F.initcap(F.translate("family", "_", " "))))
        .withColumn("place", F.when(place == 0, len(FAMILIES) + 1).otherwise(place).cast("bigint"))
    )


def catalog_text(rules: DataFrame) -> DataFrame:
    """(family, place, text): a title with the number of rules, then one aligned line per rule in the order of ids.

    A family is part of a rule base of checked size.
    """
    groups = catalog_groups(rules).select("family", "title", "n_rules", "name_width", "place")
    placed = rules.withColumn("family", F.split("category", r"\.")[0]).join(groups, "family")
    pad = F.repeat(F.lit(" "), (F.col("name_width") - F.length("name")).cast("int"))
    line = F.concat(
        F.lit("  "), padded(F.col("rule_id"), 18), F.lit(" "), "name", pad, F.lit("  "), padded(F.col("severity"), 8), F.lit(" "), F.array_join("platforms", ", ")
    )
    grouped = placed.groupBy("family", "place", "title", "n_rules").agg(F.array_sort(F.collect_list(F.struct("rule_id", line.alias("line")))).alias("members"))
    head = F.concat("title", F.lit(" ("), F.col("n_rules").cast("string"), F.lit(")"))
    return grouped.select("family", "place", F.concat_ws("\n", head, F.col("members.line")).alias("text"))

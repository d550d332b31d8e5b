"""End-to-end plans: raw inputs or event tables to reports."""

from __future__ import annotations

from pyspark.sql import DataFrame

from logclinic.operators.features import source_features, text_features
from logclinic.operators.pooling import PIECE_BYTES, pool_single
from logclinic.operators.reports import reports
from logclinic.rules.base import RuleBase
from logclinic.sources.text_logs import text_events


def features_of_texts(texts: DataFrame, rules: RuleBase) -> DataFrame:
    """Raw logs (source, text): one event per source, so everything up to the report is narrow."""
    return text_features(pool_single(text_events(texts)), rules)


def diagnose_events(events: DataFrame, rules: RuleBase | None = None, piece_bytes: int = PIECE_BYTES) -> DataFrame:
    """Reports for an event table (``schema.EVENTS``), one per source."""
    rules = rules or RuleBase.shipped()
    return reports(source_features(events, rules, piece_bytes), rules)


def diagnose_texts(texts: DataFrame, rules: RuleBase | None = None) -> DataFrame:
    """Reports for raw logs (source, text), one per non-blank source."""
    rules = rules or RuleBase.shipped()
    return reports(features_of_texts(texts, rules), rules)

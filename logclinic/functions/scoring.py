"""Evidence weights, score and confidence band."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# --- fixed values -----------------------------------------------------------------------------------------
WEIGHTS = {
    "error_signature": 40,
    "platform_match": 20,
    "stacktrace_evidence": 20,
    "correlated_signal": 15,
    "supporting_metadata": 5,
}
MAX_SCORE = 100
HIGH_FROM, MEDIUM_FROM = 70, 40
SCORING_MODEL_VERSION = "1"
REPORT_SCHEMA_VERSION = "4"
SEVERITY_ORDER = ["critical", "high", "medium", "low"]
NO_MATCH_MESSAGE = (
    "No diagnosis matched the available evidence. There is insufficient evidence to support a conclusion."
)
# ----------------------------------------------------------------------------------------------------------


def score(exact: Column, heuristic: Column, has_exception: Column, platform_match: Column, metadata: Column) -> Column:
    """Capped sum of weights; the first two arguments are counts, the others booleans."""
    flag = lambda c, w: F.when(c, F.lit(w)).otherwise(F.lit(0))
    total = (
        exact * WEIGHTS["error_signature"]
        + heuristic * WEIGHTS["correlated_signal"]
        + flag(has_exception, WEIGHTS["stacktrace_evidence"])
        + flag(platform_match, WEIGHTS["platform_match"])
        + flag(metadata, WEIGHTS["supporting_metadata"])
    )
    return F.least(F.lit(MAX_SCORE), total).cast("int")


def band(points: Column) -> Column:
    return F.when(points >= HIGH_FROM, "HIGH").when(points >= MEDIUM_FROM, "MEDIUM").otherwise("LOW")


def severity_rank(severity: Column) -> Column:
    return (F.array_position(F.array(*[F.lit(s) for s in SEVERITY_ORDER]), severity) - 1).cast("int")

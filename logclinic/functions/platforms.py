"""Which platform produced a text."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

UNKNOWN = "unknown"

# --- fixed values: markers searched in the lower-cased text, first platform with a hit wins ------------------
MARKERS: dict[str, list[str]] = {
    "databricks": ["databricks", "dbr/", "com.databricks"],
    "adf": [
        "azure data factory",
        "data factory",
        "datafactory",
        "microsoft.datafactory",
        "selfhostedintegrationruntime",
        "self-hosted integration runtime",
        "integration runtime",
    ],
    "spark": [
        "org.apache.spark",
        "pyspark",
        "sparkexception",
        "sparkcontext",
        "sparksession",
        "analysisexception",
    ],
}
# ----------------------------------------------------------------------------------------------------------


def marker_hit(lowered: Column, platform: str) -> Column:
    return reduce(lambda a, b: a | b, [F.contains(lowered, F.lit(m)) for m in MARKERS[platform]])


def detect_platform(lowered: Column) -> Column:
    """Platform of a lower-cased text by marker priority."""
    chain = F
    for platform in MARKERS:
        chain = chain.when(marker_hit(lowered, platform), F.lit(platform))
    return chain.otherwise(F.lit(UNKNOWN))

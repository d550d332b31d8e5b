"""Column contracts shared by the operators."""

from __future__ import annotations

from pyspark.sql import types as T

ATTRIBUTES = T.MapType(T.StringType(), T.StringType())

#: One failure event.  ``source`` is the unit of diagnosis, ``seq`` the position of the event inside it.
EVENTS = T.StructType(
    [
        T.StructField("source", T.StringType(), False),
        T.StructField("seq", T.LongType(), False),
        T.StructField("id", T.StringType()),
        T.StructField("timestamp", T.TimestampType()),
        T.StructField("platform", T.StringType()),
        T.StructField("service", T.StringType()),
        T.StructField("job", T.StringType()),
        T.StructField("stage", T.StringType()),
        T.StructField("task", T.StringType()),
        T.StructField("severity", T.StringType()),
        T.StructField("error_type", T.StringType()),
        T.StructField("error_message", T.StringType()),
        T.StructField("stacktrace", T.StringType()),
        T.StructField("resource_attributes", ATTRIBUTES),
        T.StructField("event_attributes", ATTRIBUTES),
        T.StructField("payload_text", T.StringType()),
    ]
)
EVENT_COLUMNS = EVENTS.fieldNames()

RULES = T.StructType(
    [
        T.StructField("rule_id", T.StringType(), False),
        T.StructField("name", T.StringType()),
        T.StructField("category", T.StringType()),
        T.StructField("severity", T.StringType()),
        T.StructField("platforms", T.ArrayType(T.StringType())),
        T.StructField("exceptions", T.ArrayType(T.StringType())),
        T.StructField("positive", T.ArrayType(T.StringType())),
        T.StructField("negative", T.ArrayType(T.StringType())),
        T.StructField("hypotheses", T.ArrayType(T.StringType())),
        T.StructField("immediate", T.ArrayType(T.StringType())),
        T.StructField("recommended", T.ArrayType(T.StringType())),
        T.StructField("prevention", T.ArrayType(T.StringType())),
        T.StructField(
            "refs",
            T.ArrayType(
                T.StructType([T.StructField("title", T.StringType()), T.StructField("url", T.StringType())])
            ),
        ),
    ]
)

RUNS = (
    "source string, ordinal bigint, is_current boolean, run_id string, status string, job string, stage string, "
    "error string"
)
SCHEMAS = "source string, tbl_ord int, table_name string, pos int, column_name string, data_type string"
METRICS = (
    "source string, ord bigint, name string, value double, unit string, labels map<string,string>, window string"
)
PLANS = "source string, plan string"
LOG_LINES = "source string, n bigint, line string"

"""Failure tables derived from the given tables with Spark."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from logclinic import schema
from logclinic.operators.investigate import Context
from workload.templates import FAILURES, FIELDS, TEMPLATES

_TEMPLATE_SCHEMA = "tkey string, name string, kind string, ids string, band string, status string, ext string, " \
    "content string, attributes string, " + ", ".join(f"{f} string" for f in FIELDS)


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def dealt(rows: DataFrame, key: str) -> DataFrame:
    """Rows dealt over the session's shuffle partitions, whatever the size: given tables may be a single file."""
    return rows.repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), key)


def template_rows() -> list[tuple]:
    rows = []
    for key, t in TEMPLATES.items():
        attributes = t.fields.get("event_attributes")
        rows.append(
            (key, t.name, t.kind, ",".join(t.ids), t.band, t.status, t.ext, t.content,
             json.dumps(attributes) if attributes else None, *[t.fields.get(f) for f in FIELDS])
        )
    return rows


def templates(spark: SparkSession) -> DataFrame:
    """A fixed table of a few dozen rows, hence safe to broadcast."""
    return spark.createDataFrame(template_rows(), _TEMPLATE_SCHEMA)


def fill(column: str | Column) -> Column:
    text = F.col(column) if isinstance(column, str) else column
    text = F.replace(text, F.lit("{id}"), F.col("event_id").cast("string"))
    return F.replace(text, F.lit("{user}"), F.col("user_id").cast("string"))


def rendered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every row of ``events`` with its template; placeholders are still open."""
    key = F.when(
        F.col("event_type") == "error", F.concat(F.lit("error-"), (F.col("event_id") % len(FAILURES)).cast("string"))
    ).otherwise(F.col("event_type"))
    events = read(spark, sf_dir, "events").select("event_id", "user_id", "ts", key.alias("tkey"))
    return dealt(events, "event_id").join(F.broadcast(templates(spark)), "tkey")


def _events(spark: SparkSession, sf_dir: str, source: Column) -> DataFrame:
    derived = {
        "source": source,
        "seq": F.col("event_id"),
        "id": F.concat(F.lit("e"), F.col("event_id").cast("string")),
        "timestamp": F.col("ts"),
        "severity": F.upper("severity"),
        "resource_attributes": F.create_map().cast(schema.ATTRIBUTES),
        "event_attributes": F.coalesce(
            F.from_json("attributes", schema.ATTRIBUTES), F.create_map().cast(schema.ATTRIBUTES)
        ),
    }
    return rendered(spark, sf_dir).select(*[derived.get(c, fill(c)).alias(c) for c in schema.EVENT_COLUMNS])


def failure_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All events; a source is what one user did in one week."""
    week = F.concat(F.lit("u"), F.col("user_id").cast("string"), F.lit("-w"), F.weekofyear("ts").cast("string"))
    return _events(spark, sf_dir, week)


def single_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All events, each its own source."""
    return _events(spark, sf_dir, F.concat(F.lit("e"), F.col("event_id").cast("string")))


def inputs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One input file per event: (source, text) plus its expectation."""
    path = F.concat(F.lit("in/"), F.col("name"), F.lit("-"), F.col("event_id").cast("string"), F.lit("."), F.col("ext"))
    return rendered(spark, sf_dir).select(
        path.alias("source"), fill("content").alias("text"), "name", "kind", "ids", "band", "status", "event_id"
    )


def document_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Real prose as raw logs."""
    named = read(spark, sf_dir, "documents").select(
        F.concat(F.lit("d"), F.col("doc_id").cast("string")).alias("source"), "text"
    )
    return dealt(named, "source")


def runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Run history per customer: every order is a run, the most recent one is the current run.

    ``ordinal`` only has to sort runs from new to old, so no customer's orders are ever sorted in one place.
    """
    newest_first = (F.lit(100_000) - F.unix_date(F.to_date("o_orderdate"))) * F.lit(10**13) + F.col("o_orderkey")
    priority = F.col("o_orderpriority")
    cause = (
        F.when(priority == "1-URGENT", "authentication failed token=t")
        .when(priority == "2-HIGH", "Missing an output location for shuffle ")
        .when(priority == "3-MEDIUM", "ConcurrentAppendException in run ")
        .otherwise("no reason given, password: p")
    )
    failed = F.col("o_orderstatus") == "F"
    orders = read(spark, sf_dir, "orders").withColumn("ordinal", newest_first)
    current = orders.groupBy("o_custkey").agg(F.min("ordinal").alias("current"))
    return orders.join(current, "o_custkey").select(
        F.concat(F.lit("c"), F.col("o_custkey").cast("string")).alias("source"),
        "ordinal",
        (F.col("ordinal") == F.col("current")).alias("is_current"),
        F.concat(F.lit("run-"), F.col("o_orderkey").cast("string")).alias("run_id"),
        F.when(failed, "failed").when(F.col("o_orderstatus") == "O", "running").otherwise("done").alias("status"),
        F.lower(priority).alias("job"),
        F.substring(priority, 1, 1).alias("stage"),
        F.when(failed, F.concat(F.lit("run stopped: "), cause, F.col("o_orderkey").cast("string"))).alias("error"),
    )


def _sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(source, user_id) of the derived failure sources."""
    week = F.concat(F.lit("u"), F.col("user_id").cast("string"), F.lit("-w"), F.weekofyear("ts").cast("string"))
    return read(spark, sf_dir, "events").select(week.alias("source"), "user_id").distinct()


def order_schemas(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two schema snapshots per order, one per line status; columns come from its lines."""
    parity = F.col("l_linenumber") % 2
    return (
        read(spark, sf_dir, "lineitem")
        .select(
            F.col("l_orderkey"),
            F.when(F.col("l_linestatus") == "F", 0).otherwise(1).alias("tbl_ord"),
            F.concat(F.lit("lines_"), F.lower("l_linestatus")).alias("table_name"),
            (F.ascii("l_returnflag") * 2 + parity).alias("pos"),
            F.concat(F.lit("c_"), "l_returnflag", parity.cast("string")).alias("column_name"),
            F.concat(F.lit("t"), (F.col("l_suppkey") % 3).cast("string")).alias("data_type"),
        )
        .groupBy("l_orderkey", "tbl_ord", "table_name", "pos", "column_name")
        .agg(F.min("data_type").alias("data_type"))
    )


def schemas(spark: SparkSession, sf_dir: str) -> DataFrame:
    return order_schemas(spark, sf_dir).withColumn("source", F.concat(F.lit("k"), F.col("l_orderkey").cast("string")))


def metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One sample per source and event type."""
    week = F.concat(F.lit("u"), F.col("user_id").cast("string"), F.lit("-w"), F.weekofyear("ts").cast("string"))
    k = F.get_json_object("props", "$.k").cast("bigint")
    return (
        read(spark, sf_dir, "events")
        .groupBy(week.alias("source"), F.col("event_type").alias("name"))
        .agg(F.count("*").cast("double").alias("value"), F.max(k).alias("hi"), F.min(k).alias("lo"))
        .select(
            "source",
            F.ascii("name").cast("bigint").alias("ord"),
            "name",
            "value",
            F.lit("events").alias("unit"),
            F.create_map(
                F.lit("stage"), (F.col("hi") % 5 + 1).cast("string"), F.lit("executor_id"), (F.col("lo") % 3).cast("string")
            ).alias("labels"),
            F.when(F.col("name") == "error", F.lit("1w")).alias("window"),
        )
    )


def plans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One plan text per part."""
    trouble = (
        F.when(F.col("p_brand") == "Brand#1", "\nauthentication failed password=x")
        .when(F.col("p_brand") == "Brand#2", "\nMissing an output location for shuffle ")
        .when(F.col("p_brand") == "Brand#3", "\nskewed partition ")
        .otherwise("\nExchange ")
    )
    text = F.concat(
        F.lit("== Physical Plan ==\nScan "), "p_name", F.lit(" ["), "p_type", F.lit("]"), trouble,
        F.col("p_partkey").cast("string"),
    )
    return read(spark, sf_dir, "part").select(
        "p_partkey", F.concat(F.lit("p"), F.col("p_partkey").cast("string")).alias("source"), text.alias("plan")
    )


def log_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Further log lines of a source: the messages of its events."""
    events = failure_events(spark, sf_dir)
    return events.where("error_message IS NOT NULL").select(
        "source", F.col("seq").alias("n"), F.translate("error_message", "\n", " ").alias("line")
    )


def context(spark: SparkSession, sf_dir: str) -> Context:
    """Context tables of the derived failure sources, joined to the given tables by user."""
    sources = _sources(spark, sf_dir)
    user = F.col("user_id")
    by_customer = runs(spark, sf_dir).withColumnRenamed("source", "customer")
    customer = sources.withColumn("customer", F.concat(F.lit("c"), user.cast("string")))
    own_runs = customer.join(by_customer, "customer").drop("customer", "user_id")
    own_schemas = sources.join(order_schemas(spark, sf_dir), user == F.col("l_orderkey")).drop("l_orderkey", "user_id")
    own_plans = sources.join(plans(spark, sf_dir).drop("source"), user == F.col("p_partkey")).select("source", "plan")
    return Context(own_runs, own_schemas, metrics(spark, sf_dir), own_plans, log_lines(spark, sf_dir))


def eval_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every derived input as a labelled case; one template carries a wrong band, so that grading has work to do."""
    wrong = F.when(F.col("name") == "spark-stage", "LOW").otherwise(F.col("band"))
    return inputs(spark, sf_dir).select(
        "source",
        F.col("source").alias("name"),
        "kind",
        F.concat("kind", F.lit("/"), "name").alias("label"),
        F.col("status").alias("expected_status"),
        F.when(F.col("ids") == "", F.array().cast("array<string>")).otherwise(F.split("ids", ",")).alias("expected_ids"),
        wrong.alias("expected_band"),
    )


def baseline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Earlier results: every case passed, benchmark items were cases that no longer exist."""
    gone = read(spark, sf_dir, "benchmark").select(F.concat(F.lit("gone-"), F.col("item_id").cast("string")).alias("name"))
    return inputs(spark, sf_dir).select(F.col("source").alias("name")).unionByName(gone).withColumn("ok", F.lit(True))


def rule_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A user rule base as JSON texts, one per part; many of them are faulty on purpose."""
    size = F.col("p_size")
    none, absent = F.array().cast("array<string>"), F.lit(None).cast("array<string>")
    brand = F.replace("p_brand", F.lit("#"), F.lit(""))
    number = F.lpad((F.col("p_partkey") % 1000).cast("string"), 3, "0")
    fields = {
        "rule_id": F.when(size % 7 == 0, F.concat(F.lower("p_brand"), number)).otherwise(F.concat(F.upper(brand), F.lit("-"), number)),
        "name": F.when(size % 13 > 0, F.col("p_name")),
        "category": F.when(size % 5 == 0, F.col("p_type")).otherwise(F.concat(F.lit("parts."), F.lower("p_type"))),
        "severity": F.when(size % 11 == 0, "loud").when(size % 11 > 1, "medium"),
        "platforms": F.when(size % 12 == 0, none).when(size % 12 == 6, absent).when(size % 6 == 1, F.array(F.lit("spark"), F.lit("spark")))
        .when(size % 6 == 2, F.array(F.lit("Spark!"))).otherwise(F.array(F.lit("spark"))),
        "exceptions": F.when(size % 8 == 0, none).when(size % 8 == 4, absent).otherwise(F.array(F.concat(brand, F.lit("Error")))),
        "positive": F.when(size % 6 == 0, none).when(size % 6 == 3, absent).when(size % 3 == 1, F.array(F.lit("data_skew"), F.lit("data_skew")))
        .otherwise(F.array(F.lit("executor_oom"), F.lit("Bad Signal"))),
        "negative": F.when(size % 2 == 0, F.array(F.lit("dns_failure"))).otherwise(F.array(F.concat(F.lit("no_such_"), F.lower(brand)))),
        "hypotheses": F.when(size % 16 == 0, none).when(size % 16 == 8, absent).otherwise(F.array(F.lit("worn_part"))),
        "refs": F.when(size % 18 == 0, F.array().cast(schema.RULES["refs"].dataType)).when(
            size % 18 != 9,
            F.array(F.struct(F.lit("manual").alias("title"), F.lit("https://example.org/").alias("url")))
        ),
    }
    return read(spark, sf_dir, "part").select(F.to_json(F.struct(*[c.alias(n) for n, c in fields.items()])).alias("text"))


def context_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One JSON context per order; form and faults depend on status and priority."""
    key = F.col("o_orderkey").cast("string")
    status, priority = F.col("o_orderstatus"), F.col("o_orderpriority")
    current = F.when(status == "F", F.concat(F.lit('{"run_id": "r'), key, F.lit('", "status": "failed", "stage": "3"}'))).when(
        status == "O", F.concat(F.lit('"r'), key, F.lit('"'))
    ).otherwise("null")
    runs_key = F.when(priority == "1-URGENT", "runs").otherwise("previous_runs")
    older = F.when(priority == "4-NOT SPECIFIED", '["a", 7]').otherwise('[{"status": "done", "job": "j"}, "b"]')
    metric = F.when(priority == "5-LOW", '"many"').otherwise(F.concat(F.lit('{"value": 2.5, "unit": "mb", "labels": {"stage": "'), key, F.lit('"}}')))
    # containers and fields of a wrong kind
    form = F.col("o_custkey") % 20
    logs = F.when(form == 0, '"one line"').otherwise(F.concat(F.lit('["l'), key, F.lit('", ""]')))
    measured = F.when(form == 1, "[1]").otherwise(F.concat(F.lit('{"rows": '), key, F.lit(', "bytes": '), metric, F.lit("}")))
    snapshots = F.when(form == 2, '"s"').when(form == 3, '{"t": {"columns": [1]}}').otherwise(
        '{"t2": {"columns": ["b", "a"], "data_types": {"a": "int"}}, "t1": {"table": "x", "columns": ["c"]}}'
    )
    older = F.when(form == 4, '{"a": 1}').when(form == 5, '[{"run_id": "a", "status": 5}]').otherwise(older)
    plan = F.when(form == 6, "7").otherwise(F.concat(F.lit('"Scan '), key, F.lit('"')))
    text = F.concat(
        F.lit('{"current_run": '), current, F.lit(', "'), runs_key, F.lit('": '), older, F.lit(', "logs": '), logs, F.lit(', "metrics": '), measured,
        F.lit(', "schemas": '), snapshots, F.lit(', "query_plan": '), plan, F.lit("}"),
    )
    return dealt(read(spark, sf_dir, "orders"), "o_orderkey").select(F.concat(F.lit("o"), key).alias("source"), text.alias("text"))

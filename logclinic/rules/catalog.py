"""The shipped rule base: 39 declarative diagnoses as plain data."""

from __future__ import annotations

from typing import NamedTuple


class Rule(NamedTuple):
    rule_id: str
    name: str
    category: str
    severity: str
    platforms: list[str]
    exceptions: list[str]
    positive: list[str]
    negative: list[str]
    hypotheses: list[str]
    actions: tuple[str, str, str]  # what to do now, next, and to prevent a repeat

    @property
    def family(self) -> str:
        return self.category.split(".")[0]


# --- fixed values: ids, names, categories, severities, platforms, exceptions, signals, hypotheses --------------
_ENGINE = ["spark", "databricks"]
_FACTORY = ["adf"]
_AUTH, _DNS, _OOM = "authentication_failure", "dns_failure", "executor_oom"
_NO_TABLE, _NO_COLUMN = "table_or_view_not_found", "resolved_column_not_found"
_ANALYSIS = ["AnalysisException"]

RULES: list[Rule] = [
    Rule("ADF-001", "Linked Service Connection Failure", "adf.linked_service", "high", _FACTORY, [],
         ["adf_linked_service_error"], [],
         ["invalid_linked_service_credentials", "linked_service_endpoint_unreachable",
          "expired_secret_or_managed_identity"],
         ("Run the connection test of the linked service named in the message.",
          "Compare its stored secret or identity with the one the target accepts today.",
          "Give linked services managed identities and alert before secrets expire.")),
    Rule("ADF-002", "Integration Runtime Unavailable", "adf.integration_runtime", "high", _FACTORY, [],
         ["adf_integration_runtime_unavailable"], [],
         ["self_hosted_ir_offline", "ir_node_deallocated_or_restarted", "network_or_proxy_blocking_ir"],
         ("Look at the node state of the runtime and start its service again if it stopped.",
          "Check that the host reaches the relay addresses through its proxy.",
          "Register a second node so one host can fail.")),
    Rule("ADF-003", "Dataset or Path Not Found", "adf.dataset_not_found", "medium", _FACTORY, [],
         ["adf_dataset_not_found"], [],
         ["dataset_missing_in_factory", "source_path_or_container_missing", "parameterized_path_resolved_wrong"],
         ("List the container at the path printed in the message.",
          "Print the parameters the path was built from for this run.",
          "Put an existence check in front of the copy step.")),
    Rule("ADF-004", "Activity Timeout", "adf.activity_timeout", "high", _FACTORY, [],
         ["adf_activity_timeout"], [],
         ["activity_timeout_too_low", "source_or_sink_slow_or_throttled",
          "long_running_query_or_stored_procedure"],
         ("Compare this duration with earlier runs of the same activity.",
          "Find out whether source or sink was slow before raising the timeout.",
          "Split long copies into partitions that finish well inside the limit.")),
    Rule("ADF-005", "Missing or Invalid Pipeline Parameter", "adf.parameter_error", "medium", _FACTORY, [],
         ["adf_parameter_error"], [],
         ["required_parameter_not_passed", "parameter_name_mismatch", "trigger_or_pipeline_expression_invalid"],
         ("Compare the parameters of the trigger with those the pipeline declares.",
          "Evaluate the failing expression with the values of this run.",
          "Give optional parameters defaults and validate templates before release.")),
    Rule("ADF-006", "Service Throttling or Rate Limit", "adf.throttling", "medium", _FACTORY, [],
         ["adf_throttling"], [],
         ["data_store_request_limits_exceeded", "too_many_concurrent_activities", "burst_without_retry_policy"],
         ("Wait for the limit to reset and run again with fewer parallel copies.",
          "Add a retry policy with growing pauses.",
          "Spread triggers over time instead of starting them together.")),
    Rule("CONN-001", "Authentication Failure", "connectivity.authentication", "high", _ENGINE, ["SaslException"],
         [_AUTH], [_NO_TABLE, _DNS, _OOM],
         ["expired_or_invalid_credentials", "kerberos_ticket_issue", "missing_or_rotated_secret"],
         ("Try the credentials of the job outside the job.",
          "Check whether the secret was rotated or the ticket ran out.",
          "Renew tickets and secrets automatically and test them before use.")),
    Rule("CONN-002", "Connection Timeout", "connectivity.connection_timeout", "high", _ENGINE,
         ["ConnectTimeoutException"], ["connection_timeout"], [_AUTH, _DNS, _OOM],
         ["firewall_or_security_group_block", "overloaded_endpoint", "wrong_network_path"],
         ("Open the same host and port from a worker node.",
          "Review firewall and routing changes since the last good run.",
          "Watch connect times to external systems and alert on growth.")),
    Rule("CONN-003", "DNS Failure", "connectivity.dns_failure", "high", _ENGINE, ["UnknownHostException"],
         [_DNS], [_AUTH, _OOM],
         ["hostname_typo_or_renamed", "internal_dns_not_resolvable", "dns_provider_outage"],
         ("Resolve the host name from a worker node.",
          "Check the spelling and whether the host was renamed.",
          "Keep host names in one configuration place that is tested.")),
    Rule("CONN-004", "Permission Denied", "connectivity.permission_denied", "high", _ENGINE,
         ["AccessControlException"], ["permission_denied"], [_AUTH, _DNS, _OOM],
         ["missing_iam_or_rbac_policy", "user_not_in_allowed_group", "path_scoped_denied_access"],
         ("Note user, action and path from the message and check the grant.",
          "Compare role or group membership with an environment that works.",
          "Manage grants as reviewed code next to the job.")),
    Rule("CONN-005", "Endpoint Unavailable", "connectivity.endpoint_unavailable", "high", _ENGINE,
         ["ConnectException"], ["endpoint_unavailable"], [_AUTH, _DNS, _OOM],
         ["downstream_service_down", "listener_not_running", "proxy_interrupted_connection"],
         ("Ask the owner of the endpoint whether the service runs.",
          "Check that the configured port is the one being listened on.",
          "Retry with pauses and probe the endpoint before heavy work.")),
    Rule("DELTA-001", "Concurrent Modification", "delta.concurrent_modification", "high", _ENGINE,
         ["ConcurrentAppendException"], ["delta_concurrent_conflict"],
         [_AUTH, _DNS, "delta_metadata_changed", "delta_protocol_changed", "delta_concurrent_transaction"],
         ["concurrent_writer_on_same_table", "overlapping_stream_or_batch", "unauthorized_parallel_job"],
         ("Find the other writer in the table history and run this job again.",
          "Let each writer name the partitions it touches in its condition.",
          "Schedule writers of one table one after the other.")),
    Rule("DELTA-002", "Delta Schema Mismatch", "delta.schema_mismatch", "high", _ENGINE, _ANALYSIS,
         ["delta_merge_fields_failed"], [_NO_TABLE, _AUTH, _DNS, _OOM],
         ["cannot_merge_incompatible_fields", "added_field_without_merge_schema",
          "incompatible_column_type_change"],
         ("Compare the types of the field named in the message on both sides.",
          "Cast the incoming column to the type of the table.",
          "Agree on column types with the producer and test them.")),
    Rule("DELTA-003", "Table Not Found", "delta.table_not_found", "high", _ENGINE, _ANALYSIS,
         [_NO_TABLE, "delta_not_a_table"], [_AUTH, _DNS, _OOM],
         ["table_or_view_missing", "wrong_catalog_or_database", "path_is_not_delta_formatted"],
         ("List the tables of the schema the job used.",
          "Check the current catalog and the format of the path.",
          "Write table names in full.")),
    Rule("DELTA-004", "Invalid Partition Column", "delta.invalid_partition", "medium", _ENGINE, _ANALYSIS,
         ["invalid_partition"], [_NO_TABLE, _AUTH, _DNS, _OOM],
         ["unsupported_partition_column_type", "nested_partition_column", "partition_column_not_in_table"],
         ("Check that the partition column exists at the top level with a plain type.",
          "Derive a plain column from nested data and partition by that.",
          "Test the table definition with a small write first.")),
    Rule("DELTA-005", "Transaction Conflict", "delta.transaction_conflict", "medium", _ENGINE,
         ["ConcurrentTransactionException"],
         ["delta_concurrent_transaction", "delta_metadata_changed", "delta_protocol_changed"],
         [_AUTH, _DNS, _OOM],
         ["concurrent_transaction_wrote_new_data", "table_metadata_changed_mid_job",
          "protocol_version_upgrade_during_job"],
         ("Run the job again; the table changed while it worked.",
          "Look in the history for a schema or protocol change at that time.",
          "Change tables only in windows without writers.")),
    Rule("PERF-001", "Small Files Problem", "performance.small_files", "low", _ENGINE, [],
         ["small_files"], [_AUTH, _DNS, _OOM],
         ["many_small_files_in_partition", "continuous_append_pattern", "expensive_listing_and_reads"],
         ("Count files and their mean size in the partition named.",
          "Compact the partition into files of a few hundred megabytes.",
          "Repartition before writing so each task writes one good file.")),
    Rule("PERF-002", "Excessive Shuffle", "performance.excessive_shuffle", "low", _ENGINE, [],
         ["excessive_shuffle"], [_AUTH, _DNS, _OOM],
         ["oversized_shuffle_data", "poor_partitioning", "missing_broadcast_opportunity"],
         ("Find the exchange that moves the most bytes in the plan.",
          "Filter and drop columns before it, or broadcast the small side.",
          "Bucket large tables by the key they are joined on.")),
    Rule("PERF-003", "Missing Partition Pruning", "performance.partition_pruning", "low", _ENGINE, [],
         ["missing_partition_pruning"], [_AUTH, _DNS, _OOM],
         ["predicate_not_pushed_down", "partition_column_not_used", "scan_includes_all_partitions"],
         ("Look for partition filters in the scan of the plan.",
          "Filter on the partition column itself, without a function around it.",
          "Review queries on big tables for a partition filter.")),
    Rule("PERF-004", "Oversized Broadcast", "performance.oversized_broadcast", "low", _ENGINE, [],
         ["broadcast_size_exceeded"], [_AUTH, _DNS, _OOM],
         ["build_side_exceeds_threshold", "forced_broadcast_hint", "dimension_table_growth"],
         ("Compare the size of the build side with the threshold.",
          "Remove the hint or reduce the build side to needed columns.",
          "Follow the growth of tables that are broadcast.")),
    Rule("QUALITY-001", "Null Constraint Violation", "quality.null_violation", "high", _ENGINE,
         ["InvariantViolationException"], ["null_constraint_violated"], [_AUTH, _DNS, _OOM],
         ["null_in_non_nullable_column", "upstream_producer_emitted_null", "check_constraint_violation"],
         ("Select the input rows in which the named column is null.",
          "Trace when the producer began to send nulls.",
          "Send rows that break a constraint to a side table.")),
    Rule("QUALITY-002", "Duplicate Keys", "quality.duplicates", "high", _ENGINE, _ANALYSIS,
         ["duplicate_keys"], [_AUTH, _DNS, _OOM],
         ["duplicate_source_rows", "repeated_ingestion", "join_caused_row_multiplication"],
         ("Group the input by the key and list the keys that occur twice.",
          "Find out whether a batch was loaded twice or a join multiplied rows.",
          "Make loads repeatable by merging on the key.")),
    Rule("QUALITY-003", "Invalid Date Value", "quality.invalid_date", "medium", _ENGINE, _ANALYSIS,
         ["date_parse_failure"], [_AUTH, _DNS, _OOM],
         ["malformed_date_string", "wrong_date_format", "locale_or_timezone_mismatch"],
         ("Select the values a tolerant cast turns into null.",
          "Parse with the format the producer really uses.",
          "Check date formats where data enters.")),
    Rule("QUALITY-004", "Invalid Numeric Value", "quality.invalid_numeric", "medium", _ENGINE, _ANALYSIS,
         ["invalid_numeric_value"], [_AUTH, _DNS, _OOM],
         ["malformed_numeric_string", "precision_or_scale_overflow", "non_numeric_token_in_numeric_column"],
         ("Select the values a tolerant cast turns into null.",
          "Widen the type, or clean the tokens that are no numbers.",
          "Check ranges and formats where data enters.")),
    Rule("QUALITY-005", "Referential Integrity Issue", "quality.referential_integrity", "high", _ENGINE, _ANALYSIS,
         ["merge_cardinality_violation"], [_AUTH, _DNS, _OOM],
         ["merge_matched_multiple_source_rows", "non_unique_join_key", "missing_parent_rows",
          "foreign-key style violations surface with engine-specific wording; only the MERGE cardinality signature "
          "is verified for Spark/Delta"],
         ("List the merge keys that occur more than once in the source.",
          "Reduce the source to one row per key before merging.",
          "Test the uniqueness of merge keys on every load.")),
    Rule("SCHEMA-001", "Missing Column", "schema.missing_column", "medium", _ENGINE, _ANALYSIS,
         [_NO_COLUMN], [_NO_TABLE, _AUTH, _DNS, _OOM],
         ["missing_column", "schema_drift", "case_sensitivity_difference"],
         ("Print the schema at the failing step and look for the column.",
          "Correct the name, or add the column upstream.",
          "Compare input schemas with the expected ones before running.")),
    Rule("SCHEMA-002", "Data Type Mismatch", "schema.type_mismatch", "medium", _ENGINE, _ANALYSIS,
         ["datatype_mismatch"], [_NO_TABLE, _AUTH, _DNS, _OOM],
         ["data_type_mismatch", "unsafe_cast", "schema_drift"],
         ("Print the types of both operands of the failing expression.",
          "Cast on purpose on one side.",
          "Fix types when data is read instead of inferring them.")),
    Rule("SCHEMA-003", "Unexpected Column", "schema.unexpected_column", "medium", _ENGINE, _ANALYSIS,
         ["unexpected_column"], [_NO_TABLE, _NO_COLUMN, _AUTH, _OOM],
         ["extra_column_in_input", "column_order_mismatch", "upstream_added_column"],
         ("Compare the two column lists of the message.",
          "Select exactly the columns of the table before writing.",
          "Write by column name, never by position.")),
    Rule("SCHEMA-004", "Duplicate Column", "schema.duplicate_column", "medium", _ENGINE, _ANALYSIS,
         ["ambiguous_reference"], [_NO_TABLE, _NO_COLUMN, _AUTH, _OOM],
         ["duplicate_column_name", "ambiguous_join_output", "duplicate_field_in_schema"],
         ("Find the two inputs that both provide the named column.",
          "Qualify the column, or rename it before the join.",
          "Join on column names so the key appears once.")),
    Rule("SCHEMA-005", "Schema Evolution Failure", "schema.evolution_failure", "high", _ENGINE, _ANALYSIS,
         ["schema_evolution_blocked"], [_NO_TABLE, _NO_COLUMN, _AUTH, _OOM],
         ["schema_enforcement_rejected_write", "merge_schema_not_enabled", "upstream_added_column"],
         ("Compare table schema and data schema in the message.",
          "Allow the change for this write only if it is wanted.",
          "Announce schema changes before they are released.")),
    Rule("SCHEMA-006", "Nested Schema Mismatch", "schema.nested_mismatch", "medium", _ENGINE, _ANALYSIS,
         ["nested_schema_field_unresolved"], [_NO_TABLE, _NO_COLUMN, _AUTH, _OOM],
         ["nested_field_missing", "struct_shape_drift", "wrong_struct_path"],
         ("Print the struct and compare it with the path used.",
          "Correct the path, or rebuild the struct with the field.",
          "Flatten nested data once, in one tested place.")),
    Rule("SPARK-001", "Executor Out of Memory", "spark.executor_oom", "critical", _ENGINE, ["OutOfMemoryError"],
         [_OOM], ["driver_oom", "broadcast_oom", _AUTH, _DNS],
         ["executor_memory_exhausted", "data_skew_caused_oom", "oversized_partition"],
         ("Find the stage that failed and compare its largest task with the median.",
          "Raise the number of partitions, then executor memory.",
          "Let adaptive execution split skewed partitions.")),
    Rule("SPARK-002", "Driver Out of Memory", "spark.driver_oom", "critical", _ENGINE, ["OutOfMemoryError"],
         ["driver_oom"], [_AUTH, _DNS],
         ["driver_memory_exhausted", "collect_to_driver", "broadcast_accumulator_growth"],
         ("Find the call that brings rows to the driver.",
          "Write the result to storage instead of collecting it.",
          "Limit the result size a driver accepts.")),
    Rule("SPARK-003", "Executor Lost", "spark.executor_lost", "high", _ENGINE, ["ExecutorLostFailure"],
         ["executor_lost"], [_OOM, _AUTH, _DNS],
         ["executor_preempted_or_evicted", "executor_heartbeat_timeout", "node_failure"],
         ("Read the exit reason of the lost executor in the cluster manager.",
          "Check for preemption, node failure and long collections.",
          "Let decommissioned executors hand over their shuffle blocks.")),
    Rule("SPARK-004", "Repeated Task Failure", "spark.repeated_task_failure", "high", _ENGINE, ["SparkException"],
         ["task_failure_repeated"], [_OOM, _AUTH, _DNS],
         ["poison_pill_record", "deterministic_task_failure", "missing_input_partition"],
         ("Read the cause given for the last attempt of the task.",
          "Run the failing input partition alone.",
          "Send records that cannot be parsed to a side table.")),
    Rule("SPARK-005", "Data Skew", "spark.data_skew", "medium", _ENGINE, [],
         ["data_skew"], [_AUTH, _DNS],
         ["skewed_join_keys", "skewed_group_by", "hot_partition"],
         ("Count rows per key and note the largest keys.",
          "Salt the large keys or aggregate before the join.",
          "Keep adaptive skew handling on and watch task times.")),
    Rule("SPARK-006", "Shuffle Fetch Failure", "spark.shuffle", "high", _ENGINE, ["FetchFailedException"],
         ["shuffle_fetch_failed"], [_AUTH, _DNS],
         ["remote_block_lost", "executor_restarted_during_shuffle", "network_or_disk_failure"],
         ("Check whether the executor that held the blocks is gone, and why.",
          "Look at disk space and network errors of its node.",
          "Keep shuffle files outside the executors.")),
    Rule("SPARK-007", "Broadcast Failure", "spark.broadcast", "high", _ENGINE,
         ["OutOfMemoryError", "BroadcastTimeoutException"], ["broadcast_timeout", "broadcast_oom"], [_AUTH, _DNS],
         ["broadcast_build_oom", "broadcast_timeout_exceeded", "oversized_broadcast_table"],
         ("Measure the table that was being broadcast.",
          "Turn the broadcast off for this join.",
          "Collect statistics so the planner knows table sizes.")),
    Rule("SPARK-008", "Stage Failure", "spark.stage_failure", "high", _ENGINE, ["SparkException"],
         ["stage_failure"],
         ["task_failure_repeated", "executor_lost", _OOM, "broadcast_oom", "shuffle_fetch_failed", _AUTH, _DNS],
         ["task_failure_caused_job_abort", "resource_exhaustion", "configuration_error"],
         ("Open the failed stage and read the first failed task.",
          "Compare configuration and input size with the last good run.",
          "Log the cause of failed tasks where it can be searched.")),
]
#: Order and titles in which families are listed.
FAMILIES: dict[str, str] = {
    "schema": "Schema",
    "quality": "Data quality",
    "spark": "Spark",
    "delta": "Delta",
    "adf": "Azure Data Factory",
    "connectivity": "Connectivity",
    "performance": "Performance",
}
# ----------------------------------------------------------------------------------------------------------

#: Advice shared by all rules of a family: now, next, prevention.
FAMILY_ACTIONS: dict[str, tuple[str, str, str]] = {
    "schema": ("Keep the failing query and both schemas.",
               "Check what changed upstream since the last good run.",
               "Version schemas and review changes."),
    "quality": ("Set the offending rows aside before running again.",
                "Report the rows to the producer with examples.",
                "Measure data quality at every hand-over."),
    "spark": ("Keep the event log of the failed application.",
              "Compare task times and sizes with a good run.",
              "Size partitions by bytes, not by habit."),
    "delta": ("Read the table history around the failure.",
              "Check which jobs write to the table.",
              "Document one owner for each table."),
    "adf": ("Open the monitoring view of the failed run.",
            "Compare the run with the last good one.",
            "Alert on failed activities, not only on failed pipelines."),
    "connectivity": ("Repeat the connection from the cluster network.",
                     "Ask whether the target was changed or restarted.",
                     "Test connections before the job starts its work."),
    "performance": ("Save the physical plan of the slow query.",
                    "Measure again after each single change.",
                    "Track run time and bytes read per query."),
}

#: Public documentation per family: (title, address).
FAMILY_REFERENCES: dict[str, list[tuple[str, str]]] = {
    "schema": [("Spark error conditions", "https://spark.apache.org/docs/latest/sql-error-conditions.html"),
               ("Spark data types", "https://spark.apache.org/docs/latest/sql-ref-datatypes.html")],
    "quality": [("Spark ANSI compliance", "https://spark.apache.org/docs/latest/sql-ref-ansi-compliance.html"),
                ("Spark error conditions", "https://spark.apache.org/docs/latest/sql-error-conditions.html")],
    "spark": [("Spark tuning", "https://spark.apache.org/docs/latest/tuning.html"),
              ("Spark configuration", "https://spark.apache.org/docs/latest/configuration.html")],
    "delta": [("Delta concurrency control", "https://docs.delta.io/latest/concurrency-control.html"),
              ("Delta table writes", "https://docs.delta.io/latest/delta-batch.html")],
    "adf": [("Data Factory troubleshooting",
             "https://learn.microsoft.com/azure/data-factory/data-factory-troubleshoot-guide"),
            ("Data Factory pipelines",
             "https://learn.microsoft.com/azure/data-factory/concepts-pipelines-activities")],
    "connectivity": [("Spark security", "https://spark.apache.org/docs/latest/security.html"),
                     ("Spark configuration", "https://spark.apache.org/docs/latest/configuration.html")],
    "performance": [("Spark SQL performance tuning",
                     "https://spark.apache.org/docs/latest/sql-performance-tuning.html"),
                    ("Spark tuning", "https://spark.apache.org/docs/latest/tuning.html")],
}

"""Files arriving in a folder, diagnosed as they come.

A raw input is its own source, so its report needs no state: every micro-batch runs the batch plan.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from logclinic.plans.ingest import decode_inputs, diagnose_inputs
from logclinic.rules.base import RuleBase
from logclinic.sources.text_logs import MAX_INPUT_BYTES

_FILE = "path string, modificationTime timestamp, length bigint, content binary"


def stream_reports(
    spark: SparkSession, path: str, out: str, checkpoint: str, rules: RuleBase | None = None, max_bytes: int = MAX_INPUT_BYTES
) -> StreamingQuery:
    """Diagnose the files now in ``path`` and not seen before, append their reports to ``out``, then stop."""
    rules = rules or RuleBase.shipped()
    files = spark.readStream.format("binaryFile").schema(_FILE).load(path)

    def write(batch: DataFrame, batch_id: int) -> None:
        inputs = batch.selectExpr("path AS source", "length AS size", "content")
        # one folder per batch: a batch that is run again after a failure replaces its own output
        diagnose_inputs(decode_inputs(inputs), rules, max_bytes=max_bytes).write.mode("overwrite").parquet(f"{out}/batch={batch_id}")

    return (
        files.writeStream.foreachBatch(write)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )

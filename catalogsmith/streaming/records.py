"""Row-local steps over streams: the sanitizer's rules and routing need no state, so they run unchanged on each micro-batch."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from ..operators.sanitize import quarantine_reason, sanitize_columns


def sanitized_stream(records: DataFrame) -> DataFrame:
    """The cleaned records with quarantine_reason (null: fine)."""
    return sanitize_columns(records).withColumn("quarantine_reason", quarantine_reason())


def route(records: DataFrame, good: str, bad: str, checkpoint: str) -> StreamingQuery:
    """Writes fine records and quarantined ones to two tables; a batch that is repeated overwrites its own files."""

    def write(batch: DataFrame, number: int) -> None:
        for path, condition in ((good, "quarantine_reason is null"), (bad, "quarantine_reason is not null")):
            batch.where(condition).write.mode("overwrite").parquet(f"{path}/batch={number}")

    return sanitized_stream(records).writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()

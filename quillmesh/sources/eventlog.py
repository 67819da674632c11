"""Append-only run logs as batch tables or streams."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

EVENT_SCHEMA = (
    "ts timestamp, run_id string, type string, phase string, event string, status string, dur_ms bigint, msg string, path string, kind string"
)


def read_event_log(spark: SparkSession, path: str, streaming: bool = False, max_files: int = 1000) -> DataFrame:
    """JSONL events with a fixed schema; broken lines come back as all-null rows."""
    if streaming:
        return spark.readStream.schema(EVENT_SCHEMA).option("maxFilesPerTrigger", max_files).json(path)
    return spark.read.schema(EVENT_SCHEMA).json(path)

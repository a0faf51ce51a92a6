"""Row-local operators on streams: the same functions as on tables, micro-batch by micro-batch."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from leafmill.operators.findings import pii_findings, redact


def read_stream(spark: SparkSession, folder: str, schema) -> DataFrame:
    """New Parquet files of a folder as a stream."""
    return spark.readStream.schema(schema).parquet(folder)


def stream_findings(docs: DataFrame, kinds: list[str] | None = None) -> DataFrame:
    return pii_findings(docs, kinds)


def stream_redacted(docs: DataFrame, kinds: list[str] | None = None) -> DataFrame:
    return redact(docs, kinds)


def run_available(df: DataFrame, folder: str, checkpoint: str) -> None:
    """Writes what is there now to Parquet, exactly once, and ends."""
    df.writeStream.format("parquet").option("path", folder).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()

"""Extension (not part of the batch semantics): response files decoded and checked as they arrive."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from attestry.operators.responses import decoded, response_error


def response_stream(spark: SparkSession, folder: str) -> DataFrame:
    """A stream of (seq, response, response_error) over JSON files of (seq, response)."""
    raw = spark.readStream.schema("seq bigint, response string").json(folder)
    return decoded(raw).withColumn("response_error", response_error()).select("seq", "response", "response_error")

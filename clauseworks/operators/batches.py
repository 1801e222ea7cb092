"""Bounds of the Arrow batches that Python workers get, as rows may be long."""

from __future__ import annotations

from pyspark.sql import SparkSession

#: Rows and bytes of a batch at most (a row that is longer goes alone).
ROWS = 4_096
BYTES = 8_000_000


def small_batches(spark: SparkSession) -> None:
    """Lowers the rows and the bytes of a batch for what the session runs from now on; smaller bounds stay."""
    for key, most in (("maxRecordsPerBatch", ROWS), ("maxBytesPerBatch", BYTES)):
        now = spark.conf.get(f"spark.sql.execution.arrow.{key}")
        if not (now.isdigit() and 0 < int(now) <= most):
            spark.conf.set(f"spark.sql.execution.arrow.{key}", str(most))

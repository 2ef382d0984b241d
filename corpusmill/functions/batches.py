"""Arrow batches bounded in bytes, so that a Python worker's memory does not follow the length of the texts."""

from __future__ import annotations

from pyspark.sql import SparkSession

ARROW_BYTES = 4 << 20


def bound_batches(spark: SparkSession) -> None:
    """Sets the session's bound; where the user has set one it stays."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(key, None) is None:
        spark.conf.set(key, str(ARROW_BYTES))

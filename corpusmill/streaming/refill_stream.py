"""Refill fed by a stream (an extension): each micro-batch of rows tops up a balanced table.

    query = refill_from_stream(rows, path, score, classes, config)
    query.processAllAvailable()

``path`` must be shared by all machines. Each batch writes its own version of the table, so a batch that is
run again after a failure replaces its own result and nothing is counted twice.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.refill import RefillConfig, refill

SCHEMA = "pmc_id string, row_id long, final_label string, final_conf double, final_margin double"


def current(spark, path: str, batch: int | None = None) -> DataFrame:
    """The newest version of the table (before ``batch``, if given); empty before the first."""
    try:
        versions = spark.read.schema(SCHEMA + ", batch long").parquet(path)
    except Exception as e:  # noqa: BLE001
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return spark.createDataFrame([], SCHEMA)
    if batch is not None:
        versions = versions.where(F.col("batch") < batch)
    newest = versions.agg(F.max("batch")).first()[0]
    return versions.where(F.col("batch") == newest).drop("batch") if newest is not None else spark.createDataFrame([], SCHEMA)


def refill_from_stream(rows: DataFrame, path: str, score: Callable[[DataFrame, float], DataFrame], classes: list[str], config: RefillConfig, checkpoint: str) -> StreamingQuery:
    def each(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        one = replace(config, chunk=1 << 62, max_rounds=1)
        refill(batch, current(spark, path, number), score, classes, one).write.mode("overwrite").parquet(f"{path}/batch={number}")

    return rows.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()

"""The streamed refill against its invariants."""

from pyspark.sql import functions as F

from corpusmill.operators.refill import RefillConfig
from corpusmill.streaming import refill_stream


def test_stream(spark, tmp_path):
    schema = "pmc_id string, row_id long, final_label string"
    for k in range(3):
        spark.createDataFrame([("P", i, "ab"[i % 2]) for i in range(20 * k, 20 * k + 20)], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))

    def score(chunk, threshold):
        return chunk.withColumns({"final_conf": F.lit(1.0), "final_margin": F.lit(1.0), "is_filtered": F.lit(False)})

    path = str(tmp_path / "out")
    assert refill_stream.current(spark, path).count() == 0
    refill_stream.refill_from_stream(stream, path, score, ["a", "b"], RefillConfig(per_class=13), str(tmp_path / "check")).awaitTermination()
    out = refill_stream.current(spark, path).collect()
    assert len(out) == 26 and len({r.row_id for r in out}) == 26 and sum(r.final_label == "a" for r in out) == 13

"""The refill loop: chunks of rows are scored and accepted until every class is full.

State between rounds is three small tables and a few numbers; each round is written out and read again, so
the plan never grows and a lost executor costs one round at most.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scores import adaptive_threshold
from . import balance, decide


@dataclass(frozen=True)
class RefillConfig:
    per_class: int = 5000
    chunk: int = 14500
    max_rounds: int = 68
    cnn_thresh: float = 0.82
    micro_round_failures: int = 600
    stagnation: int = 100
    use_margin: bool = False
    #: Rows below the gate wait in the pool and may fill a class that is still short.
    pool_bypass: bool = True
    #: Rows that share their key are rows of their own; otherwise one of them counts.
    repeats: bool = False


OVERRIDE = RefillConfig()
AGREEMENT = RefillConfig(per_class=10, chunk=500, micro_round_failures=400)
FUSION = RefillConfig(per_class=1000, chunk=25000, micro_round_failures=400, use_margin=True)


def _checkpoint_dir(spark) -> str:
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="corpusmill-refill-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def compounded(start: float, least: float, decay: float, rounds: int) -> list[float]:
    """The threshold of each round where a round starts from the decayed value of the one before."""
    out, now = [], start
    for r in range(rounds):
        now = adaptive_threshold(now, least, r, decay)
        out.append(now)
    return out


def refill(rows: DataFrame, accepted: DataFrame, score: Callable[[DataFrame, float], DataFrame], classes: list[str], config: RefillConfig, round_path: str | None = None) -> DataFrame:
    """Balanced rows: what was accepted before, topped up from ``rows`` in chunks of row_id.

    ``rows`` needs pmc_id and row_id; ``score(chunk, threshold)`` adds final_label, final_conf, final_margin and
    is_filtered. Keys used once are never used again. ``round_path``: each round's selection is written to
    ``round=NNN`` below it. Empty ``rows`` return the accepted ones, trimmed.
    """
    spark = rows.sparkSession
    base = f"{_checkpoint_dir(spark)}/refill-{uuid.uuid4().hex}"

    def kept(df: DataFrame, name: str) -> DataFrame:
        df.write.mode("overwrite").parquet(f"{base}/{name}")
        return spark.read.schema(df.schema).parquet(f"{base}/{name}")

    columns = ["pmc_id", "row_id", "final_label", "final_conf", "final_margin"]
    state = kept(accepted.select(columns), "start")
    pool = state.limit(0)
    # Chunks don't overlap, so the rows of the start are all that a chunk may hold and must not use again.
    used = state.select("pmc_id", "row_id")
    span = rows.agg(F.min("row_id").alias("a"), F.max("row_id").alias("b")).first()
    at, failures, idle, threshold = span["a"], 0, 0, config.cnn_thresh
    for n in range(config.max_rounds):
        counts = balance.class_counts(state, "final_label", classes, config.per_class)
        missing = [r["label"] for r in counts.where("not full").orderBy("pos").collect()]  # a row a class
        if not missing or at is None or at > span["b"]:
            break
        step = n + failures // config.micro_round_failures
        threshold = adaptive_threshold(threshold, 0.55, step, 0.04)
        chunk = rows.where(F.col("row_id").between(at, at + config.chunk - 1))
        at += config.chunk
        fresh = balance.unused(chunk, used, ["pmc_id", "row_id"])
        scored = kept(score(fresh, threshold).where("not is_filtered").select(columns), f"scored-{n:03d}")
        wanted = scored.where(F.col("final_label").isin(missing))
        gate = decide.accepts(F.col("final_conf"), step, F.col("final_margin") if config.use_margin else None)
        good, low = wanted.where(gate), wanted.where(~gate)
        failures += low.count()
        before = state.count()
        if config.pool_bypass:
            pool = pool.unionByName(low).unionByName(scored.where(F.col("final_label").isin(classes) & ~F.col("final_label").isin(missing)))
        chosen = balance.local_balance(state, pool, config.per_class, classes, new=good, repeats=config.repeats).select(columns)
        state = kept(chosen, f"state-{n:03d}")
        pool = kept(pool, f"pool-{n:03d}")
        if round_path:
            state.write.mode("overwrite").parquet(f"{round_path}/round={n:03d}")
        idle = 0 if state.count() > before else idle + 1
        if idle >= config.stagnation:
            break
    return balance.local_balance(state, pool.limit(0), config.per_class, classes, repeats=config.repeats).select(columns)

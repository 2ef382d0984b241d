"""From shards to a balanced, labelled set: the whole run of a profile.

    rows = engine.load(spark, folder)
    result = engine.run(rows, EngineConfig(profile="override", output="/shared/out"), models)

Rows are read, captions taken and, where an OCR text is there, narrowed to the panels shown; a balanced first sample is
drawn and scored, and the refill loop tops its classes up from all rows. Everything is written below ``output``.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import rules
from .functions import text as t
from .operators import balance, panels, records, refill, report
from .sources import arrow_shards, numbering, payload, results


@dataclass(frozen=True)
class EngineConfig:
    """What a run can be told. The defaults are those of the override profile."""

    output: str
    profile: str = "override"
    per_class: int = 5000
    early_presample: int | None = 14500
    refill_presample: int = 14500
    max_rounds: int = 68
    cnn_thresh: float = 0.82
    cnn3filter: float = 0.976
    cnn_mediumfilter: float = 0.5
    micro_round_failures: int = 600
    limit: int | None = None
    inspectlimit: int = 35
    inspect_only: bool = False
    seed: int | None = None
    target: str | None = None
    first: tuple[str, ...] = ()
    second: tuple[str, ...] = ()

    def refill(self) -> refill.RefillConfig:
        return refill.RefillConfig(self.per_class, self.refill_presample, self.max_rounds, self.cnn_thresh, self.micro_round_failures, use_margin=self.profile == "fusion")


@dataclass
class Result:
    """The tables of a run; ``report`` has one for each distribution or rate."""

    final: DataFrame | None = None
    early: DataFrame | None = None
    report: dict[str, DataFrame] = field(default_factory=dict)


def load(spark: SparkSession, folder: str, columns: str = "__key__,jsonl") -> DataFrame:
    """The rows of all shards below ``folder``, numbered."""
    arrow_shards.register(spark)
    return numbering.numbered(spark.read.format("arrow_shards").option("columns", columns).load(folder))


def captioned(rows: DataFrame, profile: str) -> DataFrame:
    """Adds pmc_id, caption and modality_gt from the payload of each row; other columns stay."""
    parsed = payload.with_payload(rows)
    fields = [F.col(c) for c in ("full_caption", "sub_caption", "intext_refs_summary", "intext_refs")]
    caption = t.joined_text(*fields) if profile == "fusion" else t.first_text(*fields)
    kept = [c for c in rows.columns if c != "jsonl"]
    return parsed.select(*kept, F.coalesce("PMC_ID", F.lit("")).alias("pmc_id"), caption.alias("caption"), F.coalesce("modality", F.lit("unknown")).alias("modality_gt"))


def labelled(rows: DataFrame, profile: str) -> DataFrame:
    """Rows about people, with captions narrowed to the panels that OCR saw (if ocr_text is there), and rule labels."""
    df = rows.where(~t.has_animal(F.col("caption")))
    df = panels.narrow_to_panels(df, "caption") if "ocr_text" in df.columns else df.where(~t.has_panels(F.col("caption")))
    return rules.classify(df, "caption", rules.PROFILES[profile])


def run(rows: DataFrame, config: EngineConfig, models: Callable[[DataFrame], DataFrame] | None = None, image: str | None = None) -> Result:
    """The run of a profile over numbered rows (see ``load``).

    ``models`` adds the scores that the profile's decision needs (see ``records``); without it no image counts as
    trash, which is enough for the override profile. ``image``: a binary column that is exported for the rows chosen.
    Below ``output`` stand early_rules, disagreements, rounds, final and, with ``image``, images.
    """
    out = config.output.rstrip("/")
    result = Result(report={"schema": report.first_sample(rows, "jsonl"), "modalities": report.head_distribution(captioned(rows, config.profile), "modality_gt", 2000)})
    if config.inspect_only:
        return result
    classes = rules.PROFILES[config.profile].classes
    score_with = models or (lambda df: df.withColumn("trash_conf", F.lit(0.0)))
    how = _decision(config)

    def decided(df: DataFrame, threshold: float) -> DataFrame:
        more = {"threshold": threshold} if config.profile == "agreement" else {}
        return records.score_records(score_with(df), config.profile, **how, **more)

    captions = captioned(rows, config.profile)
    found = labelled(captions, config.profile)
    wanted = F.col("rule_pred") == config.target if config.target else F.lit(True)
    key = balance.seeded_order(F.col("row_id"), config.seed) if config.seed is not None else balance.stable_hash(F.col("pmc_id"), F.col("row_id"))
    early = balance.early_sample(found, "rule_pred", [key, F.col("row_id")], config.per_class, classes, wanted, config.limit, config.early_presample)
    results.write_results(early.drop(*([image] if image else [])), f"{out}/early_rules")
    # Written once with all it needs, so that neither sampling nor models run again for the tables below.
    decided(early.drop("rank"), config.cnn_thresh).write.mode("overwrite").parquet(f"{out}/scored")
    scored = rows.sparkSession.read.parquet(f"{out}/scored")
    results.write_results(scored.where(F.col("filter_reason") == "rule_cnn_disagreement").withColumn("round", F.lit(0)), f"{out}/disagreements")
    kept = scored.where("not is_filtered")

    def score(chunk: DataFrame, threshold: float) -> DataFrame:
        return decided(chunk, threshold)

    chosen = refill.refill(found, kept, score, classes, config.refill(), f"{out}/rounds").select("pmc_id", "row_id", "final_label", "final_conf", "final_margin")
    full = records.with_evidence(chosen.join(found.drop("final_label", "final_conf", "final_margin"), ["pmc_id", "row_id"]))
    blank = F.trim(F.coalesce("caption", F.lit(""))) == ""
    full = full.withColumns({"final_label": F.when(blank, "unknown").otherwise(F.col("final_label")), "decision_source": F.when(blank, "empty_text").otherwise(F.col("decision_source"))})
    ordered = balance.in_class_order(full, "final_label", classes, F.col("row_id"))
    results.write_results(ordered, f"{out}/final")
    final = results.read_results(rows.sparkSession, f"{out}/final")
    if image:
        from .operators import images

        images.export_images(full, image, f"{out}/images")
    result.early, result.final = early, final
    result.report |= {
        "final_label": report.distribution(final, "final_label"), "decision_source": report.distribution(final, "decision_source"), "modality_gt": report.top_values(final, "modality_gt", 20),
        "head": report.distribution(final.limit(config.inspectlimit), "final_label"), "filters": report.filter_stats(scored), "rates": report.filter_rates(scored),
        "reasons": report.value_counts(scored.where("is_filtered"), "filter_reason"), "balance": balance.class_counts(final, "final_label", classes, config.per_class),
    }
    return result


def _decision(config: EngineConfig) -> dict:
    if config.profile == "override":
        return {"trash_limit": config.cnn3filter, "target": config.target}
    if config.profile == "agreement":
        return {"first": list(config.first), "second": list(config.second), "strong": config.cnn3filter, "medium": config.cnn_mediumfilter, "target": config.target}
    return {}

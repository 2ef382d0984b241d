"""Record scorers: a profile's whole way from rule label and model scores to a decision, with its evidence."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import scores as s
from ..functions import vocabulary as v
from ..functions.once import once
from . import decide

#: Evidence that a record carries, and what stands there where a stage did not run.
EVIDENCE = {
    "rule_reason": "''", "matched": "''", "modality_gt": "'unknown'", "cnn_pred": "'none'", "cnn_conf": "0D", "cnn3_pred": "'none'", "cnn3_conf": "0D", "decision_source": "'none'",
    "ocr_used": "false", "ocr_text": "''", "ocr_found_panels": "array()", "ocr_panel_section_keys": "array()", "ocr_selected_texts": "array()",
}


def with_evidence(df: DataFrame) -> DataFrame:
    """Every evidence column, with its default where it is missing or null; ocr_selected_panel_count, full_caption as the
    caption before panels were chosen, and final_margin (the confidence where a profile has none)."""
    kind = lambda c: "array<string>" if EVIDENCE[c] == "array()" else None
    default = lambda c: F.expr(EVIDENCE[c]).cast(kind(c)) if kind(c) else F.expr(EVIDENCE[c])
    df = df.withColumns({c: F.coalesce(F.col(c), default(c)) if c in df.columns else default(c) for c in EVIDENCE})
    if "final_conf" in df.columns and "final_margin" not in df.columns:
        df = df.withColumn("final_margin", F.col("final_conf"))
    before = next((F.col(c) for c in ("original_caption", "full_caption", "caption") if c in df.columns), F.lit(None).cast("string"))
    return df.withColumns({"ocr_selected_panel_count": F.size("ocr_selected_texts"), "full_caption": before})


def score_fusion(df: DataFrame, classes: list[str] = v.CLASSES_FUSION) -> DataFrame:
    """The fusion profile. Needs rule_pred, bert_scores (by class), cnn1_scores and cnn2_scores (maps of the models'
    own classes), trash_conf.

    Adds rule_scores, cnn_scores, cnn_top3, the confidences and the decision. A row that a trash filter takes has no
    final label; the others are fused.
    """
    w1, w2 = s.log_weights(v.CNN1_COUNTS, classes), s.log_weights(v.CNN2_COUNTS, classes)
    one, two = (s.mapped(F.col(c), m, classes) for c, m in (("cnn1_scores", v.CNN1_MAPPING), ("cnn2_scores", v.CNN2_MAPPING)))
    df = once(once(df, "__cnn", s.fused_models(one, two, w1, w2)), "cnn_scores", s.normalized(F.col("__cnn"))).drop("__cnn")
    df = df.withColumns({
        "rule_scores": s.one_hot(F.col("rule_pred"), classes), "bert_pred": s.top_label(F.col("bert_scores"), classes), "bert_conf": s.confidence(F.col("bert_scores")),
        "cnn_pred": s.top_label(F.col("cnn_scores"), classes), "cnn_conf": s.confidence(F.col("cnn_scores")), "cnn_margin": s.margin(F.col("cnn_scores")), "cnn_top3": s.top_k(F.col("cnn_scores"), classes),
    })
    marked = decide.decide_fusion(df)
    fused = decide.final_fusion(marked, classes).withColumn("decision_source", F.lit("fusion"))
    return fused.unionByName(marked.where("is_filtered"), allowMissingColumns=True)


def score_records(df: DataFrame, profile: str, **how) -> DataFrame:
    """The decision and the evidence of each record by a profile: override, agreement or fusion."""
    scorers = {"override": decide.decide_override, "agreement": decide.decide_agreement, "fusion": score_fusion}
    return with_evidence(scorers[profile](df, **how))

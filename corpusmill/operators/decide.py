"""Decision ladders: the first rule that applies gives the reason for which a record is filtered."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import scores as s
from ..functions import vocabulary as v
from ..functions.once import once


def _ladder(*steps: tuple[Column, str]) -> Column:
    """The reason of the first condition that holds; null if none does."""
    out = F.lit(None).cast("string")
    for condition, reason in reversed(steps):
        out = F.when(F.coalesce(condition, F.lit(False)), F.lit(reason)).otherwise(out)
    return out


def _finished(df: DataFrame, reason: Column) -> DataFrame:
    return df.withColumn("filter_reason", reason).withColumn("is_filtered", F.col("filter_reason").isNotNull())


def decide_override(df: DataFrame, trash_limit: float = 0.976, target: str | None = None) -> DataFrame:
    """A rule label among the seven classes is final with confidence 1; anything else is filtered.

    Needs rule_pred and trash_conf. Adds final_label, final_conf, final_margin, decision_source, filter_reason,
    is_filtered.
    """
    ruled = F.col("rule_pred").isin(v.CLASSES_OVERRIDE)
    conf = F.when(ruled, 1.0).otherwise(0.0)
    df = df.withColumns({
        "final_label": F.when(ruled, F.col("rule_pred")).otherwise("unknown"), "final_conf": conf, "final_margin": conf,
        "decision_source": F.when(ruled, F.concat(F.lit("rule_"), F.col("rule_pred"), F.lit("_override"))).otherwise("none"),
    })
    agree = ruled | ((F.col("rule_pred") == F.col("final_label")) & (F.col("final_conf") >= 0.55) & F.col("final_label").isin(v.CLASSES_OVERRIDE))
    steps = [
        ((F.col("trash_conf") >= trash_limit) & (F.col("final_conf") <= 0.79), "cnn3_strong"),
        ((F.col("trash_conf") > 0.96) & (F.col("final_conf") < 0.45), "noconsent"),
        (~agree, "rule_cnn_disagreement"),
    ]
    return _finished(df, _ladder(*steps, *_target(target)))


def _target(target: str | None) -> list:
    return [(F.col("final_label") != target, "not_target_class")] if target else []


def decide_agreement(df: DataFrame, first: list[str], second: list[str], threshold: float = 0.82, strong: float = 0.75, medium: float = 0.5, target: str | None = None) -> DataFrame:
    """A specialist model decides and the rule must agree.

    Needs rule_pred, trash_conf and cnn1_label, cnn1_conf, cnn2_label, cnn2_conf; ``first`` and ``second`` are the
    classes each specialist may decide.
    """
    one = F.col("cnn1_label").isin(first) & (F.col("cnn1_conf") >= threshold)
    two = F.col("cnn2_label").isin(second) & (F.col("cnn2_conf") >= threshold)
    df = df.withColumns({
        "final_label": F.when(one, F.col("cnn1_label")).when(two, F.col("cnn2_label")).otherwise("unknown"),
        "final_conf": F.when(one, F.col("cnn1_conf")).when(two, F.col("cnn2_conf")).otherwise(0.0),
        "decision_source": F.when(one, "cnn1").when(two, "cnn2").otherwise("none"),
    })
    trash, best = F.col("trash_conf"), F.greatest("cnn1_conf", "cnn2_conf")
    steps = [
        ((trash >= strong) & (best <= 0.65), "cnn3_strong"),
        ((trash >= medium) & (best <= 0.465), "cnn3_medium"),
        ((trash > 0.96) & (F.col("final_conf") < 0.45) & (F.col("cnn1_conf") < 0.45) & (F.col("cnn2_conf") < 0.45), "noconsent"),
        ((F.col("rule_pred") != F.col("final_label")) | (F.col("final_conf") < 0.55), "rule_cnn_disagreement"),
    ]
    return _finished(df, _ladder(*steps, *_target(target)))


def decide_fusion(df: DataFrame) -> DataFrame:
    """Trash filters of the fusion profile. Needs trash_conf, bert_conf, cnn_conf."""
    t, b, c = F.col("trash_conf"), F.col("bert_conf"), F.col("cnn_conf")
    return _finished(df, _ladder((t >= 0.93, "cnn3_strong"), ((t >= 0.65) & (b <= 0.5) & (c <= 0.5), "cnn3_medium"), ((t > 0.745) & (b < 0.7) & (c < 0.7), "noconsent")))


def final_fusion(df: DataFrame, classes: list[str] = v.CLASSES_FUSION) -> DataFrame:
    """Fuses rule_scores, bert_scores and cnn_scores of the rows that aren't filtered; adds final_scores,
    final_label, final_conf, final_margin, top2_label, top2_score and the filter of a trash score that beats them."""
    votes = s.fused(F.col("rule_scores"), F.col("bert_scores"), F.col("cnn_scores"), F.col("trash_conf"))
    df = once(df.where("not is_filtered"), "__votes", votes)
    df = once(once(df, "final_scores", s.normalized(F.col("__votes"))), "__two", s.top_k(F.col("final_scores"), classes, 2))
    first, second = F.get("__two", F.lit(0)), F.get("__two", F.lit(1))
    df = df.withColumns({
        "final_label": F.coalesce(first["label"], F.lit("none")), "final_conf": F.coalesce(first["score"], F.lit(0.0)),
        "final_margin": F.coalesce(first["score"], F.lit(0.0)) - F.coalesce(second["score"], F.lit(0.0)), "top2_label": second["label"], "top2_score": second["score"],
    }).drop("__votes", "__two")
    return _finished(df, _ladder((F.col("trash_conf") > F.array_max("final_scores") + 0.01, "cnn3stronger_than_any_cnn")))


def accepts(conf: Column, round_number, margin: Column | None = None) -> Column:
    """The acceptance gate of a refill round; with a margin it is the fusion profile's."""
    if margin is None:
        return conf >= s.adaptive_threshold(0.58, 0.40, round_number, 0.02)
    return (conf >= s.adaptive_threshold(0.72, 0.45, round_number, 0.025)) & (margin >= s.adaptive_threshold(0.18, 0.05, round_number, 0.01))


def any_column_matches(df: DataFrame, pattern: str) -> DataFrame:
    """Rows of which any column, as lower-case text, matches the regular expression."""
    hits = [F.coalesce(F.lower(F.col(f"`{c}`").cast("string")).rlike(pattern), F.lit(False)) for c in df.columns]
    return df.where(reduce(lambda a, b: a | b, hits))

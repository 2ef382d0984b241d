"""Zero-shot labels: the cosine of a text's vector with the vector of each class description.

The encoder is the user's: a function from texts to vectors. Class vectors are few, so they are constants of the plan.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import scores as s
from ..functions.once import once
from ..functions.vocabulary import CLASS_TEXTS

#: Below this cosine no class is named.
LEAST = 0.30
#: More classes than this are no constants any more.
MOST_CLASSES = 1000


def class_vectors(encode: Callable[[list[str]], np.ndarray], texts: dict[str, str] = CLASS_TEXTS) -> dict[str, list[float]]:
    """The vector of each class description."""
    return dict(zip(texts, np.asarray(encode(list(texts.values())), float).tolist(), strict=True))


def mean_vectors(df: DataFrame, vector: str, label: str) -> dict[str, list[float]]:
    """The mean vector of each label; ValueError if there are more than MOST_CLASSES."""
    mean = df.where(F.col(label).isNotNull()).select(label, F.posexplode(vector).alias("i", "x")).groupBy(label, "i").agg(F.avg(F.col("x").cast("double")).alias("x"))
    rows = mean.groupBy(label).agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "x"))), lambda p: p["x"]).alias("v")).orderBy(label).limit(MOST_CLASSES + 1).collect()
    if len(rows) > MOST_CLASSES:
        raise ValueError(f"more than {MOST_CLASSES} labels")
    return {r[label]: r["v"] for r in rows}


def with_vectors(df: DataFrame, text: str, encode: Callable[[list[str]], np.ndarray], out: str = "vector") -> DataFrame:
    """Adds the vector of each text, a batch at a time; null text counts as empty."""

    @F.pandas_udf("array<double>")
    def run(texts: pd.Series) -> pd.Series:
        return pd.Series(np.asarray(encode([t or "" for t in texts]), float).tolist())

    return df.withColumn(out, run(F.col(text)))


def similarities(vector: Column, classes: dict) -> Column:
    """array<double>: the cosine with each class, in their order."""
    return F.array(*[s.cosine(vector, F.array(*map(F.lit, v))) for v in classes.values()])


def zero_shot(df: DataFrame, vector: str, classes: dict, least: float = LEAST) -> DataFrame:
    """Adds text_scores (in the order of ``classes``), text_pred (``unknown`` below ``least``), text_conf and text_top2
    (array<struct<label, score>>). A null vector gives ``unknown`` with 0 and no scores."""
    names = [str(c) for c in classes]
    scores = F.when(F.col(vector).isNotNull(), similarities(F.col(vector), classes)).otherwise(F.array().cast("array<double>"))
    df = once(df, "text_scores", scores)
    df = once(df, "text_top2", s.top_k(F.col("text_scores"), names, 2))
    best = F.get("text_top2", F.lit(0))
    sure = F.coalesce(best["score"] >= least, F.lit(False))
    return df.withColumns({"text_pred": F.when(sure, best["label"]).otherwise("unknown"), "text_conf": F.coalesce(best["score"], F.lit(0.0))})

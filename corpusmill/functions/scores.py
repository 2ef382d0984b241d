"""Score vectors: array<double> columns in the order of a list of classes.

Ties go to the first class in that order.
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import vocabulary as v


def label_at(classes: list[str], position: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, classes)), position.cast("int"))


def top_label(vec: Column, classes: list[str]) -> Column:
    """The class with the highest score; ``none`` for a null or empty vector."""
    return F.when(F.size(vec) > 0, label_at(classes, F.array_position(vec, F.array_max(vec)))).otherwise(F.lit("none"))


def ranked(vec: Column, classes: list[str]) -> Column:
    """array<struct<label, score>>, best first."""
    keyed = F.array_sort(F.transform(vec, lambda x, i: F.struct((-x).alias("a"), i.alias("i"), x.alias("score"))))
    return F.transform(keyed, lambda s: F.struct(label_at(classes, s["i"] + 1).alias("label"), s["score"].alias("score")))


def top_k(vec: Column, classes: list[str], k: int = 3) -> Column:
    return F.slice(ranked(vec, classes), 1, k)


def confidence(vec: Column) -> Column:
    return F.coalesce(F.array_max(vec), F.lit(0.0))


def margin(vec: Column) -> Column:
    """The distance of the two best scores; 0 for an empty vector, the score itself for a single one."""
    ordered = F.sort_array(vec, asc=False)
    return F.when(F.size(vec) > 0, ordered[0] - F.coalesce(F.get(ordered, F.lit(1)), F.lit(0.0))).otherwise(F.lit(0.0))


def is_uncertain(conf: Column, gap: Column) -> Column:
    return (conf < 0.4) | (gap / (conf + 1e-6) < 0.03)


def mapped(scores: Column, mapping: dict[str, str], classes: list[str]) -> Column:
    """A map of model scores as a vector: scores of all model classes that stand for a class are summed."""
    part = lambda c: [F.coalesce(F.try_element_at(scores, F.lit(m)), F.lit(0.0)) for m, to in mapping.items() if to == c]
    return F.array(*[sum(part(c), F.lit(0.0)) for c in classes])


def log_weights(counts: dict[str, int], classes: list[str]) -> list[float]:
    """ln(n + 1) of each class over the largest; all zero if nothing was counted."""
    logs = [math.log(counts.get(c, 0) + 1) for c in classes]
    top = max(logs, default=0.0)
    return [x / top if top else 0.0 for x in logs]


def fused_models(a: Column, b: Column, wa: list[float], wb: list[float], alpha: float = v.CNN_ALPHA) -> Column:
    one = F.array(*[F.lit(1 + alpha * w) for w in wa])
    two = F.array(*[F.lit(1 + alpha * w) for w in wb])
    scaled = lambda x, w: F.zip_with(x, w, lambda s, k: s * k)
    return F.zip_with(scaled(a, one), scaled(b, two), lambda x, y: x + y)


def normalized(vec: Column) -> Column:
    """Scores over their sum, which is taken once; as they are where the sum is 0."""
    share = lambda total: F.transform(vec, lambda x: F.when(total == 0, x).otherwise(x / total))
    return F.aggregate(vec, F.lit(0.0), lambda a, x: a + x, share)


def rounded(c: Column, places: int) -> Column:
    """A double at so many places as SQL engines round it: by its product with a power of ten. Spark's own round takes
    the shortest decimal text of the double, which may be a half where the double is below one."""
    return F.round(c * 10.0**places) / 10.0**places


def fused(rule: Column, text: Column, image: Column, trash: Column) -> Column:
    """The three votes with equal weights, lowered by the trash score; not normalized."""
    w = F.lit(v.FUSION_WEIGHT)
    summed = F.zip_with(F.zip_with(rule, text, lambda a, b: w * a + w * b), image, lambda s, c: s + w * c)
    return F.transform(summed, lambda s: s * (1 - v.TRASH_WEIGHT * trash))


def one_hot(label: Column, classes: list[str]) -> Column:
    return F.array(*[F.when(label == c, 1.0).otherwise(0.0) for c in classes])


def cosine(a: Column, b: Column) -> Column:
    """The cosine of two vectors; 0 where one of them has no length."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, t: s + t)
    return F.coalesce(F.try_divide(dot(a, b), F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))), F.lit(0.0))


def adaptive_threshold(start: float, least: float, round_number, decay: float):
    """max(least, start - round * decay), for a number or a column."""
    if isinstance(round_number, Column):
        return F.greatest(F.lit(least), F.lit(start) - round_number * decay)
    return max(least, start - round_number * decay)


def parsed_llm_label(answer: Column, classes: list[str]) -> Column:
    """struct<label, conf>: the first class named in the answer with 0.7, else ``unknown`` with 0."""
    said, label = F.lower(F.coalesce(answer, F.lit(""))), F.lit(None).cast("string")
    for c in reversed(classes):
        label = F.when(said.contains(c.lower()), F.lit(c)).otherwise(label)
    return F.struct(F.coalesce(label, F.lit("unknown")).alias("label"), F.when(label.isNotNull(), 0.7).otherwise(0.0).alias("conf"))


def linear_head(vec: Column, weights: list[list[float]], bias: list[float]) -> Column:
    """Class probabilities of a linear layer over a vector; weights by class."""
    dot = lambda row: F.aggregate(F.zip_with(vec, F.array(*map(F.lit, row)), lambda x, w: x.cast("double") * w), F.lit(0.0), lambda s, t: s + t)
    logits = F.array(*[dot(row) + F.lit(b) for row, b in zip(weights, bias, strict=True)])
    return F.aggregate(F.array(logits), F.array().cast("array<double>"), lambda _, z: F.transform(z, lambda x: F.exp(x - F.array_max(z))), lambda e: normalized(e))

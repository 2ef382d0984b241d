"""The prioritized rulebook.

A text's words are looked up once, and a pattern is tried only where the words that its matches must contain are
found (``literals.Matcher``, in Arrow batches: expressions would search the text once for every pattern). What follows
from the matches is column expressions. A pattern that is listed twice counts twice.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from itertools import zip_longest

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from . import vocabulary as v
from .batches import bound_batches
from .literals import each_text, matcher, required_literal  # noqa: F401
from .once import once


def interleaved(*lists: list[str]) -> list[str]:
    """One from each list in turn, as cards are dealt."""
    return [x for group in zip_longest(*lists) for x in group if x is not None]


@dataclass(frozen=True)
class Rulebook:
    """Patterns by label in rulebook order, with what settles a choice among labels."""

    name: str
    patterns: dict[str, list[str]]
    priority: dict[str, int]
    classes: list[str]
    bonus: dict[str, int] = field(default_factory=dict)

    @property
    def labels(self) -> list[str]:
        return list(self.patterns)

    def rows(self) -> list[tuple]:
        """(label, label_pos, pattern_pos, pattern, priority, is_filter)."""
        return [(label, i, k, p, self.priority[label], label in v.FILTER_CLASSES) for i, (label, ps) in enumerate(self.patterns.items()) for k, p in enumerate(ps)]


def _book(*imaging: list[str]) -> dict[str, list[str]]:
    filters = [v.MICROSCOPY, v.PATHOLOGY, v.SURGERY, v.ENDOSCOPY, v.CHART]
    return dict(zip(v.RULE_ORDER, [*imaging, *filters], strict=True))


_FUSED = _book(v.FUSION_ANGIO, v.FUSION_US, v.FUSION_HYBRID, interleaved(*v.FUSION_HIRN_PARTS), interleaved(*v.FUSION_BODY_PARTS), v.FUSION_CT, v.XRAY)
OVERRIDE = Rulebook("override", _book(v.OVERRIDE_ANGIO, v.OVERRIDE_US, v.OVERRIDE_HYBRID, v.OVERRIDE_HIRN, v.OVERRIDE_BODY, v.OVERRIDE_CT, v.XRAY), v.PRIORITY_OVERRIDE, v.CLASSES_OVERRIDE)
FUSION = Rulebook("fusion", _FUSED, v.PRIORITY_FUSION, v.CLASSES_FUSION, v.BONUS_FUSION)
AGREEMENT = Rulebook("agreement", _FUSED, v.PRIORITY_FUSION, v.CLASSES_FUSION)
PROFILES = {b.name: b for b in (OVERRIDE, AGREEMENT, FUSION)}


def _quoted(x: str) -> str:
    return 'r"' + x + '"'  # raw: no pattern holds a double quote


#: What Python's split() takes for white space and the expressions of ``text`` don't.
_SEPARATORS = re.compile("[\x1c-\x1f]")
_WHITE = re.compile(r"[^\S\x1c-\x1f]+")


def normalized(text: str) -> str:
    """As ``text.normalize_for_rules``."""
    t = text.lower()
    for c in "_/\\-":
        t = t.replace(c, " ")
    return _WHITE.sub(" ", t).strip(" ") if _SEPARATORS.search(t) else " ".join(t.split())


def _matches(book: Rulebook):
    """A function of a text column: struct<empty, found>, the places of all matching patterns in the rulebook's rows."""
    patterns = tuple(p for ps in book.patterns.values() for p in ps)

    @F.arrow_udf("empty boolean, found array<int>")
    def run(texts: pa.Array) -> pa.Array:
        m, empty, found = matcher(patterns), [], []
        for t in map(normalized, each_text(texts)):
            empty.append(not t)
            found.append(list(m.found(t, t)))
        return pa.StructArray.from_arrays([pa.array(empty, pa.bool_()), pa.array(found, pa.list_(pa.int32()))], ["empty", "found"])

    return run.asNondeterministic()  # else filters would be pushed below it with a copy of it


def hits(found: str, book: Rulebook) -> Column:
    """array<struct<label, pos, score, priority, is_filter, patterns>> of the labels with a match, in rulebook
    order. ``found`` holds the places of the matching patterns."""
    per_label, a = [], 0
    for pos, (label, patterns) in enumerate(book.patterns.items()):
        own = f"transform(filter(`{found}`, k -> k >= {a} and k < {a + len(patterns)}), k -> element_at(array({', '.join(map(_quoted, patterns))}), k - {a} + 1))"
        per_label.append(f"named_struct('label', '{label}', 'pos', {pos}, 'priority', {book.priority[label]}, 'is_filter', {str(label in v.FILTER_CLASSES).lower()}, 'patterns', {own})")
        a += len(patterns)
    some = "filter(array(" + ", ".join(per_label) + "), h -> size(h.patterns) > 0)"
    return F.expr(f"transform({some}, h -> named_struct('label', h.label, 'pos', h.pos, 'score', size(h.patterns), 'priority', h.priority, 'is_filter', h.is_filter, 'patterns', h.patterns))")


def _with_hits(df, text: str, book: Rulebook, out: str):
    """Adds __empty, whether the text is, and ``out``."""
    bound_batches(df.sparkSession)
    df = df.withColumn("__m", _matches(book)(F.col(text)))
    df = df.withColumns({"__empty": F.col("__m.empty"), "__found": F.col("__m.found")})
    return once(df, out, hits("__found", book)).drop("__m", "__found")


def _best(found: Column) -> Column:
    """The hit with the highest score, then priority; among equals the first in the rulebook."""
    keyed = F.transform(found, lambda x: F.struct((-x["score"]).alias("a"), (-x["priority"]).alias("b"), x["pos"].alias("c"), x.alias("hit")))
    return F.array_min(keyed)["hit"]


def with_rule_hits(df, text: str, book: Rulebook, out: str = "rule_hits"):
    return _with_hits(df, text, book, out).drop("__empty")


def classify(df, text: str, book: Rulebook):
    """Adds rule_hits, rule_pred, rule_reason and matched (the winning label's first five patterns).

    Null or empty text: ``unknown``, ``empty_text``. No hit: ``unknown``, ``no_rule_match``. A filter class
    wins over every imaging class; then a hybrid hit, then an angiography hit, then the best score.
    """
    df = _with_hits(df, text, book, "__hits")
    found = F.col("__hits")
    scored = F.transform(found, lambda x: x.withField("score", x["score"] + _bonus(x["label"], book)))
    filters = F.filter(found, lambda x: x["is_filter"])
    named = lambda label: F.filter(found, lambda x: x["label"] == label)
    winner = (
        F.when(F.size(filters) > 0, _best(filters)).when(F.size(named(v.HYBRID)) > 0, named(v.HYBRID)[0])
        .when(F.size(named(v.ANGIO)) > 0, named(v.ANGIO)[0]).when(F.size(found) > 0, _best(scored))
    )
    df = once(df, "__w", winner)
    w = F.col("__w")
    reason = (
        F.when(F.col("__empty"), "empty_text").when(F.size("__hits") == 0, "no_rule_match")
        .when(w["is_filter"], F.concat(F.lit("forced_filter:"), w["label"]))
        .when(w["label"] == v.HYBRID, "forced_hybrid_ct").when(w["label"] == v.ANGIO, "forced_angiography")
        .otherwise(F.concat(F.lit("parallel_rule:"), w["label"], F.lit("; hits="), w["score"].cast("string")))
    )
    return df.withColumns({
        "rule_hits": found, "rule_pred": F.coalesce(w["label"], F.lit("unknown")), "rule_reason": reason,
        "matched": F.coalesce(F.array_join(F.slice(w["patterns"], 1, 5), " | "), F.lit("")),
    }).drop("__empty", "__hits", "__w")


def _bonus(label: Column, book: Rulebook) -> Column:
    out = F.lit(0)
    for name, points in book.bonus.items():
        out = F.when(label == name, points).otherwise(out)
    return out

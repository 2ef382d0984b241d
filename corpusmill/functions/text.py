"""Caption text as column expressions: normalization, predicates, panel tokens."""

from __future__ import annotations

import re
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from .literals import each_text, matcher, required_literal
from .vocabulary import ANIMAL_PATTERNS, BAD_BEFORE, OCR_PANELS, OCR_PANELS_EARLY, PANEL_PATTERNS

#: Java flags under which its classes mean what Python's mean: Unicode classes, and "\n" alone ends a line.
UNICODE = "(?Ud)"
IGNORE_CASE = "(?iuUd)"


def normalize_text(c: Column) -> Column:
    """Null is empty; any run of white space is one space; none at the ends."""
    return F.btrim(F.regexp_replace(F.coalesce(c, F.lit("")), rf"{UNICODE}\s+", " "))


def normalize_for_rules(c: Column) -> Column:
    """Lower case, with underscores, slashes, backslashes and hyphens as spaces."""
    plain = F.regexp_replace(F.lower(normalize_text(c)), r"[_/\\-]+", " ")
    return F.btrim(F.regexp_replace(plain, rf"{UNICODE}\s+", " "))


def _stripped(c: Column) -> Column:
    return F.regexp_replace(F.coalesce(c, F.lit("")), rf"{UNICODE}^\s+|\s+\z", "")


def first_text(*fields: Column) -> Column:
    """The first field with text, stripped; empty if none has any."""
    return F.coalesce(*[F.nullif(_stripped(c), F.lit("")) for c in fields], F.lit(""))


def joined_text(first: Column, second: Column, *others: Column) -> Column:
    """The first two fields together if both have text, else the first field that has."""
    a, b = _stripped(first), _stripped(second)
    return F.when((a != "") & (b != ""), F.concat_ws(" ", a, b)).otherwise(first_text(first, second, *others))


def matches_any(c: Column, patterns: list[str]) -> Column:
    """Whether any of the patterns matches, whatever the case; null is no match. A pattern is tried only where the
    letters that its matches must hold stand in the text."""
    # As the patterns see them, these are i, i and s; lower() knows all other letters.
    plain = F.translate(F.lower(F.translate(c, "\u0130", "i")), "\u0131\u017f", "is")
    guarded = lambda x, p: F.contains(x, F.lit(required_literal(p).lower())) & c.rlike(IGNORE_CASE + p)
    return F.coalesce(F.exists(F.array(plain), lambda x: reduce(lambda a, b: a | b, [guarded(x, p) for p in dict.fromkeys(patterns)])), F.lit(False))


#: Letters that the patterns take for i, i and s; lower() knows all others.
_ALIKE = str.maketrans("\u0130\u0131\u017f", "iis")


def _any_animal(texts: pa.Array) -> pa.Array:
    m = matcher(tuple(dict.fromkeys(ANIMAL_PATTERNS)), re.I)
    lowered = lambda x: x.lower() if x.isascii() else x.translate(_ALIKE).lower()
    return pa.array([any(True for _ in m.found(x, lowered(x))) for x in each_text(texts)], pa.bool_())


def has_animal(c: Column) -> Column:
    """Whether any animal is named, whatever the case; null has none."""
    return F.arrow_udf(_any_animal, "boolean").asNondeterministic()(c)  # else filters with it were pushed below a repartitioning


def first_animal(c: Column) -> Column:
    """The first match as it stands in the text; null if there is none."""
    return F.when(has_animal(c), F.nullif(F.regexp_extract(c, f"{IGNORE_CASE}({'|'.join(ANIMAL_PATTERNS)})", 1), F.lit("")))


def has_panels(c: Column) -> Column:
    return matches_any(c, PANEL_PATTERNS)


def first_panel(c: Column) -> Column:
    return F.when(has_panels(c), F.nullif(F.regexp_extract(c, f"{IGNORE_CASE}({'|'.join(PANEL_PATTERNS)})", 1), F.lit("")))


def has_real_panels(c: Column) -> Column:
    """Two panel letters at least, and two of them where a sentence starts."""
    marks = F.size(F.regexp_extract_all(c, F.lit(r"(\([A-Za-z]\))"), 1))
    starts = F.size(F.regexp_extract_all(c, F.lit(rf"{UNICODE}((?:^|[.;:]\s*)\([A-Za-z]\)\s+[A-Z])"), 1))
    return F.coalesce((marks >= 2) & (starts >= 2), F.lit(False))


def starts_panel(before: Column, after: Column) -> Column:
    """Whether a panel mark between these texts opens a panel instead of referring to one."""
    ends = F.lower(F.right(before, F.lit(40)))
    refers = F.lit(False)
    for phrase in BAD_BEFORE:
        refers = refers | ends.endswith(phrase)
    return ~refers & F.regexp_replace(F.left(after, F.lit(80)), rf"{UNICODE}^\s+", "").rlike(r"^[\p{Lu}\p{Nd}]")


def panel_range(first: Column, last: Column) -> Column:
    """Capital letters from first to last; none if they are the wrong way round."""
    a, b = F.ascii(F.upper(first)), F.ascii(F.upper(last))
    return F.when(a <= b, F.transform(F.sequence(a, F.greatest(a, b)), lambda k: F.chr(k))).otherwise(F.array().cast("array<string>"))


def ocr_panels(ocr: Column) -> Column:
    """Panel names among the words of an OCR text, each once, in order of appearance."""
    tokens = F.regexp_extract_all(F.upper(F.coalesce(ocr, F.lit(""))), F.lit(rf"{UNICODE}(\b[A-Z]\b|\b\d+\b)"), 1)
    return F.array_distinct(F.filter(tokens, lambda t: t.isin(OCR_PANELS)))


def ocr_word_panels(ocr: Column, names: list[str] = OCR_PANELS_EARLY) -> Column:
    """The looser form: words of an OCR text that are panel names once all but letters and digits is taken away."""
    words = F.split(F.regexp_replace(F.coalesce(ocr, F.lit("")), rf"{UNICODE}\s+", " "), " ")
    return F.array_distinct(F.filter(F.transform(words, lambda w: F.upper(F.regexp_replace(w, "[^A-Za-z0-9]", ""))), lambda t: t.isin(names)))


def chosen_panels(prefix: Column, sections: Column, found: Column) -> Column:
    """For every found panel that has a section: the prefix and the section. ``sections``: array<struct<panel,text>>."""
    by_name = F.map_from_entries(sections)
    have = F.filter(found, lambda p: F.array_contains(F.transform(sections, lambda s: s["panel"]), p))
    return F.transform(have, lambda p: F.btrim(F.concat(prefix, F.lit(" "), F.element_at(by_name, p))))

"""Splitting captions with several panels, and narrowing a caption to the panels an image shows.

The split walks the text with positions and state, which expressions can't do; it is an Arrow-batched UDF.
"""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as t
from ..functions.batches import bound_batches
from ..functions.vocabulary import BROKEN_ENDINGS, ENUM_KEYWORDS, LONE_LETTERS, REFERENCE_PHRASES

SECTIONS = "prefix string, sections array<struct<panel: string, text: string>>"
#: Texts of an Arrow batch that are Python objects at a time.
PIECE = 128
_DASH = "[–-]"
_ONE = r"\(\s*(?P<one>[A-Z]|[a-z])\s*\)"
_LIST = r"\(\s*(?P<list>[A-Z]\s*,\s*[A-Z](?:\s*,\s*[A-Z])*|[a-z]\s*,\s*[a-z](?:\s*,\s*[a-z])*)\s*\)"
_RANGE = rf"\(\s*(?P<range>[A-Z]\s*{_DASH}\s*[A-Z]|[a-z]\s*{_DASH}\s*[a-z])\s*\)"
_MARK = re.compile(f"{_ONE}|{_LIST}|{_RANGE}")
_BROKEN = re.compile(rf"\b(?:{'|'.join(BROKEN_ENDINGS)})$")
_START = r"(?:^|\n|\.\s|;\s)"
_FREE = {
    "agreement": re.compile(rf"\(([a-z])\)|\((\d+)\)|\bPanel\s+([a-z])\b|\bPanel\s+(\d+)\b|\bfig(?:ure)?\.?\s*\d+\s*([a-z])\b|{_START}([a-z])[:.]|{_START}([a-z])\s+(?=[a-z])", re.I),
    "fusion": re.compile(r"\(([a-z])\)|\bPanel\s+([a-z])\b|^([a-z])[:.]", re.I),
}


def _named(m: re.Match) -> list[str]:
    if m["range"]:
        a, b = re.split(rf"\s*{_DASH}\s*", m["range"].upper())
        return [chr(k) for k in range(ord(a), ord(b) + 1)]
    return [x.strip().upper() for x in (m["one"] or m["list"]).split(",")]


def split_strict(text: str) -> tuple[dict[str, str], str]:
    """Sections by panel letter in order of appearance, and the text before the first mark."""
    marks = list(_MARK.finditer(text))
    if not marks:
        return {}, text.strip()
    sections: dict[str, str] = {}
    for m, following in zip(marks, [*marks[1:], None], strict=True):
        if text[max(0, m.start() - 40) : m.start()].lower().strip().endswith(tuple(REFERENCE_PHRASES)):
            continue
        part = " ".join(text[m.end() : following.start() if following else len(text)].split())
        low = part.lower()
        listed = len(part.split()) <= 5 and not any(k in low for k in ENUM_KEYWORDS)
        if len(part) < 8 or listed or _BROKEN.search(low):
            continue
        opens = re.match(r"\s+[A-Z]", text[m.end() : m.end() + 20])
        for p in _named(m):
            if p not in LONE_LETTERS or opens:
                sections[p] = f"{sections[p]} {part}" if p in sections else part
    return sections, text[: marks[0].start()].strip()


def split_free(text: str, profile: str) -> tuple[dict[str, str], str]:
    """As above with the looser marks of a profile; the last section of a panel wins."""
    marks = list(_FREE[profile].finditer(text))
    if not marks:
        return {}, text
    ends = [m.start() for m in marks[1:]] + [len(text)]
    sections = {next(g for g in m.groups() if g).upper(): text[m.end() : e].strip() for m, e in zip(marks, ends, strict=True)}
    return sections, text[: marks[0].start()].strip()


def split_panels(df: DataFrame, text: str, profile: str = "override") -> DataFrame:
    """Adds prefix and sections. Null text counts as empty."""

    kinds = [pa.string(), pa.list_(pa.struct([("panel", pa.string()), ("text", pa.string())]))]

    def split(texts: list[str]) -> pa.StructArray:
        found = [split_strict(x) if profile == "override" else split_free(x, profile) for x in texts]
        columns = [p for _, p in found], [[{"panel": k, "text": s} for k, s in d.items()] for d, _ in found]
        return pa.StructArray.from_arrays([pa.array(c, kind) for c, kind in zip(columns, kinds, strict=True)], ["prefix", "sections"])

    @F.arrow_udf(SECTIONS)
    def run(texts: pa.Array) -> pa.Array:
        # A piece of a batch at a time, else all its texts and sections were Python objects at once.
        pieces = [split([x or "" for x in texts[a : a + PIECE].to_pylist()]) for a in range(0, len(texts), PIECE)]
        return pa.concat_arrays(pieces) if pieces else split([])

    # Else it would be run once for each column that is taken from it.
    run = run.asNondeterministic()
    bound_batches(df.sparkSession)
    return df.withColumn("__s", run(F.col(text))).withColumns({"prefix": F.col("__s.prefix"), "sections": F.col("__s.sections")}).drop("__s")


def narrow_to_panels(df: DataFrame, text: str = "text", ocr: str = "ocr_text") -> DataFrame:
    """The caption of the panels that OCR saw, for captions that really have several.

    Adds original_caption, ocr_used, ocr_found_panels, ocr_panel_section_keys and ocr_selected_texts. Rows that
    don't pass the two tests never reach the splitter. With panels found but none in the caption the OCR text
    is dropped; with none found it stays.
    """
    gate = t.has_panels(F.col(text)) & t.has_real_panels(F.col(text))
    empty = F.array().cast("array<string>")
    plain = df.where(~gate).withColumns({"original_caption": F.col(text), "ocr_used": F.lit(False), "ocr_found_panels": empty, "ocr_panel_section_keys": empty, "ocr_selected_texts": empty, ocr: F.lit("")})
    multi = split_panels(df.where(gate).withColumn("original_caption", F.col(text)), text)
    multi = multi.withColumn("__found", t.ocr_panels(F.col(ocr))).withColumn("__texts", t.chosen_panels(F.col("prefix"), F.col("sections"), F.col("__found")))
    used = F.size("__texts") > 0
    multi = multi.withColumns({
        text: F.when(used, F.array_join("__texts", " ")).otherwise(F.col(text)), "ocr_used": used,
        ocr: F.when(used | (F.size("__found") == 0), F.coalesce(F.col(ocr), F.lit(""))).otherwise(""),
        "ocr_found_panels": F.when(used, F.col("__found")).otherwise(empty), "ocr_panel_section_keys": F.when(used, F.transform("sections", lambda s: s["panel"])).otherwise(empty),
        "ocr_selected_texts": F.when(used, F.col("__texts")).otherwise(empty),
    }).drop("prefix", "sections", "__found", "__texts")
    return plain.unionByName(multi)

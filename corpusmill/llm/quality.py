"""Quality rules with thresholds learned per language and source.

Text statistics are taken from every whole text. The cutoffs are fences of mergeable quantile
sketches (KLL): one sketch per (language, source), merged into one per language and one over all.
A group with too few documents for a sharp tail takes the next wider sketch. The thresholds are
joined back to the documents and decide.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from .common import Words, chunks, in_batches, mix64, small, staged

#: metric -> (fence above, fence below, statistic it is a share of, size of one event in it). The sketches alone
#: set the fences.
FENCES = {
    "symbol_share": (True, False, "word_chars", 1),  # symbols per word character
    "shout_share": (True, False, "word_chars", 1),  # exclamation and question marks per word character
    "upper_share": (True, False, "word_chars", 1),  # A-Z per word character
    "dup_line_share": (True, False, "n_lines", 1),
    "repeat_share": (True, False, "n_words", 6),  # a group of three words that stands twice
    "mean_word_chars": (True, True, "n_words", 1),
}
MIN_GROUP = 50
REACH = 3.0
#: So many events beyond the fence reject nothing: a short text reaches any share by one or two.
EVENTS = 3
#: Ranks at which the language's sketch is read for its mean distance from the median.
GRID = [(2 * i + 1) / 200 for i in range(100)]
SKETCH_K = 400
STATS = ["n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words", "n_shouts", "n_upper"]
_SYMBOLS = re.compile(r"[#*$%&|<>]+")
_BLANK = " \t\n\x0b\x0c\r"


def _line_stats(text: str) -> tuple[int, int]:
    """Lines with a word, and those of them that equal an earlier line."""
    lines = [x for x in text.split("\n") if x.strip(_BLANK)]
    return len(lines), len(lines) - len(set(lines))


def _stats(texts: list[str | None]) -> list[np.ndarray]:
    raw = [t.encode("utf-8", "surrogatepass") if t else b"" for t in texts]
    words = Words(raw)
    n = len(texts)
    spaces = np.array([sum(t.count(c) for c in _BLANK) if t else 0 for t in texts], np.int64)
    chars = np.array([len(t) if t else 0 for t in texts], np.int64)
    symbols = np.array([sum(map(len, _SYMBOLS.findall(t))) if t else 0 for t in texts], np.int64)
    lines = np.array([_line_stats(t) if t else (0, 0) for t in texts], np.int64).reshape(n, 2)
    gram, at = words.grams(3)
    key = gram ^ mix64(words.doc[at].astype(np.uint64) + np.uint64(77))
    order = np.argsort(key, kind="stable")
    same = key[order][1:] == key[order][:-1] if len(key) > 1 else np.zeros(0, bool)
    twice = np.zeros(len(key), bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    covered = np.zeros(len(words.h) + 3, bool)
    for k in range(3):
        covered[at[twice] + k] = True
    repeated = np.bincount(words.doc[covered[: len(words.h)]], minlength=n)
    shouts = np.array([t.count("!") + t.count("?") if t else 0 for t in texts], np.int64)
    ends = np.cumsum(np.array([len(t) + 1 for t in raw]))
    capital = (words.data >= 65) & (words.data <= 90)
    upper = np.add.reduceat(capital.astype(np.int64), np.concatenate(([0], ends[:-1])))
    return [words.count, chars - spaces, symbols, lines[:, 0], lines[:, 1], repeated, shouts, upper]


def _text_stats(batches):
    for batch in small(batches):
        texts = batch.column(batch.num_columns - 1).to_pylist()
        parts = [_stats(texts[a:b]) for a, b in chunks(texts)]
        if parts:
            own = [pa.array(np.concatenate(x).astype(np.int64)) for x in zip(*parts, strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *own], [*batch.schema.names[:-1], *STATS])


def text_stats(docs: DataFrame, text: str = "text", keep: tuple = ("doc_id", "lang", "source")) -> DataFrame:
    """The columns ``keep`` of each document and the statistics of its text. Null text: no words, no lines."""
    df = docs.select(*keep, F.col(text).cast("string").alias("__text"))
    return in_batches(df, _text_stats, StructType([*df.schema.fields[:-1], *[StructField(c, LongType()) for c in STATS]]))


def _metrics(df: DataFrame) -> DataFrame:
    ratio = lambda a, b: F.coalesce(F.try_divide(F.col(a).cast("double"), F.col(b).cast("double")), F.lit(0.0))
    return df.withColumns({
        "symbol_share": ratio("n_symbols", "word_chars"), "shout_share": ratio("n_shouts", "word_chars"), "upper_share": ratio("n_upper", "word_chars"),
        "dup_line_share": ratio("n_dup_lines", "n_lines"),
        "repeat_share": ratio("n_repeat_words", "n_words"), "mean_word_chars": ratio("word_chars", "n_words"),
        "base_failed": (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words")),
    })


def learned_thresholds(stats: DataFrame, min_group: int = MIN_GROUP, reach: float = REACH, k: int = SKETCH_K) -> DataFrame:
    """(lang_of, source_of) -> fences, from sketches of all documents that pass the base rules.

    An upper fence is q75 + reach * max(q75 - q25, d); a lower one mirrors it. d is the mean distance from the
    median over the language, or over all where the language is small, so that a group whose quartiles coincide
    still has a width, and one that is learned.
    """
    base = stats.where(~F.col("base_failed"))
    leaf = base.groupBy("lang", "source").agg(F.count(F.lit(1)).alias("n"), *[F.kll_sketch_agg_double(m, F.lit(k)).alias(m) for m in FENCES])
    # One row a (language, source); each is read three times, so it is written once.
    leaf = staged(leaf, "quality-sketches")
    wider = leaf.groupBy(F.col("lang").alias("lang1")).agg(F.sum("n").alias("n1"), *[F.kll_merge_agg_double(m).alias(f"{m}1") for m in FENCES])
    whole = leaf.groupBy(F.lit(1).alias("one2")).agg(F.sum("n").alias("n2"), *[F.kll_merge_agg_double(m).alias(f"{m}2") for m in FENCES])
    known = stats.select(F.col("lang").alias("l"), F.col("source").alias("s"), F.lit(1).alias("one")).distinct()
    rows = known.join(leaf, F.col("l").eqNullSafe(F.col("lang")) & F.col("s").eqNullSafe(F.col("source")), "left").drop("lang", "source")
    rows = rows.join(wider, F.col("l").eqNullSafe(F.col("lang1")), "left").join(F.broadcast(whole), F.col("one") == F.col("one2"), "left")  # whole: at most one row
    for m in FENCES:
        wide = F.when(F.col("n1") >= min_group, F.col(f"{m}1")).otherwise(F.col(f"{m}2"))
        rows = rows.withColumns({m: F.when(F.col("n") >= min_group, F.col(m)).otherwise(wide), f"{m}_wide": wide})
    at = lambda m, q: F.when(F.col("n2") > 0, F.kll_sketch_get_quantile_double(m, q))
    for m in FENCES:
        rows = rows.withColumns({f"{m}_low": at(m, F.lit(0.25)), f"{m}_high": at(m, F.lit(0.75)), f"{m}_mid": at(f"{m}_wide", F.lit(0.5)), f"{m}_grid": at(f"{m}_wide", F.array(*map(F.lit, GRID)))})
    out = []
    for m, (upper, lower, *_) in FENCES.items():
        low, high, mid = F.col(f"{m}_low"), F.col(f"{m}_high"), F.col(f"{m}_mid")
        away = F.aggregate(f"{m}_grid", F.lit(0.0), lambda a, x: a + F.abs(x - mid)) / len(GRID)  # noqa: B023
        width = reach * F.greatest(high - low, away)
        if upper:
            out.append((high + width).alias(f"{m}_max"))
        if lower:
            out.append((low - width).alias(f"{m}_min"))
    return rows.select(F.col("l").alias("lang_of"), F.col("s").alias("source_of"), *out)


def _limits(docs: DataFrame, text: str, **how) -> tuple[DataFrame, DataFrame]:
    """The statistics of all documents, and the thresholds learned from them (a row a language and source)."""
    stats = staged(_metrics(text_stats(docs, text)), "quality-stats")
    return stats, staged(learned_thresholds(stats, **how), "quality-limits")


def _judged(stats: DataFrame, limits: DataFrame) -> DataFrame:
    """``stats`` with ``kept``. The thresholds are a written table, so Spark knows if it may broadcast them."""
    fine = F.lit(True)
    for m, (upper, lower, whole, event) in FENCES.items():
        few = F.coalesce(F.try_divide(F.lit(EVENTS * event), F.col(whole)), F.lit(0.0))
        if upper:
            fine = fine & F.coalesce(F.col(m) <= F.col(f"{m}_max") + few, F.lit(True))
        if lower:
            fine = fine & F.coalesce(F.col(m) >= F.col(f"{m}_min") - few, F.lit(True))
    same = F.col("lang").eqNullSafe(F.col("lang_of")) & F.col("source").eqNullSafe(F.col("source_of"))
    joined = stats.join(limits, same, "left").drop("lang_of", "source_of")
    return joined.withColumn("kept", ~F.col("base_failed") & fine)


def quality_verdicts(docs: DataFrame, text: str = "text", **how) -> DataFrame:
    """Statistics, ``base_failed`` and ``kept`` for every document.

    Null language or source is a group of its own. Null or empty text has no words and fails the base
    rules. Repeated rows and rows with a null doc_id are judged row by row. An empty table gives an empty
    result. Further columns of the input are ignored.
    """
    return _judged(*_limits(docs, text, **how))


def quality_filter(docs: DataFrame, text: str = "text", **how) -> DataFrame:
    """``docs`` without the rejected rows, all columns as they were, whatever their names.

    Each row is judged by itself, repeated ones too: the statistics are taken once to learn the thresholds and
    once more where the row stands, so no text is shuffled.
    """
    limits = _limits(docs, text, **how)[1]
    rows = text_stats(docs, text, keep=(F.struct("*").alias("__row"), "lang", "source"))
    return _judged(_metrics(rows), limits).where("kept").select("__row.*")

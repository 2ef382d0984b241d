"""Cross-site boilerplate lines, by the number of distinct sites that carry a line.

Everything here is DataFrame expressions. HyperLogLog sketches of the sites, one per line hash, merge by
aggregation; only lines whose estimate lies near the threshold get an exact distinct count. The count is taken
twice: over all documents, then over those that are not mostly made of the lines found first. All lines of a
document that was copied to many sites stand on many sites; those that stand in unlike documents too are boilerplate.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import staged

MIN_SITES = 10
#: Estimates outside MIN_SITES * (LOW, HIGH) decide by themselves; the sketch's error is far smaller.
LOW, HIGH = 0.75, 1.33
LG_K = 12
#: A document that consists of widespread lines by at least this share is no evidence that they are boilerplate.
COPY_SHARE = 0.5
_BLANK = " \t\x0b\x0c\r"


def _lines(docs: DataFrame, text: str, site: str) -> DataFrame:
    """A row for each line with a word: document, position, hash of the trimmed line, its length, site."""
    rows = docs.select(
        F.col("doc_id").alias("id"), F.xxhash64(text).alias("th"),
        F.when(F.col(site).isNull(), F.lit("n")).otherwise(F.concat(F.lit("s"), F.col(site).cast("string"))).alias("site"),
        F.posexplode(F.split(F.col(text), "\n", -1)).alias("pos", "line"),
    )
    line = F.btrim("line", F.lit(_BLANK))
    return rows.select("id", "th", "site", "pos", F.xxhash64(line).alias("h"), F.length(line).alias("size")).where("size > 0")


def spread_lines(lines: DataFrame, min_sites: int = MIN_SITES) -> DataFrame:
    """The hashes (h) of lines that stand on at least ``min_sites`` distinct sites."""
    # One row a line and site, summed before it is shuffled: from here a very common line is as many rows as it has sites.
    sites = staged(lines.groupBy("h", "site").agg(F.count(F.lit(1)).alias("n")), "line-by-site")
    # A line has no more sites than occurrences, so rarer lines need no sketch.
    often = sites.groupBy("h").agg(F.sum("n").alias("n")).where(F.col("n") >= min_sites).select("h")
    some = sites.select("h", "site").join(often, "h", "left_semi")
    sketch = some.groupBy("h").agg(F.hll_sketch_agg("site", F.lit(LG_K)).alias("s"))
    guess = staged(sketch.select("h", F.hll_sketch_estimate("s").alias("sites")), "line-sites")
    near = guess.where(F.col("sites").between(LOW * min_sites, HIGH * min_sites)).select("h")
    exact = sites.select("h").join(near, "h", "left_semi").groupBy("h").agg(F.count(F.lit(1)).alias("n"))
    return guess.where(F.col("sites") > HIGH * min_sites).select("h").unionByName(exact.where(F.col("n") >= min_sites).select("h"))


def boilerplate_lines(lines: DataFrame, min_sites: int = MIN_SITES, copy_share: float = COPY_SHARE) -> DataFrame:
    """The hashes (h) of lines that stand on ``min_sites`` distinct sites in documents of which lines on so many sites
    are less than ``copy_share``."""
    wide = staged(spread_lines(lines, min_sites), "line-wide")
    hit = F.when(F.col("wide"), F.col("size")).otherwise(0)
    share = lines.join(wide.withColumn("wide", F.lit(True)), "h", "left").groupBy("id", "th").agg(F.sum("size").alias("whole"), F.sum(hit).alias("gone"))
    unlike = share.where((F.col("gone") > 0) & (F.col("gone") < copy_share * F.col("whole"))).select(F.col("id").alias("u"), F.col("th").alias("uh"))
    some = lines.join(wide, "h", "left_semi")
    return spread_lines(some.join(unlike, some["id"].eqNullSafe(F.col("u")) & (some["th"] == F.col("uh")), "left_semi"), min_sites)


def drop_spread_lines(docs: DataFrame, text: str = "text", site: str = "source", min_sites: int = MIN_SITES, copy_share: float = COPY_SHARE) -> DataFrame:
    """``docs`` with boilerplate lines taken out of ``text``; every document stays.

    Two columns are added, ``__lines`` and ``__removed`` (long): its lines with a word, and those taken out; columns of
    these names in ``docs`` are replaced. Lines are split at \\n and compared without surrounding blanks; lines
    without a word are never touched. A boilerplate line (see ``boilerplate_lines``) is taken out wherever it stands,
    in documents of nothing else too. A null site is one site. Null text stays null. Repeated rows are treated
    alike, rows with a null doc_id by their texts. Further columns pass through. An empty table gives an empty result.
    """
    lines = staged(_lines(docs, text, site), "lines")
    spread = staged(boilerplate_lines(lines, min_sites, copy_share), "line-spread")
    hits = lines.join(spread, "h", "left_semi").groupBy("id", "th").agg(F.array_sort(F.collect_set("pos")).alias("__pos"))
    hits = hits.select(F.col("id").alias("__id"), F.col("th").alias("__th"), "__pos")
    rows = docs.select(F.struct("*").alias("__row"), F.col("doc_id").alias("__doc"), F.col(text).alias("__text"), F.xxhash64(text).alias("__h"))
    out = rows.join(hits, F.col("__doc").eqNullSafe(F.col("__id")) & (F.col("__h") == F.col("__th")), "left")
    parts = F.split("__text", "\n", -1)
    full = F.size(F.filter(parts, lambda x: F.length(F.btrim(x, F.lit(_BLANK))) > 0))
    stay = F.array_except(F.sequence(F.lit(0), F.size(parts) - 1), F.col("__pos"))
    left = F.when(F.col("__pos").isNotNull(), F.array_join(F.transform(stay, lambda i: F.get(parts, i)), "\n")).otherwise(F.col("__text"))
    own = [left.alias(c) if c == text else F.col("__row").getField(c).alias(c) for c in docs.columns if c not in ("__lines", "__removed")]
    n_lines = F.when(F.col("__text").isNull(), 0).otherwise(full).cast("long")
    return out.select(*own, n_lines.alias("__lines"), F.coalesce(F.size("__pos"), F.lit(0)).cast("long").alias("__removed"))

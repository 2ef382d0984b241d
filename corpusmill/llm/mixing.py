"""Mixing sources to target weights by the cube method.

A source's target is shared water: ``min(cap * size, level * weight)``. Every document of a source has the
same expected number of copies, target / size; its whole part is certain, its fraction is an inclusion
probability. The flight phase moves three fractional probabilities at a time along the null space of two
constraints, the source's words and its documents, until one of them is 0 or 1; both totals stay as they
were. Blocks of documents fly on their own, what is left of them meets in fewer blocks, and the last few
of a source, held back for it, are landed by trying all their subsets.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import staged

WEIGHTS = (3, 1, 2)
SHARE = 1.5
CAP = 2.0
#: Documents that fly in one block, and those of a block that are handed on.
BLOCK = 4096
KEEP = 14
_JAVA_WORD = r"[^\x20\x09-\x0D]+"


def _ranked(src: DataFrame) -> DataFrame:
    """``src`` with sid: the rank of its source by code point from 1, null last. No task sees all sources."""
    ordered = src.repartitionByRange(F.col("source").asc_nulls_last()).sortWithinPartitions(F.col("source").asc_nulls_last())
    at = F.monotonically_increasing_id()  # the partition, then the place in it
    placed = staged(ordered.withColumn("at", at).select("*", F.shiftright("at", 33).alias("part")), "mix-sources")
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # over a row a partition
    start = placed.groupBy("part").agg(F.count(F.lit(1)).alias("c")).select("part", F.coalesce(F.sum("c").over(before), F.lit(0)).alias("before"))
    return placed.join(start, "part").withColumn("sid", F.col("before") + F.col("at").bitwiseAND(F.lit((1 << 33) - 1)) + 1).drop("at", "part", "before")


def source_targets(sized: DataFrame, weights=WEIGHTS, share: float = SHARE, cap: float = CAP) -> DataFrame:
    """sid (rank of the source by code point, null last), source, n, source_size, target.

    The water level rises until it no longer fills a further source; a level takes one aggregate over the sources.
    """
    src = _ranked(sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("n")))
    src = staged(src.withColumn("w", F.element_at(F.array(*map(F.lit, weights)), F.pmod(F.col("sid") - 1, F.lit(len(weights))).cast("int") + 1).cast("long")), "mix-weights")
    full_at = F.col("source_size") * F.lit(float(cap))
    level, filled = 0.0, -1
    while True:
        full = (full_at < level * F.col("w")) if filled >= 0 else F.lit(False)
        x = src.agg(F.count_if(full).alias("n"), F.sum("source_size").alias("all"), F.sum(F.when(full, F.col("source_size"))).alias("closed"), F.sum(F.when(~full, F.col("w"))).alias("open")).first()
        if x["n"] == filled or not x["open"]:
            break
        level, filled = (share * x["all"] - cap * (x["closed"] or 0)) / x["open"], x["n"]
    return src.withColumn("target", F.least(full_at, level * F.col("w"))).select("sid", "source", "n", "source_size", "target")


def fly(size: np.ndarray, p: np.ndarray, keep: int, rng: np.random.Generator) -> np.ndarray:
    """Move the probabilities until at most ``keep`` are fractional; sums of p and size * p stay."""
    p = p.astype(float).copy()
    tiny = 1e-9
    queue = [i for i in np.argsort(size, kind="stable").tolist() if tiny < p[i] < 1 - tiny]
    if len(queue) > max(keep, 2):  # hold back documents of all sizes, so that their subsets land close
        held = set(np.linspace(0, len(queue) - 1, max(keep - 2, 0)).astype(int).tolist())
        queue = [i for k, i in enumerate(queue) if k not in held]
    else:
        queue = []
    p[(p <= tiny)], p[(p >= 1 - tiny)] = 0.0, 1.0
    chance = rng.random(len(size) + 1)
    at, active = 0, []
    while len(active) + len(queue) > 2:
        while len(active) < 3:
            active.append(queue.pop())
        i, j, k = active
        a, b, c = float(size[i]), float(size[j]), float(size[k])
        step = (b - c, c - a, a - b)
        if a == b == c:
            step = (1.0, -1.0, 0.0)
        up = min((1 - p[x]) / u if u > 0 else p[x] / -u for x, u in zip(active, step, strict=True) if u)
        down = min(p[x] / u if u > 0 else (1 - p[x]) / -u for x, u in zip(active, step, strict=True) if u)
        move = up if chance[at % len(chance)] * (up + down) < down else -down
        at += 1
        still = []
        for x, u in zip(active, step, strict=True):
            p[x] += move * u
            if p[x] <= tiny:
                p[x] = 0.0
            elif p[x] >= 1 - tiny:
                p[x] = 1.0
            else:
                still.append(x)
        active = still
    return p


def land(size: np.ndarray, p: np.ndarray) -> np.ndarray:
    """0 or 1 for each fractional probability: the subset whose words, then documents, come nearest."""
    at = np.flatnonzero((p > 0) & (p < 1))
    out = p.copy()
    if len(at):
        choice = (np.arange(1 << len(at))[:, None] >> np.arange(len(at))) & 1
        words = np.abs(choice @ size[at] - (size[at] * p[at]).sum())
        docs = np.abs(choice.sum(1) - p[at].sum())
        out[at] = choice[np.lexsort((docs, words))[0]]
    return out


def _flight(rows: pa.Table) -> pa.Table:
    rows = rows.sort_by([("size", "descending"), ("salt", "ascending"), ("doc_id", "ascending")])
    size, first = rows["size"].to_numpy().astype(float), {c: rows[c][0].as_py() for c in ("sid", "block", "blocks")}
    rng = np.random.default_rng([first["sid"], first["block"], first["blocks"]])
    p = fly(size, rows["p"].to_numpy(), KEEP, rng)
    p = land(size, p) if first["blocks"] == 1 else p
    return pa.table({"sid": rows["sid"], "doc_id": rows["doc_id"], "size": rows["size"], "p": p, "salt": rows["salt"], "blocks": rows["blocks"]})


def balanced_picks(units: DataFrame, block: int = BLOCK) -> DataFrame:
    """(sid, n, doc_id, salt, size, p) -> (sid, doc_id, size, p) with p 0 or 1, sums by sid kept; n: rows of the sid.

    A source flies in as many blocks as its rows need, so a large one is spread over many tasks. A block hands
    on KEEP rows at most, which tells the number of blocks of the next round.
    """
    done, left = None, units.withColumn("blocks", F.greatest(F.lit(1), F.ceil(F.col("n") / block)).cast("long"))
    while True:
        dealt = left.withColumn("block", F.pmod("salt", "blocks"))
        flown = dealt.select("sid", "doc_id", "size", "p", "salt", "blocks", "block").groupBy("sid", "block")
        now = staged(flown.applyInArrow(_flight, "sid long, doc_id long, size long, p double, salt long, blocks long"), "mix-flight")
        decided = now.where("p = 0 or p = 1").drop("blocks", "salt")
        done = decided if done is None else done.unionByName(decided)
        left = now.where("p > 0 and p < 1").withColumn("blocks", F.greatest(F.lit(1), F.ceil(F.col("blocks") * KEEP / block)).cast("long"))
        if left.isEmpty():
            return done


def mix(docs: DataFrame, text: str = "text", source: str = "source", **how) -> DataFrame:
    """doc_id, size, source_size, target and taken (words the mix takes, copies counted) for every row.

    Size: words of the text; null text has none and takes none. A null source is a source of its own, a null
    doc_id a document of its own. The same rows give the same mix on every run. Repeated rows are documents of
    their own. A source of one or few documents comes as near its target as whole documents allow. An empty
    table gives no rows. Further columns are ignored.
    """
    words = F.coalesce(F.regexp_count(F.col(text), F.lit(_JAVA_WORD)), F.lit(0)).cast("long")
    sized = staged(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(source).alias("source"), words.alias("size"), F.xxhash64("doc_id", text).alias("salt")), "mix-sizes")
    target = staged(source_targets(sized, **how), "mix-targets")
    own = target.withColumnRenamed("source", "s")
    units = sized.join(own, F.col("source").eqNullSafe(F.col("s")), "left").drop("s")
    copies = F.coalesce(F.try_divide(F.col("target"), F.col("source_size").cast("double")), F.lit(0.0))
    whole = F.floor(copies).cast("long")
    picked = balanced_picks(units.select("sid", "n", "doc_id", "salt", "size", (copies - whole).alias("p")))
    return picked.join(target, "sid").select("doc_id", "size", "source_size", "target", (F.col("size") * (whole + F.col("p").cast("long"))).alias("taken"))


def mixed_documents(docs: DataFrame, text: str = "text", source: str = "source", **how) -> DataFrame:
    """``docs`` as the mix takes them: left out, once or twice; all columns as they were, whatever their names.

    Documents without words (null or empty text) stay once. Rows are matched by doc_id, null ids with each other:
    where one repeats, each of its rows stands as often as the mix takes the most taken of them. An empty table
    gives an empty one.
    """
    taken = mix(docs, text, source, **how).select(F.col("doc_id").alias("__id"), F.when(F.col("size") > 0, (F.col("taken") / F.col("size")).cast("int")).otherwise(1).alias("__n"))
    most = taken.groupBy("__id").agg(F.max("__n").alias("__n")).where("__n > 0")
    rows = docs.select(F.struct("*").alias("__row"), F.col("doc_id").cast("long").alias("__doc"))
    joined = rows.join(most, F.col("__doc").eqNullSafe(F.col("__id"))).select("__row", F.explode(F.sequence(F.lit(1), F.col("__n"))))
    return joined.select("__row.*")

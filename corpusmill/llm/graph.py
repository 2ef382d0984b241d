"""Connected components over an edge table, as rounds of DataFrame joins; joins that no hot key can slow."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, staged

#: A key is hot if it has more than one in so many of all rows, so there are at most so many hot keys.
HOT_SHARE = 1000
#: Below this a key is never hot.
HOT_LEAST = 256
#: Edges that a task writes at least, so that few edges are few files.
EDGES = 250_000


def joined_by_key(rows: DataFrame, table: DataFrame, keys: list[str], total: int) -> DataFrame:
    """The inner join of ``rows`` with ``table``, which has one row a key and in ``c`` how many of the ``total`` rows
    have it. Hot keys, HOT_SHARE at most, are broadcast, so their rows stay where they are; no task reads more
    than a small part of the rest. ``c`` goes.
    """
    most = max(HOT_LEAST, total // HOT_SHARE)
    hot = F.broadcast(table.where(F.col("c") > most).drop("c"))
    light = rows.join(F.broadcast(table.where(F.col("c") > most).select(*keys)), keys, "left_anti").join(table.where(F.col("c") <= most).drop("c"), keys)
    return rows.join(hot, keys).unionByName(light)


def components(edges: DataFrame, name: str = "components") -> DataFrame:
    """``edges`` (a, b long) -> (node, component): the smallest node that each node reaches.

    Alternating large-star and small-star rounds: each hangs neighbours on the smallest known node and
    keeps no more edges than it got. The minimum of a node's neighbours is a partial aggregate; nodes with
    very many edges get it by broadcast. Each round is written to the shared folder and the one before it
    deleted. Null ends don't count, loops and repeated edges change nothing. Nodes without an edge don't appear.
    """
    now = staged(_clean(edges.select("a", "b")), name)
    mark = _mark(now)
    while True:
        tasks = 1 + mark[0] // EDGES
        half = staged(_large_star(now, 2 * mark[0]).coalesce(tasks), name)
        new = staged(_small_star(half, mark[0]).coalesce(tasks), name)
        seen = _mark(new)
        discard(half)
        discard(now)
        now = new
        if seen == mark:
            break
        mark = seen
    below = now.select(F.col("a").alias("node"), F.col("b").alias("component"))
    return below.unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())


def _clean(edges: DataFrame) -> DataFrame:
    """Each edge once, from the larger to the smaller node."""
    return edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()


def _mark(edges: DataFrame) -> tuple:
    # The sum wraps where it must: it's a fingerprint of the edge set.
    return tuple(edges.agg(F.count(F.lit(1)), F.coalesce(F.bit_xor(F.xxhash64("a", "b")), F.lit(0))).first())


def _large_star(edges: DataFrame, total: int) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"), F.count(F.lit(1)).alias("c"))
    larger = joined_by_key(both.where("b > a"), least, ["a"], total)
    return _clean(larger.select(F.col("b").alias("a"), F.col("m").alias("b")))


def _small_star(edges: DataFrame, total: int) -> DataFrame:
    least = edges.groupBy("a").agg(F.min("b").alias("m"), F.count(F.lit(1)).alias("c"))
    hung = joined_by_key(edges, least, ["a"], total)
    return _clean(hung.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(least.select("a", F.col("m").alias("b"))))

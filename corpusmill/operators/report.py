"""Distributions, rates, and the result browser's views."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.vocabulary import LEGACY_COLUMNS


def value_counts(df: DataFrame, column: str) -> DataFrame:
    """(value, n), nulls being a group of their own."""
    return df.groupBy(F.col(column).alias("value")).agg(F.count(F.lit(1)).alias("n"))


def distribution(df: DataFrame, column: str) -> DataFrame:
    """(value, n, percent)."""
    counts = value_counts(df, column)
    total = F.sum("n").over(Window.partitionBy())  # over the counted groups, not the rows
    return counts.withColumn("percent", 100.0 * F.col("n") / total)


def head_distribution(df: DataFrame, column: str, first: int) -> DataFrame:
    """The distribution over row_id below ``first``, with MISSING for nulls."""
    return value_counts(df.where(F.col("row_id") < first).withColumn(column, F.coalesce(column, F.lit("MISSING"))), column)


def top_values(df: DataFrame, column: str, first: int) -> DataFrame:
    """The ``first`` most frequent values with their shares; equal counts in the values' order, null first."""
    return distribution(df, column).orderBy(F.col("n").desc(), F.col("value").asc_nulls_first()).limit(first)


def filter_stats(df: DataFrame) -> DataFrame:
    flag = F.coalesce("is_filtered", F.lit(False))
    return df.agg(F.count(F.lit(1)).alias("total"), F.count_if(flag).alias("filtered"), F.count_if(~flag).alias("kept"))


def filter_rates(df: DataFrame) -> DataFrame:
    """Filtered rows in percent of all and of the kept ones; null where that is a division by zero."""
    s = filter_stats(df)
    return s.select(F.try_divide(100.0 * F.col("filtered"), F.col("total")).alias("of_all"), F.try_divide(100.0 * F.col("filtered"), F.col("kept")).alias("of_kept"))


def status() -> Column:
    """trash, agree or disagree."""
    same = F.lower(F.trim("rule_pred")) == F.lower(F.trim("cnn_pred"))
    return F.when(F.coalesce(F.col("filter_reason").contains("cnn3"), F.lit(False)), "trash").when(same, "agree").otherwise("disagree")


def listing(df: DataFrame) -> DataFrame:
    """One line of text per row."""
    part = lambda name, c: F.concat(F.lit(f"{name}="), F.coalesce(F.col(c), F.lit("")))
    line = F.concat_ws(" | ", F.col("row_id").cast("string"), part("RULE", "rule_pred"), part("CNN", "cnn_pred"), part("CNN3", "cnn3_pred"), part("FINAL", "final_label"), F.substring(F.coalesce("caption", F.lit("")), 1, 60))
    return df.select("row_id", line.alias("line"))


def neighbours(df: DataFrame, order: str = "row_id", reach: int = 2, parts: int | None = None) -> DataFrame:
    """Each row with the ids up to ``reach`` places before and after it, however far away they are.

    Rows are dealt by rank to ``parts`` ranges (as many as shuffles have partitions), so that no task sorts all
    rows. The driver sees the ids at the edges of the ranges, and each range also gets those next to it. Ids must be
    unique numbers.
    """
    spark = df.sparkSession
    parts = parts or int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = df.select(order)
    bounds = rows.agg(F.percentile_approx(order, [k / parts for k in range(1, parts)] or [0.5], 100 * parts)).first()[0]
    at = F.filter(F.array(*map(F.lit, sorted(set(bounds or [])))), lambda x: x < F.col(order)) if bounds else F.array()
    spread = rows.withColumns({"part": F.size(at), "home": F.lit(True)})
    w = Window.partitionBy("part").orderBy(order)
    ranked = spread.withColumns({"k": F.row_number().over(w), "n": F.count(F.lit(1)).over(Window.partitionBy("part"))})
    edge: dict[int, list] = {}
    for r in ranked.where((F.col("k") <= reach) | (F.col("k") > F.col("n") - reach)).select("part", order).collect():  # 2 * reach rows a range
        if r[order] is not None:
            edge.setdefault(r["part"], []).append(r[order])
    ids = [sorted(edge[p]) for p in sorted(edge)]
    beside = []
    for j, p in enumerate(sorted(edge)):
        # So many ranges to either side hold reach rows, or all there are.
        before, after = sum(ids[max(0, j - reach) : j], []), sum(ids[j + 1 : j + 1 + reach], [])
        beside += [(x, p, False) for x in [*before[-reach:], *after[:reach]]]
    copies = spread.unionByName(spark.createDataFrame(beside, spread.schema))
    columns = {f"prev{k}": F.lag(order, k).over(w) for k in range(1, reach + 1)} | {f"next{k}": F.lead(order, k).over(w) for k in range(1, reach + 1)}
    return copies.withColumns(columns).where("home").drop("home", "part")


def details(df: DataFrame, key: str) -> DataFrame:
    """(key, name, value): every column of a row as text; nested ones as JSON."""
    nested = {f.name for f in df.schema.fields if f.dataType.typeName() in ("array", "map", "struct")}
    cells = [F.struct(F.lit(c).alias("name"), (F.to_json(F.col(f"`{c}`")) if c in nested else F.col(f"`{c}`").cast("string")).alias("value")) for c in df.columns]
    return df.select(F.col(key).alias("key"), F.explode(F.array(*cells)).alias("x")).select("key", "x.name", "x.value")


def with_required_columns(df: DataFrame) -> DataFrame:
    """Adds the columns of the legacy schema that are missing, as nulls, and marks rows without a caption."""
    have = set(df.columns)
    extra = ["pred_label", "decision_source", "decision_reason"]
    df = df.withColumns({c: F.lit(None).cast("string") for c in [*LEGACY_COLUMNS, *extra] if c not in have})
    blank = F.trim(F.coalesce("caption", F.lit(""))) == ""
    return df.withColumns({"pred_label": F.when(blank, "unknown").otherwise(F.col("pred_label")), "decision_source": F.when(blank, "empty_text").otherwise(F.col("decision_source")), "decision_reason": F.when(blank, "empty_text").otherwise(F.col("decision_reason"))})


def union_tagged(final: DataFrame, disagreements: DataFrame) -> DataFrame:
    return final.withColumn("viewer_source", F.lit("final")).unionByName(disagreements.withColumn("viewer_source", F.lit("disagreement")), allowMissingColumns=True)


def dataset(mode: str, tables: dict[str, DataFrame]) -> DataFrame:
    """The table of a view: final, disagreements, early_rules, or all (final and disagreements)."""
    if mode == "all":
        return union_tagged(tables["final"], tables["disagreements"])
    if mode not in ("final", "disagreements", "early_rules"):
        raise ValueError(f"no such view: {mode}")
    return tables[mode]


def only_uncertain(df: DataFrame) -> DataFrame:
    return df.where("uncertain") if "uncertain" in df.columns else df


def as_csv_view(df: DataFrame) -> DataFrame:
    """The table with nested columns as JSON, ready for a CSV writer."""
    return df.select([F.to_json(F.col(f"`{f.name}`")).alias(f.name) if f.dataType.typeName() in ("array", "map", "struct") else F.col(f"`{f.name}`") for f in df.schema.fields])


def schema_peek(df: DataFrame) -> DataFrame:
    """(name, type) of each column."""
    return df.sparkSession.createDataFrame([(f.name, f.dataType.simpleString()) for f in df.schema.fields], "name string, type string")


def first_sample(df: DataFrame, json: str | None = None, preview: int = 800) -> DataFrame:
    """(name, type, preview, json_keys) of each column, from one row: the start of the value as text, and of the column
    ``json`` the keys of its object, sorted. A table without rows has no previews."""
    text = lambda c: F.decode(F.col(f"`{c}`"), "utf-8") if dict(df.dtypes)[c] == "binary" else F.col(f"`{c}`").cast("string") if dict(df.dtypes)[c][:5] not in ("array", "struc", "map<s") else F.to_json(F.col(f"`{c}`"))
    keys = lambda c: F.array_sort(F.json_object_keys(text(c))) if c == json else F.lit(None).cast("array<string>")
    cells = [F.struct(F.lit(c).alias("name"), F.lit(t).alias("type"), F.substring(text(c), 1, preview).alias("preview"), keys(c).alias("json_keys")) for c, t in df.dtypes]
    shown = df.limit(1).select(F.explode(F.array(*cells)).alias("x")).select("x.*")
    names = schema_peek(df).select(F.col("name").alias("n"), F.col("type").alias("t"))
    return names.join(shown, F.col("n") == F.col("name"), "left").select(F.col("n").alias("name"), F.col("t").alias("type"), "preview", "json_keys")

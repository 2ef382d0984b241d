"""Result tables as CSV."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..operators.report import as_csv_view, with_required_columns

_FORM = {"header": "true", "quote": '"', "escape": '"'}


def write_results(df: DataFrame, path: str, mode: str = "overwrite", files: int | None = None) -> None:
    """The table as CSV files with a header, below ``path``; nested columns as JSON, line breaks quoted, binary columns
    left out. ``files``: so many files at most, for small results."""
    plain = df.drop(*[c for c, t in df.dtypes if t == "binary"])
    view = as_csv_view(plain)
    (view.coalesce(files) if files else view).write.mode(mode).options(**_FORM).option("emptyValue", "").option("nullValue", None).csv(path)


def read_results(spark: SparkSession, path: str) -> DataFrame:
    """Result files of any generation as text columns: names without blanks around them, and the legacy columns that are
    missing added. Rows without a caption are marked."""
    raw = spark.read.options(**_FORM).option("multiLine", "true").csv(path)
    named = raw.toDF(*[c.strip() for c in raw.columns])
    return with_required_columns(named) if "caption" in named.columns else named

"""Columns that are computed once per row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def once(df: DataFrame, name: str, value: Column) -> DataFrame:
    """Adds a column behind a generator, which keeps Catalyst from copying its expression into each place that uses
    it and from pushing filters on it below."""
    return df.select("*", F.explode(F.array(value)).alias(name))

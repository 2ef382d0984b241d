"""JSON payloads of image-and-caption rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

FIELDS = ["PMC_ID", "image", "sub_caption", "full_caption", "intext_refs_summary", "intext_refs", "modality"]
_SCHEMA = ", ".join(f"{f} string" for f in FIELDS)


def payload(c: Column) -> Column:
    """struct of the seven fields; all null where the bytes hold no JSON object."""
    text = F.trim(c.cast("binary").cast("string"))
    return F.from_json(text, _SCHEMA)


def with_payload(df: DataFrame, column: str = "jsonl") -> DataFrame:
    """Adds the seven fields as columns. Anything that isn't a JSON object gives nulls and no error."""
    return df.withColumn("__p", payload(F.col(column))).select(*df.columns, *[F.col(f"__p.{f}").alias(f) for f in FIELDS])


def readable(c: Column) -> Column:
    """Whether the bytes hold a JSON object."""
    return F.coalesce(F.try_parse_json(c.cast("binary").cast("string")).isNotNull(), F.lit(False)) & F.trim(c.cast("binary").cast("string")).startswith("{")

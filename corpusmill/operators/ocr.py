"""OCR as a stage with the user's reader."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

META = "array<struct<bbox: array<array<double>>, text: string, conf: double>>"


def with_ocr(df: DataFrame, image: str, read: Callable[[bytes], list[tuple]]) -> DataFrame:
    """Adds ocr_text and ocr_meta. ``read`` gives (box, text, confidence) for each place with text in an image; an
    image that is null or that it fails on has an empty text and no places."""

    @F.pandas_udf(f"ocr_text string, ocr_meta {META}")
    def run(images: pd.Series) -> pd.DataFrame:
        texts, metas = [], []
        for raw in images:
            try:
                found = read(bytes(raw)) if raw is not None else []
                meta = [{"bbox": [[float(v) for v in p] for p in box], "text": str(t), "conf": float(c)} for box, t, c in found]
            except Exception:  # noqa: BLE001  any reader may raise anything
                meta = []
            texts.append(" ".join(m["text"] for m in meta))
            metas.append(meta)
        return pd.DataFrame({"ocr_text": texts, "ocr_meta": metas})

    return df.withColumn("__o", run(F.col(image))).select("*", "__o.*").drop("__o")

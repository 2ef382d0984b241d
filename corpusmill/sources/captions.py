"""A deterministic view of captions over ``documents``: templates that hit the rulebook, then the whole text."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TEMPLATES = [
    "Axial CT scan of the chest", "PET/CT of the liver", "Fused PET/CT image", "FDG-PET-CT image of the neck", "Brain MRI with FLAIR signal",
    "Knee MRI after trauma", "Ultrasound and biopsy of the node", "Chest X-ray, frontal view", "Portable x-ray film", "Coronary angiography before stent placement",
    "MR angiography of the head", "CT scan compared with ultrasound", "", "A plain sentence about nothing", "Schematic workflow of the study",
    "Intraoperative photograph of the wound", "Colonoscopy of the sigmoid", "Röntgen image of the hand", "Contrast-enhanced CT and knee MRI", "Mouse brain MRI",
    "Imaging. (A) Axial CT scan of chest shows nodule. (B) Coronal CT image of the abdomen now.", "Findings as shown in (A) are typical. Panels differ.", "Panel B, Figure 2C: rabbit_liver MRI",
]
MODALITIES = ["R", "N", "M", "V"]
SMALL = 64 << 20


def spread_small(df: DataFrame) -> DataFrame:
    """A small table dealt to all cores, since one small file is one partition; a large one as it is, and any where
    the planner's size can't be asked for."""
    if not hasattr(df, "_jdf"):
        return df
    size = int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    return df.repartition(df.sparkSession.sparkContext.defaultParallelism) if size < SMALL else df


def captions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, row_id, pmc_id, text (a template and the whole text; null: empty), modality_gt (null for every
    eleventh), source."""
    d = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "source")
    template = F.element_at(F.array(*map(F.lit, TEMPLATES)), (F.col("doc_id") % len(TEMPLATES)).cast("int") + 1)
    modality = F.when(F.col("doc_id") % 11 != 0, F.element_at(F.array(*map(F.lit, MODALITIES)), (F.col("doc_id") % 4).cast("int") + 1))
    text = F.concat(template, F.lit(" "), F.coalesce("text", F.lit("")))
    return spread_small(d).select("doc_id", F.col("doc_id").alias("row_id"), F.concat(F.lit("PMC"), F.col("doc_id") % 500).alias("pmc_id"), text.alias("text"), modality.alias("modality_gt"), "source")


def _values(rows) -> str:
    quote = lambda x: str(x) if isinstance(x, int | float) else "'" + str(x).replace("'", "''") + "'"
    return ", ".join("(" + ", ".join(map(quote, r)) + ")" for r in rows)


#: The same view in SQL.
CAPTIONS_SQL = f"""captions AS (
  SELECT doc_id, doc_id AS row_id, 'PMC' || CAST(doc_id % 500 AS VARCHAR) AS pmc_id, t.caption || ' ' || coalesce(d.text, '') AS text,
    CASE WHEN doc_id % 11 <> 0 THEN m.modality END AS modality_gt, source
  FROM documents d JOIN (VALUES {_values(enumerate(TEMPLATES))}) t(k, caption) ON d.doc_id % {len(TEMPLATES)} = t.k
  JOIN (VALUES {_values(enumerate(MODALITIES))}) m(k, modality) ON d.doc_id % 4 = m.k
)"""
#: Normalized text in SQL; t is the caption.
NORMAL_SQL = r"trim(regexp_replace(coalesce(text, ''), '[\s\p{Z}]+', ' ', 'g'))"
RULES_SQL = rf"trim(regexp_replace(regexp_replace(lower({NORMAL_SQL}), '[_/\\-]+', ' ', 'g'), '[\s\p{{Z}}]+', ' ', 'g'))"

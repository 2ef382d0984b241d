"""The corpus pipeline: documents in, token ids out.

Five stages, each over all that the one before it kept. Every stage but the last returns the columns of
``documents``; between stages the rows are written as Parquet and read again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusmill.llm import bpe
from corpusmill.llm.common import staged
from corpusmill.llm.line_dedup import drop_spread_lines
from corpusmill.llm.mixing import mixed_documents
from corpusmill.llm.near_dedup import near_dedup
from corpusmill.llm.quality import quality_filter

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and the learned thresholds, row by row.

    Null or empty text fails; null languages and sources are groups of their own; an empty table stays empty.
    """
    return quality_filter(docs).select(COLUMNS)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The same documents without boilerplate lines; n_chars is that of the text left where a line went.

    Null text stays null, a text may become empty, no row goes; repeated rows are treated alike.
    """
    out = drop_spread_lines(docs)
    return out.withColumn("n_chars", F.when(F.col("__removed") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars"))).select(COLUMNS)


def minhash_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates: five-word shingles, a similarity of 0.8 or more.

    The smallest doc_id of a group stays; documents without words or without doc_id stay too.
    """
    return near_dedup(docs).select(COLUMNS)


def source_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents as the mix takes them: left out, once or twice. Documents without words stay once."""
    return mixed_documents(docs).select(COLUMNS)


def bpe_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, ids, n_tokens, ids_sha256 and the hash of the text that the ids decode to, row by row; null text has
    no ids."""
    return bpe.encoded_digest(docs, keep_ids=True)


STAGES = [
    ("quality_rules", quality_rules),
    ("line_dedup", line_dedup),
    ("minhash_near_dedup", minhash_near_dedup),
    ("source_mixing", source_mixing),
    ("bpe_tokens", bpe_tokens),
]
#: The thresholds of sketches, the cube method and BPE have no SQL form; tests compare with plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = staged(docs, name)
    return docs

"""The digest queries over the operators of this folder, and their SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, fingerprints, lm
from .chat import CLOSE, CONTROL, OPEN, conversation_digest, format_conversations
from .html_extract import main_text
from .line_dedup import COPY_SHARE, MIN_SITES, drop_spread_lines
from .mixing import mix
from .near_dedup import near_duplicates
from .pii import find_personal_data
from .quality import quality_verdicts


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = quality_verdicts(_read(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(_read(spark, sf_dir, "documents"))


def op3_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_personal_data(_read(spark, sf_dir, "documents"))


def op4_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.score(_read(spark, sf_dir, "documents"))


def op5_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return main_text(_read(spark, sf_dir, "pages")).withColumn("n_chars", F.length("text").cast("long"))


def op6_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encoded_digest(_read(spark, sf_dir, "documents"))


def op8_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = _read(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    said = "</s>[INST] ok [/INST]"
    extra = spark.createDataFrame([(-7, 0, "user", said), (-7, 1, "assistant", said)], "conv_id long, turn long, role string, text string")
    return conversation_digest(format_conversations(turns.unionByName(extra)))


def op7_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(_read(spark, sf_dir, "documents"), size=3, percent=85)


def op9_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.compared(_read(spark, sf_dir, "documents"))


def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = drop_spread_lines(_read(spark, sf_dir, "documents"))
    text = F.coalesce("text", F.lit(""))
    return out.select("doc_id", F.col("__lines").alias("n_lines"), F.col("__removed").alias("n_removed"), F.length(text).cast("long").alias("n_left_chars"), F.sha2(text, 256).alias("left_sha256"))


OP10_SQL = f"""
WITH l AS (
  SELECT doc_id, source, unnest(string_split(text, chr(10))) AS raw, generate_subscripts(string_split(text, chr(10)), 1) AS pos FROM documents
), t AS (
  SELECT doc_id, source, pos, raw, trim(raw, chr(32) || chr(9) || chr(11) || chr(12) || chr(13)) AS line FROM l
), wide AS (
  SELECT line FROM t WHERE line <> '' GROUP BY line
  HAVING count(DISTINCT source) + max(CASE WHEN source IS NULL THEN 1 ELSE 0 END) >= {MIN_SITES}
), unlike AS (
  SELECT doc_id FROM t LEFT JOIN wide ON t.line = wide.line GROUP BY doc_id
  HAVING coalesce(sum(length(t.line)) FILTER (WHERE wide.line IS NOT NULL), 0) < {COPY_SHARE} * sum(length(t.line))
), spread AS (
  SELECT line FROM t JOIN wide USING (line) WHERE doc_id IN (SELECT doc_id FROM unlike) GROUP BY line
  HAVING count(DISTINCT source) + max(CASE WHEN source IS NULL THEN 1 ELSE 0 END) >= {MIN_SITES}
), m AS (
  SELECT t.*, spread.line IS NOT NULL AS hit FROM t LEFT JOIN spread ON t.line = spread.line
), d AS (
  SELECT doc_id, count(*) FILTER (WHERE line <> '') AS n_lines, count(*) FILTER (WHERE hit) AS n_removed,
    coalesce(string_agg(raw, chr(10) ORDER BY pos) FILTER (WHERE NOT hit), '') AS text FROM m GROUP BY doc_id
)
SELECT doc_id, coalesce(n_lines, 0) AS n_lines, coalesce(n_removed, 0) AS n_removed,
  CAST(length(coalesce(d.text, '')) AS BIGINT) AS n_left_chars, sha256(coalesce(d.text, '')) AS left_sha256
FROM documents LEFT JOIN d USING (doc_id)
"""

_TAILS = "|".join(c[1:].replace("|", "\\|").replace("[", "\\[").replace("]", "\\]") for c in CONTROL)
OP8_SQL = f"""
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT * FROM (VALUES (-7, 0, 'user', '</s>[INST] ok [/INST]'), (-7, 1, 'assistant', '</s>[INST] ok [/INST]'))
)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
  CAST(sum({len(OPEN) + len(CLOSE) + 2} + length(role) + length(text) + len(regexp_extract_all(text, '[<\\[]\\\\*({_TAILS})'))) AS BIGINT) AS formatted_chars
FROM c GROUP BY conv_id
"""

# What the contract fixes of operators whose whole results SQL can't express: the same rows, less columns.


def base_quality_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op1_quality_rules(spark, sf_dir).drop("kept")


def base_mixing_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op2_mixing(spark, sf_dir).select("doc_id", "size", "source_size", F.round("target", 4).alias("target"))


def base_pii_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op3_pii(spark, sf_dir).select("doc_id", "n_email", "n_ip", "n_card", "n_phone")


def base_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op4_lm_score(spark, sf_dir).select("doc_id", "held_out", "n_tokens", "n_known", "train_tokens", F.round("base_score", 4).alias("base_score"))


def base_edited_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op9_fingerprints(spark, sf_dir).select("doc_id", "n_chars", "edited_sha256")


_WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"
BASE_QUALITY_SQL = rf"""
WITH w AS (SELECT doc_id, coalesce(text, '') AS t, {_WORDS} AS ws FROM documents),
u AS (SELECT doc_id, unnest(ws) AS word, generate_subscripts(ws, 1) AS k FROM w),
g AS (SELECT doc_id, k, word, lead(word, 1) OVER p AS w2, lead(word, 2) OVER p AS w3 FROM u WINDOW p AS (PARTITION BY doc_id ORDER BY k)),
often AS (SELECT doc_id, k FROM (SELECT doc_id, k, count(*) OVER (PARTITION BY doc_id, word, w2, w3) AS c FROM g WHERE w3 IS NOT NULL) WHERE c > 1),
covered AS (SELECT doc_id, count(DISTINCT k + j) AS n FROM often, (SELECT unnest(range(3)) AS j) GROUP BY doc_id),
l AS (SELECT doc_id, unnest(string_split(t, chr(10))) AS line FROM w),
d AS (SELECT doc_id, count(*) - count(DISTINCT line) AS n FROM l WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY doc_id),
r AS (SELECT w.doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(coalesce(list_sum(list_transform(ws, lambda x: length(x))), 0) AS BIGINT) AS word_chars,
  CAST(length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols, coalesce(d.n, 0) AS n_dup_lines, coalesce(covered.n, 0) AS n_repeat_words
  FROM w LEFT JOIN d USING (doc_id) LEFT JOIN covered USING (doc_id))
SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM r
"""
BASE_MIXING_SQL = rf"""
WITH z AS (SELECT doc_id, source, CAST(len({_WORDS}) AS BIGINT) AS size FROM documents),
s AS (SELECT source, sum(size) AS source_size, CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 3 WHEN 1 THEN 1 ELSE 2 END AS w FROM z GROUP BY source),
o AS (SELECT *, 1.5e0 * sum(source_size) OVER () - coalesce(2e0 * sum(source_size) OVER (ORDER BY source_size / w, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS rest,
  sum(w) OVER (ORDER BY source_size / w, source ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS open FROM s),
level AS (SELECT min_by(rest / open, source_size / w) AS level FROM o WHERE rest * w <= 2e0 * source_size * open)
SELECT doc_id, size, CAST(source_size AS BIGINT) AS source_size, round(least(2e0 * source_size, level * w), 4) AS target FROM z JOIN s ON z.source IS NOT DISTINCT FROM s.source, level
"""
_BYTE = "(0*([0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5]))"
BASE_PII_SQL = rf"""
WITH m AS (SELECT doc_id, regexp_extract_all(t, '[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+') AS e, regexp_extract_all(t, '[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)') AS i,
  list_transform(regexp_extract_all(t, '[0-9]([\x20-]?[0-9])+'), lambda x: list_reverse(list_transform(string_split(regexp_replace(x, '[^0-9]', '', 'g'), ''), lambda d: CAST(d AS INTEGER)))) AS c,
  list_transform(regexp_extract_all(t, '\+[0-9][\x20().0-9-]+[0-9]'), lambda x: length(regexp_replace(x, '[^0-9]', '', 'g'))) AS p FROM (SELECT doc_id, coalesce(text, '') AS t FROM documents))
SELECT doc_id, CAST(len(e) AS BIGINT) AS n_email, CAST(len(list_filter(i, lambda x: regexp_full_match(x, '({_BYTE}\.){{3}}{_BYTE}'))) AS BIGINT) AS n_ip,
  CAST(len(list_filter(c, lambda x: len(x) BETWEEN 13 AND 19 AND list_sum(list_transform(x, lambda d, k: CASE WHEN k % 2 = 1 THEN d WHEN d > 4 THEN 2 * d - 9 ELSE 2 * d END)) % 10 = 0)) AS BIGINT) AS n_card,
  CAST(len(list_filter(p, lambda x: x BETWEEN 9 AND 15)) AS BIGINT) AS n_phone FROM m
"""
#: CRC-32 by its definition: a shift and the polynomial a bit.
_CRC = "xor(list_reduce(list_prepend(4294967295, list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda x: CAST(ascii(x) AS BIGINT))), lambda c, b: list_reduce(list_prepend(xor(c, b), [CAST(0 AS BIGINT) for _ in range(8)]), lambda d, e: xor(d // 2, (d % 2) * 3988292384))), 4294967295)"
BASE_LM_SQL = rf"""
WITH w AS (SELECT doc_id, {_CRC} % 10 = 0 AS held_out, list_append({_WORDS.replace("coalesce(text, '')", "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")}, '') AS ws FROM documents),
t AS (SELECT doc_id, held_out, unnest(ws) AS token FROM w), c AS (SELECT token, count(*) AS c FROM t WHERE NOT held_out GROUP BY token), n AS (SELECT CAST(sum(c) AS BIGINT) AS n, count(*) AS v FROM c)
SELECT doc_id, any_value(held_out) AS held_out, count(*) AS n_tokens, count(c.c) AS n_known, any_value(n.n) AS train_tokens, round(sum(log10((coalesce(c.c, 0) + 0.1e0) / (n.n + 0.1e0 * (n.v + 1)))), 4) AS base_score
FROM t LEFT JOIN c USING (token), n GROUP BY doc_id
"""
BASE_EDITED_SQL = """
WITH o AS (SELECT doc_id, coalesce(text, '') AS t, lead(coalesce(text, '')) OVER (ORDER BY doc_id DESC) AS after, first_value(coalesce(text, '')) OVER (ORDER BY doc_id DESC) AS first FROM documents),
p AS (SELECT doc_id, t, coalesce(after, first) AS after, CAST(length(t) AS BIGINT) AS n_chars FROM o)
SELECT doc_id, n_chars, sha256(substr(t, 1, n_chars - n_chars // 3) || substr(after, 1, n_chars // 3)) AS edited_sha256 FROM p
"""

QUERIES = {
    "op1_quality_rules": op1_quality_rules,
    "op2_mixing": op2_mixing,
    "op3_pii": op3_pii,
    "op4_lm_score": op4_lm_score,
    "op5_html_extract": op5_html_extract,
    "op6_bpe": op6_bpe,
    "op7_near_dedup": op7_near_dedup,
    "op8_chat_format": op8_chat_format,
    "op9_fingerprints": op9_fingerprints,
    "op10_line_dedup": op10_line_dedup,
    "base_quality_counts": base_quality_counts,
    "base_mixing_targets": base_mixing_targets,
    "base_pii_counts": base_pii_counts,
    "base_lm_score": base_lm_score,
    "base_edited_texts": base_edited_texts,
}
ORACLES = {
    "op8_chat_format": OP8_SQL,
    "op10_line_dedup": OP10_SQL,
    "base_quality_counts": BASE_QUALITY_SQL,
    "base_mixing_targets": BASE_MIXING_SQL,
    "base_pii_counts": BASE_PII_SQL,
    "base_lm_score": BASE_LM_SQL,
    "base_edited_texts": BASE_EDITED_SQL,
}

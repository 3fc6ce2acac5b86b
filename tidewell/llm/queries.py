"""The registered queries of the corpus operators: each runs its operator over its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents
from .jpeg import media_columns
from .language_id import identify
from .mixing import mix
from .lm_score import lm_scores
from .near_dup import near_duplicates
from .neighbours import nearest_neighbours
from .packing import pack
from .pii import find_personal_data
from .secret_scan import find_secrets
from .token_counts import token_counts

Query = Callable[[SparkSession, str], DataFrame]


def op1_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest_neighbours(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def op2_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_secrets(documents(spark, sf_dir))


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(documents(spark, sf_dir))


def op4_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_personal_data(documents(spark, sf_dir))


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(documents(spark, sf_dir))


def op6_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media_columns(documents(spark, sf_dir))


def op7_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_scores(documents(spark, sf_dir))


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(documents(spark, sf_dir))


def op9_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(documents(spark, sf_dir))


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify(documents(spark, sf_dir))


OPERATORS = (op1_neighbours, op2_secret_scan, op3_mixing, op4_pii, op5_token_counts, op6_media, op7_lm_score, op8_packing, op9_near_duplicates, op10_language_id)


# --- the columns of operators without SQL that SQL can tell


def secret_base_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op2_secret_scan(spark, sf_dir).select("doc_id", "n_assign", "n_access", "n_hex")


def mixing_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op3_mixing(spark, sf_dir).select("doc_id", "size", "source_size", F.round("target", 3).alias("target"))


def pii_base_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op4_pii(spark, sf_dir).select("doc_id", "n_email", "n_ip", "n_card", "n_phone")


def token_bytes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op5_token_counts(spark, sf_dir).select("doc_id", "n_bytes")


def queries() -> dict[str, Query]:
    return {f.__name__: f for f in (*OPERATORS, secret_base_counts, mixing_targets, pii_base_counts, token_bytes)}


#: Shingle sets, all pairs that share one, their exact similarity, and the closure of the links.
NEAR_DUPLICATES_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents
), s AS (
  SELECT doc_id, CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 5 THEN [array_to_string(ws, ' ')]
    ELSE list_distinct(list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i + 4], ' '))) END AS sh FROM w
), u AS (SELECT doc_id, len(sh) AS n, unnest(sh) AS h FROM s),
p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c, any_value(a.n) AS na, any_value(b.n) AS nb FROM u a JOIN u b ON a.h = b.h AND a.doc_id <> b.doc_id GROUP BY 1, 2),
e AS (SELECT x, y FROM p WHERE 100 * c >= 85 * (na + nb - c)),
r(doc_id, m) AS (SELECT doc_id, doc_id FROM s UNION SELECT e.y, r.m FROM r JOIN e ON e.x = r.doc_id)
SELECT s.doc_id, CAST(len(s.sh) AS BIGINT) AS n_shingles, t.component_id, s.doc_id = t.component_id AS kept
FROM s JOIN (SELECT doc_id, min(m) AS component_id FROM r GROUP BY 1) t ON t.doc_id = s.doc_id
"""


#: Letters in either case are spelled out: an insensitive match would fold signs beyond ASCII too.
SECRET_BASE_SQL = r"""
WITH t AS (SELECT doc_id, coalesce(text, '') AS x FROM documents)
SELECT doc_id,
  CAST(len(list_filter(regexp_extract_all(x, '(?:[Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)', 1), lambda m: len(m) >= 8)) AS BIGINT) AS n_assign,
  CAST(len(list_filter(regexp_extract_all(x, 'AKIA[A-Z0-9]+'), lambda m: len(m) >= 16)) AS BIGINT) AS n_access,
  CAST(len(list_filter(regexp_extract_all(x, '[0-9a-f]+'), lambda m: len(m) >= 32)) AS BIGINT) AS n_hex
FROM t
"""

#: Sources in the order in which they fill up: the level at which the rest of the words fits the rest of the weights.
MIXING_TARGETS_SQL = r"""
WITH d AS (SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size, [3.0, 1.0, 2.0][(row_number() OVER (ORDER BY source IS NULL, encode(source)) - 1) % 3 + 1]::DOUBLE AS w FROM d GROUP BY source),
f AS (SELECT *, 2.0 * source_size AS cap, 1.5 * sum(source_size) OVER () AS whole,
  coalesce(sum(2.0 * source_size) OVER (ORDER BY 2.0 * source_size / w, encode(source) ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS full_before,
  sum(w) OVER (ORDER BY 2.0 * source_size / w, encode(source) ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS w_left FROM s),
l AS (SELECT arg_min((whole - full_before) / w_left, cap / w) AS level FROM f WHERE (whole - full_before) / w_left <= cap / w)
SELECT doc_id, size, source_size, round(least(cap, w * level), 3) AS target FROM d JOIN f ON d.source IS NOT DISTINCT FROM f.source, l
"""

PII_BASE_SQL = r"""
WITH t AS (SELECT doc_id, coalesce(text, '') AS x FROM documents),
m AS (SELECT doc_id, regexp_extract_all(x, '[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+') AS e,
  list_transform(regexp_extract_all(x, '[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)'), lambda v: list_transform(string_split(v, '.'), lambda p: ltrim(p, '0'))) AS i,
  list_filter(list_transform(regexp_extract_all(x, '[0-9]([\x20-]?[0-9])+'), lambda v: regexp_replace(v, '[^0-9]', '', 'g')), lambda v: len(v) BETWEEN 14 AND 19) AS c,
  list_transform(regexp_extract_all(x, '\+[0-9][\x20().0-9-]+[0-9]'), lambda v: regexp_replace(v, '[^0-9]', '', 'g')) AS p FROM t)
SELECT doc_id, CAST(len(e) AS BIGINT) AS n_email,
  CAST(len(list_filter(i, lambda v: len(list_filter(v, lambda p: len(p) > 3 OR coalesce(TRY_CAST(p AS INT), 0) > 255)) = 0)) AS BIGINT) AS n_ip,
  CAST(len(list_filter(c, lambda v: list_sum(list_transform(range(1, len(v) + 1), lambda k: CASE WHEN (len(v) - k) % 2 = 0 THEN CAST(v[k] AS INT) ELSE CAST(v[k] AS INT) * 2 - CASE WHEN CAST(v[k] AS INT) > 4 THEN 9 ELSE 0 END END)) % 10 = 0)) AS BIGINT) AS n_card,
  CAST(len(list_filter(p, lambda v: len(v) BETWEEN 10 AND 15)) AS BIGINT) AS n_phone
FROM m
"""

TOKEN_BYTES_SQL = "SELECT doc_id, CAST(strlen(coalesce(text, '')) AS BIGINT) AS n_bytes FROM documents"


def oracle_sql() -> dict[str, str]:
    """Near-duplicates, and the columns of others that SQL can tell; the rest is tested against plain versions."""
    return {"op9_near_duplicates": NEAR_DUPLICATES_SQL, "secret_base_counts": SECRET_BASE_SQL, "mixing_targets": MIXING_TARGETS_SQL, "pii_base_counts": PII_BASE_SQL, "token_bytes": TOKEN_BYTES_SQL}

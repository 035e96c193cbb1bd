"""op6_mixing: every document's share of the mix."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from .mixing import plan_mix


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "source")
    return plan_mix(docs)


ORACLE = r"""
WITH sized AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
         md5(coalesce(doc_id::VARCHAR, '')) AS tie
  FROM documents
), sources AS (
  SELECT source, sum(size)::BIGINT AS source_size,
         [5, 2, 1][((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::INT] AS weight
  FROM sized GROUP BY source
), ratios AS (
  SELECT *, source_size * 3 / weight::DOUBLE AS at_cap FROM sources
), levels AS (
  SELECT *, row_number() OVER (ORDER BY at_cap, source NULLS LAST) AS place,
    ((sum(source_size) OVER ()) - coalesce(sum(source_size * 3) OVER (ORDER BY at_cap, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::DOUBLE
    / (sum(weight) OVER (ORDER BY at_cap, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))::DOUBLE AS level
  FROM ratios
), first AS (
  SELECT min(place) AS first_place, arg_min(level, place) AS first_level FROM levels WHERE level <= at_cap
), targets AS (
  SELECT source, source_size,
    CASE WHEN place < first_place THEN (source_size * 3)::DOUBLE ELSE first_level * weight END AS target,
    ('0x' || substr(md5('0/' || coalesce(source, '')), 1, 8))::BIGINT::DOUBLE / 4294967296.0::DOUBLE AS u
  FROM levels, first
), ranked AS (
  SELECT s.doc_id, s.size, t.source_size, t.target, t.u,
    coalesce(t.target / nullif(t.source_size, 0)::DOUBLE, 0) AS rate,
    (row_number() OVER (PARTITION BY s.source ORDER BY s.size, s.tie, s.doc_id))::DOUBLE AS k
  FROM sized s JOIN targets t ON s.source IS NOT DISTINCT FROM t.source
), copied AS (
  SELECT *, least(floor(u + k * rate)::BIGINT - floor(u + (k - 1) * rate)::BIGINT, 3)::BIGINT AS copies FROM ranked
)
SELECT doc_id, size, source_size, target, copies, size * copies AS taken FROM copied
"""

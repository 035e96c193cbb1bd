"""op1_quality_rules: base counts and the verdict of the calibrated rules for every document."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .quality_rules import COST, DELTA, RISK, RULES, apply_rules


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "quality")
    out = apply_rules(docs, labels)
    counts = ("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    return out.select(*counts, "base_failed", "kept", F.array_join("rejected_by", ",").alias("rejected_by"))


def _oracle() -> str:
    ratio = {r: e.replace("100.0D", "100.0::DOUBLE").replace(" / ", " / nullif(") + ", 0)" for r, (e, _) in RULES.items()}
    steps = {r: "CASE " + " ".join(f"WHEN {ratio[r]} > {c}::DOUBLE THEN {i * len(RULES) + k}" for i, c in enumerate(RULES[r][1])) + " END" for k, r in enumerate(RULES)}
    first = f"least({', '.join(steps.values())})"
    hits = ", ".join(f"CASE WHEN {x} <= last THEN '{r}' END" for r, x in steps.items())
    p = RISK
    return rf"""
WITH parts AS (
  SELECT doc_id, lang AS stratum, coalesce(text, '') AS text,
    regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w,
    list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines
  FROM documents
), wins AS (
  SELECT *, list_transform(range(0, greatest(len(w) - 2, 0)), lambda i: w[i + 1] || ' ' || w[i + 2] || ' ' || w[i + 3]) AS g FROM parts
), grams AS (
  SELECT *, row_number() OVER () AS rid FROM wins
), twice AS (
  SELECT rid, i FROM (SELECT rid, unnest(g) AS x, unnest(range(0, len(g))) AS i FROM grams) QUALIFY count(*) OVER (PARTITION BY rid, x) > 1
), covered AS (
  SELECT rid, count(DISTINCT i + k)::BIGINT AS c FROM twice, (SELECT unnest([0, 1, 2]) AS k) GROUP BY rid
), stats AS (
  SELECT doc_id, stratum, len(w)::BIGINT AS n_words, length(array_to_string(w, ''))::BIGINT AS word_chars,
    (length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
    (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines,
    coalesce(c, 0)::BIGINT AS n_repeat_words, len(lines) AS n_lines,
    length(text) - length(replace(text, '!', '')) AS n_bangs, len(list_distinct(w)) AS n_distinct
  FROM grams LEFT JOIN covered USING (rid)
), based AS (
  SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM stats
), firsts AS (
  SELECT *, {first} AS first FROM based
), known AS (
  SELECT doc_id, max(quality) AS quality FROM labels WHERE quality IS NOT NULL GROUP BY doc_id
), held AS (
  SELECT * FROM firsts JOIN known USING (doc_id) WHERE NOT base_failed
), cells AS (
  SELECT false AS pooled, stratum, first, quality FROM held UNION ALL SELECT true, NULL, first, quality FROM held
), sizes AS (
  SELECT pooled, stratum, count(*) FILTER (quality = 1) AS n FROM cells GROUP BY pooled, stratum
), levels AS (
  SELECT *, {DELTA}::DOUBLE / count(*) OVER () AS level FROM sizes
), configurations AS (
  SELECT unnest(range(0, {len(RULES) * len(next(iter(RULES.values()))[1])})) AS k
), counts AS (
  SELECT pooled, stratum, k, count(*) FILTER (quality = 1 AND first <= k) AS good, count(*) FILTER (quality = 0 AND first <= k) AS bad
  FROM cells, configurations GROUP BY pooled, stratum, k
), tested AS (
  SELECT c.*, l.n, l.level, bad - {COST} * good AS gain,
    CASE WHEN good >= n * {p!r}::DOUBLE THEN 1.0 ELSE list_sum(list_transform(range(0, good + 1), lambda j: exp(lgamma(n + 1) - lgamma(j + 1) - lgamma(n - j + 1) + j * ln({p!r}::DOUBLE) + (n - j) * ln(1 - {p!r}::DOUBLE)))) END AS tail
  FROM counts c JOIN levels l ON c.pooled = l.pooled AND c.stratum IS NOT DISTINCT FROM l.stratum
), best AS (
  SELECT pooled, stratum, arg_max(k, gain * 1000 - k) AS last FROM tested WHERE gain > 0 AND tail <= level GROUP BY pooled, stratum
), chosen AS (
  SELECT f.*, CASE WHEN pow(1 - {p!r}::DOUBLE, l.n) <= l.level THEN b.last ELSE (SELECT max(last) FROM best WHERE pooled) END AS last
  FROM firsts f
  LEFT JOIN levels l ON NOT l.pooled AND l.stratum IS NOT DISTINCT FROM f.stratum
  LEFT JOIN best b ON NOT b.pooled AND b.stratum IS NOT DISTINCT FROM f.stratum
), judged AS (
  SELECT *, list_filter([{hits}], lambda x: x IS NOT NULL) AS hits FROM chosen
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND len(hits) = 0 AS kept, coalesce(array_to_string(hits, ','), '') AS rejected_by
FROM judged
"""


ORACLE = _oracle()

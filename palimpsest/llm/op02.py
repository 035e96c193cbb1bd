"""op2_fingerprints: Merkle fingerprints of every document and its edited text."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from .fingerprint import with_following


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return with_following(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))

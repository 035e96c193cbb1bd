"""op5_quality: quality of every document."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bucket
from .quality_mil import quality

THRESHOLD = 0.7


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "quality")
    fold = bucket(F.col("doc_id"), 4)
    out = quality(docs, labels, fold != 2)
    held = F.coalesce(fold == 2, F.lit(False)).alias("held_out")
    return out.select("doc_id", held, "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))

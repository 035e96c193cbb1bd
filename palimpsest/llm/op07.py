"""op7_toxicity: toxicity of every document."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bucket
from .toxicity import toxicity

THRESHOLD = 0.7


def scored(spark: SparkSession, docs: DataFrame, sf_dir: str, keep: tuple[str, ...] = ()) -> DataFrame:
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "toxic")
    out = toxicity(docs.select("doc_id", "text", *keep), labels, bucket(F.col("doc_id"), 3) != 1, keep=keep)
    return out.withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = scored(spark, spark.read.parquet(f"{sf_dir}/documents.parquet"), sf_dir)
    held = F.coalesce(bucket(F.col("doc_id"), 3) == 1, F.lit(False)).alias("held_out")
    return out.select("doc_id", held, "score", "predicted", F.size("passages").alias("n_passages"))

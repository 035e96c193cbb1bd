"""op4_sentencepiece: every document encoded and decoded."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import stage
from .sentencepiece_lattice import decode, encode, load


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    pieces = load(spark)
    out = decode(encode(docs, pieces), pieces)
    numbers = F.array_join(F.transform("token_ids", lambda x: x.cast("string")), ",")
    out = out.select(
        "doc_id",
        F.size(F.coalesce("token_ids", F.array().cast("array<int>"))).cast("long").alias("n_tokens"),
        F.md5(numbers.cast("binary")).alias("ids_md5"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
        F.col("decoded").eqNullSafe(F.col("text")).alias("round_trip"),
    )
    return stage(out, "lattice-texts")  # in light Arrow batches

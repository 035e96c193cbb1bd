"""Evaluation sets in JSON, a resumable JSON sink, and configuration."""

from __future__ import annotations

import json
import os
import re
from dataclasses import fields

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schema import Config

CORPUS = "conversations array<struct<conversation_id:string,participants:array<string>,scope:string,messages:array<struct<author_key:string,role:string,content:string,id:string,created_at:string>>>>, queries array<struct<name:string,requester_key:string,query:string,expected_ids:array<string>,family:string,strategies:array<string>>>"


def corpus(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Messages and queries of an annotated corpus."""
    rows = spark.read.schema(CORPUS).json(path, multiLine=True)
    conv = rows.select(F.explode("conversations").alias("c")).select("c.*")
    messages = conv.select("conversation_id", "scope", "participants", F.posexplode("messages").alias("place", "m")).select("conversation_id", F.coalesce("scope", F.lit("participants")).alias("scope"), (F.col("place") + 1).alias("sequence_number"), "m.*")
    return messages, rows.select(F.explode("queries").alias("q")).select("q.*")


def sessions(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Messages and questions of dialogue samples whose sessions are keys session_1, session_2, ... of an object."""
    rows = spark.read.json(path, multiLine=True, schema="sample_id string, conversation map<string,string>, qa array<struct<question:string,answer:string,evidence:array<string>,category:int>>")
    each = rows.select("sample_id", F.explode("conversation").alias("session", "turns")).where(F.col("session").rlike(r"^session_\d+$"))
    turns = F.from_json("turns", "array<struct<speaker:string,dia_id:string,text:string>>")
    messages = each.select("sample_id", "session", F.posexplode(turns).alias("place", "t")).select("sample_id", "session", "place", "t.*")
    return messages, rows.select("sample_id", F.explode("qa").alias("q")).select("sample_id", "q.*")


def append_new(rows: DataFrame, path: str, key: str) -> int:
    """Appends the rows whose key the JSON lines at path do not have yet; returns how many."""
    spark = rows.sparkSession
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    if hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).exists(hadoop):
        rows = rows.join(spark.read.schema(rows.schema).json(path).select(key), key, "left_anti")
    rows = rows.persist()
    try:
        n = rows.count()
        if n:
            rows.write.mode("append").json(path)
        return n
    finally:
        rows.unpersist()


def config(path: str) -> Config:
    """A Config from a JSON file; ${NAME} stands for an environment variable, which must be set."""

    def value(m: re.Match) -> str:
        if m[1] not in os.environ:
            raise KeyError(f"environment variable {m[1]} is not set")
        return os.environ[m[1]]

    with open(path, encoding="utf-8") as f:
        given = json.loads(re.sub(r"\$\{(\w+)\}", value, f.read()))
    unknown = set(given) - {f.name for f in fields(Config)}
    if unknown:
        raise ValueError(f"unknown settings: {', '.join(sorted(unknown))}")
    made = Config(**{k: tuple(v) if isinstance(v, list) else v for k, v in given.items()})
    if not 1 <= made.max_hops <= 3 or made.final_top_k < 1 or made.chars_per_token < 1:
        raise ValueError("max_hops is 1 to 3, final_top_k and chars_per_token at least 1")
    return made

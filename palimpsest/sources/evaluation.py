"""Loaders of further evaluation sets in JSON: long memories, evidence items and step benchmarks, as messages and questions.

All give the same columns. Messages: workspace_id, conversation_id, sequence_number, author_key, role, content, created_at,
session, step. Questions: workspace_id, question_id, category, text, requester, sessions, evidence_texts, steps: whichever
kind of evidence the set has, others null. Blank messages are left out and do not count in the sequence.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

QUESTION = ("workspace_id", "question_id", "category", "text", "requester", "sessions", "evidence_texts", "steps")
NONE = {"sessions": "array<string>", "evidence_texts": "array<string>", "steps": "array<int>"}
LONG = "array<struct<question_id:string,question_type:string,question:string,answer_session_ids:array<string>,haystack_dates:array<string>,haystack_session_ids:array<string>,haystack_sessions:array<array<struct<role:string,content:string>>>>>"


def _who(assistant: Column) -> list[Column]:
    return [F.when(assistant, "agent:assistant").otherwise("user:user").alias("author_key"), F.when(assistant, "assistant").otherwise("user").alias("role")]


def _messages(rows: DataFrame, assistant: Column, content: Column, at: Column, session: Column, step: Column) -> DataFrame:
    """rows: workspace_id, conversation_id, place (order within the conversation)."""
    told = rows.withColumn("content", content).where("trim(content) <> ''")
    nth = F.row_number().over(Window.partitionBy("conversation_id").orderBy("place"))
    return told.select("workspace_id", "conversation_id", nth.alias("sequence_number"), *_who(assistant), "content", at.alias("created_at"), session.alias("session"), step.alias("step"))


def _questions(rows: DataFrame) -> DataFrame:
    missing = {c: F.lit(None).cast(k) for c, k in NONE.items() if c not in rows.columns}
    return rows.withColumn("requester", F.lit("user:user")).withColumns(missing).select(*QUESTION)


def _minutes(start: Column, n: Column) -> Column:
    return start + F.make_dt_interval(F.lit(0), F.lit(0), n.cast("int"), F.lit(0).cast("decimal(18,6)"))


def _whole(spark: SparkSession, path: str) -> DataFrame:
    """The JSON value of each file as text."""
    return spark.read.text(path, wholetext=True).select("value", F.element_at(F.split(F.input_file_name(), "/"), -1).alias("file"))


def long_memory(spark: SparkSession, path: str, per_type: int | None = None) -> tuple[DataFrame, DataFrame]:
    """A file of questions, each with its own haystack of dated sessions; per_type questions of a type at most."""
    each = _whole(spark, path).select(F.posexplode(F.from_json("value", LONG)).alias("place", "e")).select("place", "e.*")
    if per_type is not None:
        nth = F.row_number().over(Window.partitionBy("question_type").orderBy("place"))
        each = each.withColumn("nth", nth).where(F.col("nth") <= per_type).drop("nth")
    each = each.withColumn("workspace_id", F.format_string("q%03d", "place"))
    sessions = each.select("workspace_id", "haystack_dates", "haystack_session_ids", F.posexplode("haystack_sessions").alias("s", "turns"))
    date = F.to_timestamp_ntz(F.regexp_replace(F.get("haystack_dates", F.col("s")), r" \(\w+\) ", " "), F.lit("yyyy/MM/dd HH:mm"))
    rows = sessions.select("workspace_id", F.format_string("%s_s%03d", "workspace_id", "s").alias("conversation_id"), date.alias("date"), F.get("haystack_session_ids", F.col("s")).alias("session"), F.posexplode("turns").alias("place", "t"))
    messages = _messages(rows, F.col("t.role") == "assistant", F.col("t.content"), _minutes(F.col("date"), F.col("place")), F.col("session"), F.lit(None).cast("int"))
    asked = each.select("workspace_id", "question_id", F.col("question_type").alias("category"), F.col("question").alias("text"), F.col("answer_session_ids").alias("sessions"))
    return messages, _questions(asked)


ITEMS = "evidence_items array<struct<question:string,conversations:array<struct<messages:array<struct<speaker:string,text:string>>>>,message_evidences:array<struct<text:string>>>>"


def evidence_items(spark: SparkSession, folder: str, category: str, limit: int) -> tuple[DataFrame, DataFrame]:
    """The first items of a category: files of a folder in the order of their names, each with conversations and the texts that answer."""
    files = _whole(spark, f"{folder}/{category}").select("file", F.posexplode(F.from_json("value", ITEMS)["evidence_items"]).alias("place", "i"))
    nth = F.row_number().over(Window.orderBy("file", "place")) - 1  # items of one category
    name = category.removesuffix("_evidence")
    items = files.withColumn("nth", nth).where(F.col("nth") < limit).select(F.format_string(f"{name}_%03d", "nth").alias("workspace_id"), "i.*")
    talks = items.select("workspace_id", F.posexplode("conversations").alias("c", "talk"))
    day = F.lit("2025-01-01 09:00:00").cast("timestamp_ntz") + F.make_dt_interval(F.col("c"), F.lit(0), F.lit(0), F.lit(0).cast("decimal(18,6)"))
    rows = talks.select("workspace_id", F.format_string("%s_c%02d", "workspace_id", "c").alias("conversation_id"), day.alias("day"), F.posexplode("talk.messages").alias("place", "t"))
    messages = _messages(rows, F.lower("t.speaker") == "assistant", F.col("t.text"), _minutes(F.col("day"), F.col("place")), F.lit(None).cast("string"), F.lit(None).cast("int"))
    texts = F.array_distinct(F.filter(F.transform("message_evidences", lambda e: F.lower(F.trim(e["text"]))), lambda x: x != ""))
    asked = items.select("workspace_id", F.col("workspace_id").alias("question_id"), F.lit(category).alias("category"), F.col("question").alias("text"), texts.alias("evidence_texts"))
    return messages, _questions(asked)


TURN = "struct<sid:double,mid:double,user:string,user_message:string,assistant:string,assistant_message:string,time:string>"


def step_benchmark(spark: SparkSession, path: str, category: str, topics: tuple[str, ...] = ("movie", "roles", "events"), limit: int | None = None) -> tuple[DataFrame, DataFrame]:
    """A file of items by topic, each with a list of turns, or of sessions of turns, and a question about some steps.

    A turn gives a message of the user and one of the assistant; its step is its sid or mid, else its place. A turn is a minute
    and a half after the one before, or at its own time.
    """
    whole = _whole(spark, path)
    by_topic = whole.select(F.explode(F.from_json("value", "map<string,array<struct<message_list:string,QA:struct<question:string,target_step_id:string>>>>")).alias("topic", "items"))
    order = F.array_position(F.array(*map(F.lit, topics)), F.col("topic"))
    items = by_topic.where(F.col("topic").isin(*topics)).select(order.alias("order"), "topic", F.posexplode("items").alias("place", "i")).where("i.QA.question <> ''")
    if limit is not None:
        items = items.withColumn("nth", F.row_number().over(Window.orderBy("order", "place"))).where(F.col("nth") <= limit)  # items of one file
    items = items.withColumn("workspace_id", F.format_string(f"{category}_%s_%03d", "topic", "place"))
    nested = F.from_json("i.message_list", f"array<array<{TURN}>>")
    flat = F.array(F.from_json("i.message_list", f"array<{TURN}>"))
    lists = F.when(F.regexp_like("i.message_list", F.lit(r"^\s*\[\s*\[")), nested).otherwise(flat)
    turns = items.select("workspace_id", F.posexplode(lists).alias("s", "turns")).select("workspace_id", "s", F.posexplode("turns").alias("p", "t"))
    turns = turns.withColumn("global", F.row_number().over(Window.partitionBy("workspace_id").orderBy("s", "p")) - 1)
    start = _minutes(F.lit("2024-10-01 08:00:00").cast("timestamp_ntz"), F.lit(1)) + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), (F.col("global") * 90).cast("decimal(18,6)"))
    said = F.try_to_timestamp(F.regexp_extract("t.time", r"(\d{4}-\d{2}-\d{2} \d{2}:\d{2})", 1), F.lit("yyyy-MM-dd HH:mm")).cast("timestamp_ntz")
    turns = turns.withColumn("at", F.greatest(said, start)).withColumn("step", F.coalesce("t.sid", "t.mid", "global").cast("int"))
    parts = F.posexplode(F.array(F.coalesce("t.user", "t.user_message"), F.coalesce("t.assistant", "t.assistant_message"))).alias("part", "text")
    rows = turns.select("workspace_id", F.format_string("%s_s%02d", "workspace_id", "s").alias("conversation_id"), "global", "at", "step", parts).withColumn("place", F.col("global") * 2 + F.col("part"))
    later = F.col("at") + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), (F.col("part") * 30).cast("decimal(18,6)"))
    messages = _messages(rows, F.col("part") == 1, F.col("text"), later, F.lit(None).cast("string"), F.col("step"))
    steps = F.transform(F.from_json("i.QA.target_step_id", "array<array<double>>"), lambda s: F.get(s, F.lit(0)).cast("int"))
    asked = items.select("workspace_id", F.col("workspace_id").alias("question_id"), F.lit(category).alias("category"), F.col("i.QA.question").alias("text"), F.filter(F.coalesce(steps, F.array().cast("array<int>")), lambda x: x.isNotNull()).alias("steps"))
    return messages, _questions(asked)

"""What an extraction model said of windows of messages, as entities and relations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T

#: The schema that a model's reply must have.
REPLY = (
    "entities array<struct<temp_id:string,entity_type:string,display_name:string,canonical_key:string,aliases:array<string>,resolved:boolean>>, "
    "relations array<struct<source_temp_id:string,relation_type:string,target_temp_id:string,target_literal:string,"
    "observed_at:string,valid_from:string,valid_until:string,confidence:double,source_message_ids:array<string>>>"
)
KEY = ("conversation_id", "window")


def parsed(replies: DataFrame) -> DataFrame:
    """replies (conversation_id, window, reply) with said, the reply by its schema; `failed` where it cannot be read."""
    said = F.from_json(T.strip_fences(F.col("reply")), REPLY, {"mode": "PERMISSIVE"})
    rows = replies.withColumn("said", said)
    return rows.withColumn("failed", F.coalesce(F.col("said.entities").isNull() & F.col("said.relations").isNull(), F.lit(True)))


def entities(replies: DataFrame, known: DataFrame) -> DataFrame:
    """Entities of parsed replies (also workspace_id): conversation_id, window, temp_id, place, entity_id, canonical_key, entity_type, display_name, aliases, resolved.

    known: conversation_id, window, canonical_key of the candidates that the model was shown. A key of the model's own making
    counts only if it is among them; else a resolved entity gets the key of its name, another one a key of its conversation.
    """
    each = replies.select("workspace_id", *KEY, F.posexplode("said.entities").alias("place", "e")).select("workspace_id", *KEY, "place", "e.*")
    each = each.withColumn("display_name", F.trim("display_name")).where("display_name <> '' AND trim(entity_type) <> ''")
    shown = known.select(*KEY, "canonical_key").distinct().withColumn("shown", F.lit(True))
    each = each.join(shown, [*KEY, "canonical_key"], "left")
    resolved = F.coalesce("resolved", F.lit(False))
    own = F.when(resolved, T.canonical_key(F.col("entity_type"), F.col("display_name"))).otherwise(T.unresolved_key(F.col("entity_type"), F.col("display_name"), F.col("conversation_id")))
    rows = each.withColumn("canonical_key", F.when(F.col("shown"), F.col("canonical_key")).otherwise(own)).where(~F.col("canonical_key").endswith(":"))
    ident = T.entity_id(F.col("workspace_id"), F.col("canonical_key"))
    return rows.select("workspace_id", *KEY, "temp_id", "place", ident.alias("entity_id"), "canonical_key", F.lower(F.trim("entity_type")).alias("entity_type"), "display_name", T.clean_aliases(F.coalesce("aliases", F.array().cast("array<string>"))).alias("aliases"), resolved.alias("resolved"))


def window_messages(messages: DataFrame) -> DataFrame:
    """messages (conversation_id, window, message_id, sequence_number, content, created_at, in_context) as one list a window.

    A window has a batch of messages and a few before it, so the list is short.
    """
    m = F.struct("sequence_number", "message_id", "content", "created_at", "in_context")
    return messages.groupBy(*KEY).agg(F.sort_array(F.collect_list(m)).alias("messages"))


def relations(replies: DataFrame, found: DataFrame, windows: DataFrame) -> DataFrame:
    """Relations of parsed replies that may be stored; found: of `entities`, windows: of `window_messages`.

    Sources are messages that the model was shown; where it names none, those of the window that name the subject, else all
    of the window. A relation without a date was observed when its first source was written. It has exactly one target.
    """
    each = replies.select("workspace_id", *KEY, F.posexplode("said.relations").alias("nth", "r")).select("workspace_id", *KEY, "nth", "r.*")
    named = found.groupBy(*KEY, "temp_id").agg(F.max_by(F.struct("entity_id", "display_name"), "place").alias("e"))  # the last of equal ids
    source = named.select(*KEY, F.col("temp_id").alias("source_temp_id"), F.col("e.entity_id").alias("source_entity_id"), F.col("e.display_name").alias("subject"))
    target = named.select(*KEY, F.col("temp_id").alias("target_temp_id"), F.col("e.entity_id").alias("target_entity_id"))
    rows = each.join(source, [*KEY, "source_temp_id"]).join(target, [*KEY, "target_temp_id"], "left").join(windows, [*KEY])
    literal = F.nullif(F.trim("target_literal"), F.lit(""))
    ids = lambda keep: F.transform(F.filter("messages", keep), lambda m: m["message_id"])
    said = F.transform(F.coalesce("source_message_ids", F.array().cast("array<string>")), lambda x: x.try_cast("bigint"))
    shown = F.array_distinct(F.filter(said, lambda x: F.array_contains(ids(lambda m: F.lit(True)), x)))
    own = lambda m: ~m["in_context"]
    telling = ids(lambda m: own(m) & F.contains(F.lower(m["content"]), F.lower(F.trim("subject"))))
    rows = rows.withColumn("shown", shown).withColumn("telling", telling)
    first = lambda a, b: F.when(F.size(a) > 0, F.col(a)).otherwise(b)
    rows = rows.withColumn("sources", first("shown", first("telling", ids(own)))).where(F.size("sources") > 0)
    at = F.filter("messages", lambda m: m["message_id"] == F.get(F.col("sources"), F.lit(0)))
    time = lambda c: T.parse_time(F.col(c)).cast("timestamp_ntz")
    kind = T.relation_type(F.col("relation_type"))
    rows = rows.withColumns({"observed_at": F.coalesce(time("observed_at"), F.get(at, F.lit(0))["created_at"].cast("timestamp_ntz")), "valid_from": time("valid_from"), "valid_until": time("valid_until"), "target_literal": literal, "relation_type": kind})
    one = F.col("target_entity_id").isNotNull() != F.col("target_literal").isNotNull()
    rows = rows.where(one & (F.col("relation_type") != "")).withColumn("confidence", F.least(F.greatest(F.coalesce("confidence", F.lit(0.0)), F.lit(0.0)), F.lit(1.0)))
    key = T.dedup_key(*(F.col(c) for c in ("source_entity_id", "relation_type", "target_entity_id", "target_literal", "valid_from")))
    return rows.select("workspace_id", *KEY, "nth", "source_entity_id", "relation_type", "target_entity_id", "target_literal", "observed_at", "valid_from", "valid_until", "confidence", "sources", key.alias("dedup_key"))


def candidate_text(windows: DataFrame, limit: int = 4000) -> Column:
    """The text by which a window's known entities are looked up: its own messages, cut to a number of characters."""
    own = F.filter("messages", lambda m: ~m["in_context"])
    return F.substring(F.array_join(F.transform(own, lambda m: F.concat(m["content"], F.lit("\n"))), ""), 1, limit)


def with_context(messages: DataFrame, size: int = 12, before: int = 4) -> DataFrame:
    """Live messages of each conversation in windows of a size, each window with the messages just before it (in_context)."""
    nth = F.row_number().over(Window.partitionBy("conversation_id").orderBy("sequence_number")) - 1
    rows = messages.where(~F.col("deleted")).withColumn("nth", nth).withColumn("window", F.floor(F.col("nth") / size))
    first = rows.groupBy("conversation_id", "window").agg(F.min("sequence_number").alias("first"))
    own = rows.select(*KEY, "message_id", "sequence_number", "content", "created_at", F.lit(False).alias("in_context"))
    after = rows.where(F.col("nth") % size >= size - before).withColumn("window", F.col("window") + 1).join(first, [*KEY])
    near = after.where((F.col("sequence_number") >= F.col("first") - before) & (F.col("sequence_number") < F.col("first")))
    return own.unionByName(near.select(*KEY, "message_id", "sequence_number", "content", "created_at", F.lit(True).alias("in_context")))

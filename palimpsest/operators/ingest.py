"""Messages in, units out, and what edits and deletions touch."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..schema import Config
from .access import bounded, grants, guard, like, reason
from .search import latest_units, restrict, top


def replay_once(messages: DataFrame) -> DataFrame:
    """The first message of each (conversation_id, request_id)."""
    order = Window.partitionBy("conversation_id", "request_id").orderBy("created_at", "message_id")
    return messages.withColumn("nth", F.row_number().over(order)).where("nth = 1").drop("nth")


def assign_sequence(new: DataFrame, existing: DataFrame) -> DataFrame:
    """Gapless sequence numbers of new messages, after those that their conversation has; replays are skipped."""
    known = existing.select("conversation_id", "request_id")
    fresh = replay_once(new).join(known, ["conversation_id", "request_id"], "left_anti")
    last = existing.groupBy("conversation_id").agg(F.max("sequence_number").alias("last"))
    nth = F.row_number().over(Window.partitionBy("conversation_id").orderBy("created_at", "message_id"))
    return fresh.drop("sequence_number").join(last, "conversation_id", "left").withColumn("sequence_number", F.coalesce("last", F.lit(0)) + nth).drop("last")


def around(messages: DataFrame, spots: DataFrame, before: int, after: int) -> DataFrame:
    """Live messages near spots (spot, conversation_id, sequence_number)."""
    at = spots.select("spot", "conversation_id", F.col("sequence_number").alias("at"))
    rows = messages.where(~F.col("deleted")).join(at, "conversation_id")
    return rows.where(F.col("sequence_number").between(F.col("at") - before, F.col("at") + after)).drop("at")


def previous(messages: DataFrame, n: int) -> DataFrame:
    """For each live message the ids of the n live ones before it, oldest first."""
    w = Window.partitionBy("conversation_id").orderBy("sequence_number").rowsBetween(-n, -1)
    return messages.where(~F.col("deleted")).select("message_id", F.collect_list("message_id").over(w).alias("previous"))


def pending(messages: DataFrame, positions: DataFrame, limit: int) -> DataFrame:
    """The next messages after each conversation's position (conversation_id, position), and whether more follow."""
    rows = messages.join(positions, "conversation_id").where("sequence_number > position")
    w = Window.partitionBy("conversation_id")
    rows = rows.withColumn("nth", F.row_number().over(w.orderBy("sequence_number"))).where(F.col("nth") <= limit + 1)
    return rows.withColumn("more", F.max("nth").over(w) > limit).where(F.col("nth") <= limit).drop("nth", "position")


def upsert(rows: DataFrame, key: str, at: str) -> DataFrame:
    """The latest row of each key."""
    w = Window.partitionBy(key).orderBy(F.desc(at), *(F.desc(c) for c in rows.columns if c not in (key, at) and rows.schema[c].dataType.typeName() in ("string", "long", "integer")))
    return rows.withColumn("nth", F.row_number().over(w)).where("nth = 1").drop("nth")


#: Fixed texts of a unit.
HEADER, FOOTER, MAIN = "Contexte précédent :\n", "\n", "Message principal :\n"


def build_units(messages: DataFrame, participants: DataFrame, config: Config = Config(), model: str = "m", strategy: str = "contextual", version: int = 1) -> DataFrame:
    """The text to embed for each message of an indexed role: who takes part, the messages before that fit, and the message."""
    n = config.previous_messages
    live = messages.where(~F.col("deleted")).withColumn("line", F.concat("author_key", F.lit(" : "), "content", F.lit("\n")))
    w = Window.partitionBy("conversation_id").orderBy("sequence_number").rowsBetween(-n, -1)
    rows = live.withColumn("before", F.collect_list(F.struct("sequence_number", "line")).over(w))
    who = participants.where(~F.col("left")).groupBy("conversation_id").agg(F.array_sort(F.collect_set("participant_key")).alias("who"))
    rows = rows.where(F.col("role").isin(*config.indexed_roles)).join(who, "conversation_id", "left")
    preamble = F.when(F.size(F.coalesce("who", F.array().cast("array<string>"))) > 0, F.concat(F.lit("Conversation impliquant "), T.join_french(F.col("who")), F.lit(".\n\n"))).otherwise("")
    rows = rows.withColumn("preamble", preamble).withColumn("main", F.concat(F.lit(MAIN), "author_key", F.lit(" : "), "content"))
    room = F.lit(config.max_chars) - F.octet_length("preamble") - F.octet_length("main") - len((HEADER + FOOTER).encode())
    start = F.struct(F.lit(0).alias("used"), F.array().cast("array<struct<sequence_number:bigint,line:string>>").alias("kept"), F.lit(False).alias("full"))

    def walk(a, x):
        size = a["used"] + F.octet_length(x["line"])
        stop = a["full"] | (size > room)
        kept = F.when(stop, a["kept"]).otherwise(F.concat(F.array(F.struct(x["sequence_number"].cast("bigint").alias("sequence_number"), x["line"].alias("line"))), a["kept"]))
        return F.struct(F.when(stop, a["used"]).otherwise(size).alias("used"), kept.alias("kept"), stop.alias("full"))

    rows = rows.withColumn("kept", F.aggregate(F.reverse("before"), start, walk)["kept"])
    context = F.when(F.size("kept") > 0, F.concat(F.lit(HEADER), F.array_join(F.transform("kept", lambda x: x["line"]), ""), F.lit(FOOTER))).otherwise("")
    rows = rows.withColumn("whole", F.concat("preamble", context, "main"))
    limit = F.lit(config.max_chars)
    cut = F.concat("preamble", T.truncate_bytes(F.col("main"), limit - F.octet_length("preamble")))
    long = F.octet_length("whole") > limit
    text = F.when(long, T.truncate_bytes(cut, limit)).otherwise(F.col("whole"))
    first = F.when(long | (F.size("kept") == 0), F.col("sequence_number")).otherwise(F.get(F.col("kept"), F.lit(0))["sequence_number"])
    ident = T.unit_id(F.col("message_id"), F.lit(model), F.lit(strategy), F.lit(version))
    return rows.select(ident.alias("unit_uuid"), "workspace_id", "conversation_id", F.col("message_id").alias("anchor_message_id"), first.alias("start_sequence"), F.col("sequence_number").alias("end_sequence"), text.alias("embedding_text"))


def covering(units: DataFrame, touched: DataFrame) -> DataFrame:
    """Active units whose interval holds a touched message (conversation_id, sequence_number)."""
    at = touched.select("conversation_id", F.col("sequence_number").alias("at"))
    return units.where("active").join(at, "conversation_id").where(F.col("at").between(F.col("start_sequence"), F.col("end_sequence"))).drop("at").dropDuplicates(["unit_id"])


def rebuild_after_delete(units: DataFrame, messages: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Units to deactivate because a message in them was deleted, and the live anchors to index again."""
    hit = covering(units, messages.where("deleted"))
    live = messages.where(~F.col("deleted")).select(F.col("message_id").alias("anchor_message_id"))
    return hit.select("unit_id"), hit.join(live, "anchor_message_id", "left_semi").select("anchor_message_id")


def delete_conversations(conversations: DataFrame, messages: DataFrame, units: DataFrame, sources: DataFrame) -> dict[str, DataFrame]:
    """What goes with deleted conversations: messages, units, and messages whose relations must be looked at again."""
    gone = conversations.where("deleted").select("conversation_id")
    lost = messages.join(gone, "conversation_id", "left_semi")
    return {
        "messages": lost.select("message_id"),
        "units": units.where("active").join(gone, "conversation_id", "left_semi").select("unit_id"),
        "reevaluate": sources.select("message_id").distinct().join(lost.select("message_id"), "message_id", "left_semi"),
    }


def add_participants(participants: DataFrame, declared: DataFrame) -> DataFrame:
    """Participants after declarations (conversation_id, participant_key): they accumulate, and who had left is back."""
    asked = declared.select("conversation_id", "participant_key").distinct().withColumn("asked", F.lit(True))
    rows = participants.select("conversation_id", "participant_key", "left").join(asked, ["conversation_id", "participant_key"], "full_outer")
    return rows.select("conversation_id", "participant_key", (F.coalesce("left", F.lit(False)) & F.col("asked").isNull()).alias("left"))


def declare(old: DataFrame, new: DataFrame) -> DataFrame:
    """Conversations after declarations (conversation_id, workspace_id, scope, ord): the last scope; another workspace's is refused."""
    owner = old.select("conversation_id", F.col("workspace_id").alias("owner"), F.col("deleted").alias("gone"))
    ok = new.join(owner, "conversation_id", "left").where(F.col("owner").isNull() | ((F.col("owner") == F.col("workspace_id")) & ~F.col("gone")))
    last = ok.groupBy("conversation_id", "workspace_id").agg(F.max_by("scope", "ord").alias("new_scope"))
    return old.select("conversation_id", "workspace_id", "scope").join(last, ["conversation_id", "workspace_id"], "full_outer").select("conversation_id", "workspace_id", F.coalesce("new_scope", "scope").alias("scope"))


def grant(acl: DataFrame, changes: DataFrame) -> DataFrame:
    """Grants after changes (unit_id, principal_key, permission, ord); a null permission revokes."""
    start = acl.select("unit_id", "principal_key", "permission", F.lit(-1).cast("bigint").alias("ord"))
    last = start.unionByName(changes.select("unit_id", "principal_key", "permission", F.col("ord").cast("bigint"))).groupBy("unit_id", "principal_key").agg(F.max_by("permission", "ord").alias("permission"))
    return last.where("permission IS NOT NULL")


def grants_of(acl: DataFrame) -> DataFrame:
    """Grants of each unit in the order of principals: unit_id, principal_key, permission, place."""
    place = F.row_number().over(Window.partitionBy("unit_id").orderBy("principal_key", "permission"))
    return acl.select("unit_id", "principal_key", "permission", place.alias("place"))


def list_messages(messages: DataFrame, units: DataFrame, conversations: DataFrame, seen: DataFrame, acl: DataFrame, queries: DataFrame, limit: int, after: DataFrame | None = None, conversation_ids: list[str] | None = None, metadata: Column | None = None) -> DataFrame:
    """A page of readable messages, newest first, one more than the limit to tell whether another page follows.

    after: query_id, at, id: the last row of the page before. Readable conversations come first: their newest messages meet
    the queries that read them, and messages read by grant only come by their units.
    """
    newest = (F.desc("created_at"), F.desc("message_id"))
    live = guard(restrict(messages.where(~F.col("deleted")), conversation_ids, metadata), conversations)
    shown = live
    if after is None:  # no page needs more of one conversation
        shown = top(live, limit + 1, *newest, by="conversation_id").drop("rank")
    scope = F.col("scope")
    by_scope = shown.join(seen.select("query_id", "conversation_id", "scope"), "conversation_id").withColumn("access_reason", reason(scope)).drop("scope")
    own = latest_units(units).select(F.col("anchor_message_id").alias("message_id"), "unit_id")
    granted = grants(acl, queries).join(own, "unit_id").select("query_id", "message_id").distinct().join(bounded(queries, "query_id", "workspace_id"), "query_id")
    by_grant = live.join(granted, ["message_id", "workspace_id"]).join(seen.select("query_id", "conversation_id"), ["query_id", "conversation_id"], "left_anti").withColumn("access_reason", F.lit("explicit_acl"))
    rows = by_scope.unionByName(by_grant)
    if after is not None:
        rows = rows.join(like(after, queries), "query_id", "left").where(F.col("at").isNull() | (F.struct("created_at", "message_id") < F.struct(F.col("at").alias("created_at"), F.col("id").alias("message_id"))))
    page = top(rows, limit + 1, *newest)
    more = F.max("rank").over(Window.partitionBy("query_id")) > limit
    return page.withColumn("more", more).where(F.col("rank") <= limit)


def list_conversations(conversations: DataFrame, seen: DataFrame, limit: int, prefix: str = "", after: str = "") -> DataFrame:
    rows = seen.where(F.col("conversation_id").startswith(prefix) & (F.col("conversation_id") > after))
    return top(rows.select("query_id", "conversation_id", "scope"), limit, F.asc("conversation_id"))

"""Who may read what: one rule for every search and listing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Rows of the query side up to which it is broadcast.
QUERY_ROWS = 200_000


def bounded(queries: DataFrame, *columns: str) -> DataFrame:
    """queries (their columns), marked for broadcast if they are few; a batch of queries is small beside the store.

    The rows of a DataFrame are counted once, however often it is asked for.
    """
    if "_few" not in queries.__dict__:
        queries._few = queries.limit(QUERY_ROWS + 1).count() <= QUERY_ROWS
    rows = queries.select(*columns) if columns else queries
    return F.broadcast(rows) if queries._few else rows


def like(rows: DataFrame, queries: DataFrame) -> DataFrame:
    """rows made from queries, a few for each, marked for broadcast if the queries are few."""
    bounded(queries)
    return F.broadcast(rows) if queries._few else rows


def require_requester(queries: DataFrame) -> DataFrame:
    """Fails on a query without workspace or requester, before anything is returned for it."""
    if queries.__dict__.get("_checked"):
        return queries
    if "_guarded" in queries.__dict__:
        return queries._guarded
    ok = (F.coalesce("workspace_id", F.lit("")) != "") & (F.coalesce("requester", F.lit("")) != "")
    checked = queries.where(F.when(ok, F.lit(True)).otherwise(F.raise_error(F.lit("workspace and requester are required")).cast("boolean")))
    checked._checked = True
    queries._guarded = checked
    return checked


def readable(conversations: DataFrame, participants: DataFrame, queries: DataFrame) -> DataFrame:
    """(query_id, conversation_id, scope) that a query's requester reads by scope alone."""
    asked = bounded(require_requester(queries), "query_id", "workspace_id", "requester")
    open_ = conversations.where(~F.col("deleted") & F.col("scope").isin("workspace", "participants")).select("workspace_id", "conversation_id", "scope")
    pairs = open_.join(asked, "workspace_id")
    present = participants.where(~F.col("left")).select("conversation_id", F.col("participant_key").alias("requester")).distinct().withColumn("takes_part", F.lit(True))
    seen = pairs.join(present, ["conversation_id", "requester"], "left")
    return seen.where((F.col("scope") == "workspace") | F.col("takes_part")).select("query_id", "conversation_id", "scope")


def reason(scope: Column) -> Column:
    return F.when(scope == "workspace", "workspace_scope").when(scope.isNotNull(), "conversation_participant").otherwise("explicit_acl")


def grants(acl: DataFrame, queries: DataFrame) -> DataFrame:
    """(query_id, unit_id): units that a query's requester reads by grant."""
    granted = acl.where("permission = 'read'").select("unit_id", F.col("principal_key").alias("requester")).distinct()
    return granted.join(bounded(require_requester(queries), "query_id", "requester"), "requester").select("query_id", "unit_id")


def with_access(rows: DataFrame, seen: DataFrame, acl: DataFrame, queries: DataFrame) -> DataFrame:
    """rows (query_id, conversation_id, unit_id, ...) that may be read, with access_reason."""
    granted = grants(acl, queries).withColumn("granted", F.lit(True))
    joined = rows.join(seen, ["query_id", "conversation_id"], "left").join(granted, ["query_id", "unit_id"], "left")
    return joined.where(F.col("scope").isNotNull() | F.col("granted")).withColumn("access_reason", reason(F.col("scope"))).drop("scope", "granted")


def guard(rows: DataFrame, conversations: DataFrame, workspace: str = "workspace_id") -> DataFrame:
    """rows whose conversation is live and of their workspace."""
    live = conversations.where(~F.col("deleted")).select("conversation_id", F.col("workspace_id").alias(workspace))
    return rows.join(live, ["conversation_id", workspace], "left_semi")


def identity_matches(patterns: Column, key: Column) -> Column:
    """A key is allowed by `*`, by itself, or by a pattern that ends with a star; other stars are literal."""
    one = lambda p: (p == "*") | (p == key) | (p.endswith("*") & key.startswith(F.substring(p, F.lit(1), F.length(p) - 1)))
    return (F.coalesce(key, F.lit("")) != "") & F.coalesce(F.exists(patterns, one), F.lit(False))


def authorised(patterns: Column, own_workspace: Column, workspace: Column, key: Column) -> Column:
    return F.coalesce(own_workspace == workspace, F.lit(False)) & identity_matches(patterns, key)


def rights(conversations: DataFrame, participants: DataFrame, callers: DataFrame) -> DataFrame:
    """callers (caller, workspace_id) by conversation of their workspace: can_share, can_manage, can_delete."""
    takes = participants.where(~F.col("left")).select("conversation_id", F.col("participant_key").alias("caller")).distinct().withColumn("in_it", F.lit(True))
    rows = conversations.where(~F.col("deleted")).join(bounded_callers(callers), "workspace_id").join(takes, ["conversation_id", "caller"], "left")
    inside = F.coalesce("in_it", F.lit(False))
    share = (F.col("scope") == "workspace") | ((F.col("scope") == "participants") & inside)
    return rows.select("caller", "conversation_id", share.alias("can_share"), (share | inside).alias("can_manage"), share.alias("can_delete"))


def bounded_callers(callers: DataFrame) -> DataFrame:
    return bounded(callers, "caller", "workspace_id")

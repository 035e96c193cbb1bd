"""Background work as tables: extraction positions, due times, consistency modes, and API clients."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import token_hash


def backfilled_positions(conversations: DataFrame, messages: DataFrame, jobs: DataFrame) -> DataFrame:
    """(conversation_id, position): just before the first message that an unfinished extraction waits for, else after the last.

    jobs: job_type, status, conversation_id, payload (JSON with message_id).
    """
    waiting = jobs.where((F.col("job_type") == "graph_extract") & F.col("status").isin("pending", "running"))
    waiting = waiting.select("conversation_id", F.get_json_object("payload", "$.message_id").alias("key"))
    named = messages.select("conversation_id", F.col("message_id").cast("string").alias("key"), "sequence_number")
    first = waiting.join(named, ["conversation_id", "key"]).groupBy("conversation_id").agg((F.min("sequence_number") - 1).alias("first"))
    last = messages.groupBy("conversation_id").agg(F.max("sequence_number").alias("last"))
    rows = conversations.select("conversation_id").join(first, "conversation_id", "left").join(last, "conversation_id", "left")
    return rows.select("conversation_id", F.coalesce("first", "last", F.lit(0)).alias("position"))


def advanced(positions: DataFrame, done: DataFrame) -> DataFrame:
    """Positions after extractions (conversation_id, through) in any order: they only grow."""
    most = done.groupBy("conversation_id").agg(F.max("through").alias("through"))
    rows = positions.join(most, "conversation_id", "left")
    return rows.select("conversation_id", F.greatest("position", F.coalesce("through", F.lit(0))).alias("position"))


def due(last_sequence: Column, position: Column, now: Column, flush_after: int, debounce_s: int) -> Column:
    """When a conversation's extraction runs: at once if enough messages wait, else after a pause."""
    full = last_sequence - position >= max(1, flush_after)
    return F.when(full, now).otherwise(now + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), F.lit(debounce_s).cast("decimal(18,6)")))


def skip_after_last_attempt(windows: DataFrame, limit: int) -> DataFrame:
    """Windows (conversation_id, through, attempts, failed): outcome, and the position that the conversation moves on to.

    A window that fails at its last attempt is a dead letter and is skipped, so it does not block what follows; one that
    fails before is tried again and moves nothing.
    """
    last = F.lit(limit > 0) & (F.col("attempts") + 1 >= limit)
    outcome = F.when(~F.col("failed"), "done").when(last, "dead").otherwise("retry")
    return windows.withColumn("outcome", outcome).withColumn("moves_to", F.when(F.col("outcome") != "retry", F.col("through")))


def ingest_status(messages: DataFrame, indexed_roles: tuple[str, ...], graph_enabled: bool) -> DataFrame:
    """Messages (role, consistency, replayed, embed_failed) with what their writer is told.

    `searchable` embeds at once: if that works the status is searchable, if it fails the message is stored and a job left;
    `eventual` (the default) always leaves a job. A replay is stored already and schedules nothing.
    """
    wanted = F.col("role").isin(*indexed_roles) & ~F.col("replayed")
    now = wanted & (F.coalesce("consistency", F.lit("eventual")) == "searchable")
    works = now & ~F.col("embed_failed")
    graph = F.when(F.lit(not graph_enabled), "disabled").when(F.col("replayed"), "already_requested").otherwise("pending")
    return messages.withColumns({"status": F.when(works, "searchable").otherwise("stored"), "embed_scheduled": wanted & ~works, "graph_status": graph})


def reclaimed(jobs: DataFrame, now: Column, stuck_s: int = 600) -> DataFrame:
    """jobs (status, locked_at, ...) with those that have run too long pending again."""
    stuck = (F.col("status") == "running") & (F.col("locked_at") < now - F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), F.lit(stuck_s).cast("decimal(18,6)")))
    return jobs.withColumn("status", F.when(stuck, "pending").otherwise(F.col("status"))).withColumn("locked_at", F.when(~stuck, F.col("locked_at")))


def valid_clients(clients: DataFrame) -> DataFrame:
    """Clients (label, workspace_id, identities, token) as they are stored: without the token, with its hash. A missing part is an error."""
    given = lambda c: F.coalesce(c, F.lit("")) != ""
    ok = given("label") & given("workspace_id") & given("token") & (F.size(F.coalesce("identities", F.array().cast("array<string>"))) > 0) & ~F.exists("identities", lambda x: F.coalesce(x, F.lit("")) == "")
    checked = clients.where(F.when(ok, F.lit(True)).otherwise(F.raise_error(F.lit("label, workspace, token and identities are required")).cast("boolean")))
    return checked.withColumn("token_sha256", token_hash(F.col("token"))).drop("token")


def revoke(clients: DataFrame, labels: DataFrame, at: Column) -> DataFrame:
    """clients (label, revoked_at, ...) after the labels (label) were revoked; who was before keeps the date."""
    named = labels.select("label").distinct().withColumn("named", F.lit(True))
    return clients.join(named, "label", "left").withColumn("revoked_at", F.coalesce("revoked_at", F.when(F.col("named"), at))).drop("named")


def resolve(clients: DataFrame, tokens: DataFrame) -> DataFrame:
    """tokens (key, token) with the live client that each belongs to; unknown and revoked ones find none."""
    asked = tokens.where("token <> ''").withColumn("token_sha256", token_hash(F.col("token"))).drop("token")
    return asked.join(clients.where("revoked_at IS NULL"), "token_sha256").drop("revoked_at")


def latest_job(jobs: DataFrame) -> DataFrame:
    """One pending job a conversation: the last that was scheduled (conversation_id, ord, ...)."""
    place = F.row_number().over(Window.partitionBy("conversation_id").orderBy(F.desc("ord")))
    return jobs.withColumn("nth", place).where("nth = 1").drop("nth")

"""A bi-temporal graph of facts: upsert, validity chains, traversal and masking."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .access import bounded, guard, like, with_access
from ..functions.text import dedup_key, slug
from ..functions.vector import cosine
from .search import latest_units, restrict, top


def merge_entities(entities: DataFrame) -> DataFrame:
    """One row for each (workspace_id, canonical_key): first name by ingest order, all other names and aliases, resolved if any was.

    entities: workspace_id, canonical_key, display_name, aliases, resolved, ingest_ord.
    """
    rows = entities.groupBy("workspace_id", "canonical_key").agg(
        F.min_by("display_name", "ingest_ord").alias("display_name"),
        F.array_distinct(F.flatten(F.collect_list(F.concat("aliases", F.array("display_name"))))).alias("every"),
        F.bool_or("resolved").alias("resolved"),
    )
    return rows.withColumn("aliases", F.array_sort(F.array_except("every", F.array("display_name")))).drop("every")


def merge_relations(relations: DataFrame) -> DataFrame:
    """One row for each (workspace_id, dedup_key): greatest confidence, the first vector, other values of the first row, union of sources."""
    first = [c for c in ("source_entity_id", "relation_type", "target_entity_id", "target_literal", "observed_at", "valid_from", "valid_until", "scope") if c in relations.columns]
    vector = [F.min_by("embedding", F.when(F.col("embedding").isNotNull(), F.col("ingest_ord"))).alias("embedding")] if "embedding" in relations.columns else []
    return relations.groupBy("workspace_id", "dedup_key").agg(
        F.max("confidence").alias("confidence"),
        *(F.min_by(c, "ingest_ord").alias(c) for c in first),
        *vector,
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("sources")))).alias("sources"),
    )


def valid(relations: DataFrame) -> DataFrame:
    """Relations that may be stored: exactly one target, a type, a date; confidence clamped to [0, 1]."""
    one = F.col("target_entity_id").isNotNull() != F.col("target_literal").isNotNull()
    ok = one & (F.coalesce("relation_type", F.lit("")) != "") & F.col("observed_at").isNotNull() & F.col("source_entity_id").isNotNull()
    return relations.where(ok).withColumn("confidence", F.least(F.greatest("confidence", F.lit(0.0)), F.lit(1.0)))


def chains(relations: DataFrame, single_valued: tuple[str, ...]) -> DataFrame:
    """valid_until of single-valued relations: the next strictly later observation of the same source and type."""
    key = Window.partitionBy("workspace_id", "source_entity_id", "relation_type")
    later = key.orderBy(F.unix_micros(F.col("observed_at").cast("timestamp"))).rangeBetween(1, Window.unboundedFollowing)
    mine = F.col("relation_type").isin(*single_valued) & ~F.col("invalidated")
    chained = relations.where(mine).withColumn("valid_until", F.min("observed_at").over(later))
    return chained.unionByName(relations.where(~mine), allowMissingColumns=True)


def reevaluate(relations: DataFrame, sources: DataFrame, messages: DataFrame) -> DataFrame:
    """Marks relations without a live source as invalidated; those that were stay so."""
    live = sources.join(messages.where(~F.col("deleted")).select("message_id"), "message_id", "left_semi").select("relation_id").distinct().withColumn("has_source", F.lit(True))
    return relations.join(live, "relation_id", "left").withColumn("invalidated", F.col("invalidated") | F.col("has_source").isNull()).drop("has_source")


def apply(entities: DataFrame, relations: DataFrame, single_valued: tuple[str, ...]) -> tuple[DataFrame, DataFrame]:
    """The stored graph from all extractions: entities merged, valid relations merged, single-valued ones chained.

    relations: workspace_id, source_entity_id, relation_type, target_entity_id or target_literal, observed_at, valid_from,
    confidence, sources, ingest_ord. Tables are recomputed as a whole, so replays change nothing.
    """
    kept = valid(relations).withColumn("dedup_key", dedup_key(*(F.col(c) for c in ("source_entity_id", "relation_type", "target_entity_id", "target_literal", "valid_from"))))
    stored = merge_relations(kept.where(F.size("sources") > 0)).withColumn("invalidated", F.lit(False))
    return merge_entities(entities), chains(stored.drop("valid_until"), single_valued)


def reevaluated_chains(relations: DataFrame, sources: DataFrame, messages: DataFrame, single_valued: tuple[str, ...]) -> DataFrame:
    """Relations looked at again after deletions: invalidated ones leave their chains, which close on what is left."""
    return chains(reevaluate(relations, sources, messages).drop("valid_until"), single_valued)


def seeds(entities: DataFrame, queries: DataFrame, limit: int = 50, similar: DataFrame | None = None) -> DataFrame:
    """Entities that a query's subjects name: by key, by its second part, or by name; then those whose name resembles the query.

    A subject also stands for the slug of its part after the first colon. similar: query_id, entity_id, score. Named ones
    come first, then the most similar, then by id.
    """
    asked = queries.select("query_id", "workspace_id", F.explode("subjects").alias("subject"))
    low, colon = F.lower(F.trim("subject")), F.instr("subject", ":")
    local = F.when(colon > 0, slug(F.substring("subject", colon + 1, F.length("subject"))))
    forms = F.array_distinct(F.filter(F.array(low, local), lambda x: F.coalesce(x, F.lit("")) != ""))
    keys = asked.select("query_id", "workspace_id", F.explode(forms).alias("name"))
    names = F.array_distinct(F.array("canonical_key", F.split_part("canonical_key", F.lit(":"), F.lit(2)), F.lower("display_name")))
    known = entities.select("workspace_id", "entity_id", F.explode(names).alias("name"))
    found = known.join(like(keys.distinct(), queries), ["workspace_id", "name"]).select("query_id", "entity_id", F.lit(1).alias("named"), F.lit(0.0).alias("score"))
    if similar is not None:
        found = found.unionByName(similar.select("query_id", "entity_id", F.lit(0).alias("named"), "score"))
    found = found.groupBy("query_id", "entity_id").agg(F.max("named").alias("named"), F.max("score").alias("score"))
    return top(found, limit, F.desc("named"), F.desc("score"), F.asc("entity_id")).select("query_id", "entity_id")


def reachable(seed: DataFrame, relations: DataFrame, max_hops: int = 2) -> DataFrame:
    """(query_id, entity_id, depth): entities within max_hops - 1 steps, each at its least depth."""
    edges = relations.where(~F.col("invalidated") & F.col("target_entity_id").isNotNull())
    ends = edges.select(F.col("source_entity_id").alias("entity_id"), F.col("target_entity_id").alias("to"))
    ends = ends.unionByName(edges.select(F.col("target_entity_id").alias("entity_id"), F.col("source_entity_id").alias("to"))).distinct()
    found = seed.withColumn("depth", F.lit(0))
    last = found
    for d in range(1, min(max_hops, 3)):
        last = ends.join(last.select("query_id", "entity_id"), "entity_id").select("query_id", F.col("to").alias("entity_id")).distinct().withColumn("depth", F.lit(d))
        found = found.unionByName(last)
    return found.groupBy("query_id", "entity_id").agg(F.min("depth").alias("depth"))


def facts(found: DataFrame, relations: DataFrame) -> DataFrame:
    """Live relations that touch a reached entity, at their least depth (from 1)."""
    live = relations.where(~F.col("invalidated"))
    ends = live.select("relation_id", F.col("source_entity_id").alias("entity_id")).unionByName(live.where("target_entity_id IS NOT NULL").select("relation_id", F.col("target_entity_id").alias("entity_id")))
    near = ends.join(found, "entity_id").groupBy("query_id", "relation_id").agg((F.min("depth") + 1).alias("depth"))
    return near.join(live, "relation_id")


def readable_sources(rows: DataFrame, sources: DataFrame, messages: DataFrame, conversations: DataFrame, units: DataFrame, seen: DataFrame, acl: DataFrame, queries: DataFrame, *, conversation_ids: list[str] | None = None, metadata: Column | None = None) -> DataFrame:
    """Facts by source message that may be read. A fact seen only by grant needs all its sources, deleted ones too, in the granted unit."""
    place = messages.select("message_id", F.col("conversation_id").alias("c"), F.col("sequence_number").alias("s"))
    # the extent of each relation's sources, once a relation; a window holds them all if it holds these
    extent = sources.join(place, "message_id").groupBy("relation_id").agg(F.min("c").alias("c0"), F.max("c").alias("c1"), F.min("s").alias("s0"), F.max("s").alias("s1"))
    live = guard(restrict(messages.where(~F.col("deleted")), conversation_ids, metadata), conversations).select("message_id", "workspace_id", "conversation_id", "sequence_number")
    own = latest_units(units).select(F.col("anchor_message_id").alias("message_id"), "unit_id", "start_sequence", "end_sequence")
    joined = rows.drop("workspace_id").join(sources, "relation_id").join(live, "message_id").join(bounded(queries, "query_id", "workspace_id"), ["query_id", "workspace_id"]).join(own, "message_id", "left").join(extent, "relation_id")
    allowed = with_access(joined, seen, acl, queries)
    inside = (F.col("c0") == F.col("conversation_id")) & (F.col("c1") == F.col("conversation_id")) & (F.col("s0") >= F.col("start_sequence")) & (F.col("s1") <= F.col("end_sequence"))
    return allowed.where((F.col("access_reason") != "explicit_acl") | inside).drop("c0", "c1", "s0", "s1")


def mask(rows: DataFrame, relations: DataFrame) -> DataFrame:
    """valid_until shown only if no relation, invalidated ones included, was observed then, or one that the query may read was."""
    key = ["source_entity_id", "relation_type"]
    at = F.col("observed_at").alias("valid_until")
    sibling = relations.select("workspace_id", *key, at).distinct().withColumn("sibling", F.lit(True))
    known = rows.select("query_id", *key, at).distinct().withColumn("known", F.lit(True))
    joined = rows.join(sibling, ["workspace_id", *key, "valid_until"], "left").join(known, ["query_id", *key, "valid_until"], "left")
    return joined.withColumn("valid_until", F.when(F.col("sibling").isNull() | F.col("known"), F.col("valid_until"))).drop("sibling", "known")


def distance(rows: DataFrame, vectors: DataFrame, queries: DataFrame) -> DataFrame:
    """rows with fact_distance: cosine distance (6 decimals) of the fact's vector to the question; 2, beyond all, without vectors."""
    asked = bounded(queries, "query_id", "embedding").withColumnRenamed("embedding", "question")
    near = rows.select("query_id", "relation_id").distinct().join(vectors.select("relation_id", F.col("embedding").alias("vector")), "relation_id").join(asked, "query_id")
    near = near.select("query_id", "relation_id", F.round(1 - cosine(F.col("vector"), F.col("question")), 6).alias("near"))
    return rows.join(near, ["query_id", "relation_id"], "left").withColumn("fact_distance", F.coalesce("near", F.lit(2.0))).drop("near")


def ordered(rows: DataFrame, per_relation: int = 3, limit: int = 20) -> DataFrame:
    """The first rows of each query: nearest facts first, depths interleaved, at most some sources of a relation."""
    rows = rows if "fact_distance" in rows.columns else rows.withColumn("fact_distance", F.lit(2.0))
    best = (F.desc("sequence_number"), F.desc("message_id"))
    source = Window.partitionBy("query_id", "relation_id").orderBy(*best)
    depth = Window.partitionBy("query_id", "depth").orderBy(F.desc("confidence"), F.desc("observed_at"), "relation_id", F.desc("sequence_number"))
    ranked = rows.withColumn("depth_rank", F.row_number().over(depth)).withColumn("source_rank", F.row_number().over(source)).where(F.col("source_rank") <= per_relation)
    return top(ranked, limit, F.asc("fact_distance"), F.asc("depth_rank"), F.asc("depth"), F.desc("confidence"), F.desc("observed_at"), *best, F.asc("relation_id"))


def named(rows: DataFrame, entities: DataFrame) -> DataFrame:
    """rows with subject and object: names of the entities, or the literal that stands for the target."""
    source = entities.select(F.col("entity_id").alias("source_entity_id"), F.col("display_name").alias("subject"))
    target = entities.select(F.col("entity_id").alias("target_entity_id"), F.col("display_name").alias("__name"))
    return rows.join(source, "source_entity_id").join(target, "target_entity_id", "left").withColumn("object", F.coalesce("__name", "target_literal")).drop("__name")


def candidates(rows: DataFrame) -> DataFrame:
    """Ordered, named rows as candidates: one an anchor message, ranked by its first row, with 1 / depth as score and its entities."""
    first = lambda c: F.min_by(c, "rank").alias(c)
    said = F.sort_array(F.collect_list(F.struct("rank", F.array("subject", "object").alias("names"))))  # at most `limit` rows a query
    each = rows.groupBy("query_id", F.col("message_id").alias("anchor_message_id")).agg(
        *map(first, ("unit_id", "conversation_id", "start_sequence", "end_sequence", "sequence_number", "access_reason", "depth")), F.min("rank").alias("first"), said.alias("said")
    )
    names = F.array_distinct(F.filter(F.flatten(F.transform("said", lambda x: x["names"])), lambda x: F.coalesce(x, F.lit("")) != ""))
    each = each.withColumn("entities", names).withColumn("raw_score", 1.0 / F.col("depth"))
    each = each.withColumn("start_sequence", F.coalesce("start_sequence", "sequence_number")).withColumn("end_sequence", F.coalesce("end_sequence", "sequence_number"))
    place = F.row_number().over(Window.partitionBy("query_id").orderBy("first"))
    return each.withColumn("rank", place).drop("first", "said", "depth", "sequence_number")


def grouped_facts(rows: DataFrame, limit: int = 20) -> DataFrame:
    """Ordered, named rows as facts: one a relation with the messages that it comes from, the first `limit` of each query."""
    same = ("relation_id", "subject", "relation_type", "object", "confidence", "observed_at", "valid_from", "valid_until")
    sources = F.transform(F.sort_array(F.collect_list(F.struct("rank", "message_id"))), lambda x: x["message_id"])
    each = rows.groupBy("query_id", *same).agg(F.min("rank").alias("first"), sources.alias("sources"))
    return top(each, limit, F.asc("first")).withColumnRenamed("rank", "place").drop("first")

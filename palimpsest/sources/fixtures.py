"""The logical tables of a memory store, derived from the driver's Parquet tables by expressions only."""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import tokens
from ..schema import check


class Fixtures:
    """Lazily built tables over one folder."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.dir = spark, sf_dir

    def read(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.dir}/{name}.parquet")

    @cached_property
    def n_vectors(self) -> int:
        """One more than the greatest id of the embeddings."""
        return (self.read("embeddings").agg(F.max("vec_id")).first()[0] or 0) + 1

    @cached_property
    def n_sourced(self) -> int:
        """Conversations of the workspace that facts belong to."""
        return max(1, (self.read("conversations").agg(F.max("conv_id")).first()[0] or 0) // 3)

    @cached_property
    def messages(self) -> DataFrame:
        return check("messages", self.read("conversations").selectExpr(
            "conv_id * 1000 + turn AS message_id",
            "concat('conv_', lpad(CAST(conv_id AS STRING), 6, '0')) AS conversation_id",
            "concat('ws', conv_id % 3) AS workspace_id",
            "turn + 1 AS sequence_number",
            "CASE role WHEN 'user' THEN concat('user:u', conv_id % 10) WHEN 'assistant' THEN concat('agent:a', conv_id % 4) ELSE 'system:s0' END AS author_key",
            "role", "text AS content",
            "concat('r', conv_id * 1000 + turn) AS request_id",
            "TIMESTAMP_NTZ '2024-01-01 00:00:00' + make_dt_interval(0, CAST(conv_id AS INT), CAST(turn AS INT), 0) AS created_at",
            "(conv_id * 7 + turn) % 23 = 0 AS deleted",
            "concat('{\"importance\":', (conv_id + turn) % 10, CASE WHEN conv_id % 2 = 0 THEN ',\"belief\":\"oui\"' ELSE '' END, '}') AS metadata",
            "conv_id", "turn",
        ))

    @cached_property
    def conversations(self) -> DataFrame:
        rows = self.read("conversations").select("conv_id").distinct()
        return check("conversations", rows.selectExpr(
            "concat('conv_', lpad(CAST(conv_id AS STRING), 6, '0')) AS conversation_id",
            "concat('ws', conv_id % 3) AS workspace_id",
            "element_at(array('participants', 'workspace', 'private', 'explicit'), CAST(conv_id % 4 + 1 AS INT)) AS scope",
            "conv_id % 29 = 28 AS deleted", "conv_id",
        ))

    @cached_property
    def participants(self) -> DataFrame:
        rows = self.messages.where("role IN ('user', 'assistant')").select("conversation_id", F.col("author_key").alias("participant_key"), "conv_id").distinct()
        return check("participants", rows.selectExpr("conversation_id", "participant_key", "conv_id % 13 = 7 AND participant_key LIKE 'agent%' AS left"))

    @cached_property
    def units(self) -> DataFrame:
        vectors = self.read("embeddings").select("vec_id", "embedding")
        rows = self.messages.where("role IN ('user', 'assistant')").withColumn("vec_id", (F.col("conv_id") * 17 + F.col("turn")) % self.n_vectors).join(vectors, "vec_id")
        return check("units", rows.selectExpr(
            "message_id + 1000000000 AS unit_id", "workspace_id", "conversation_id", "message_id AS anchor_message_id",
            "greatest(1L, sequence_number - 2) AS start_sequence", "sequence_number AS end_sequence",
            "embedding", "NOT deleted AS active", "created_at AS updated_at",
        ))

    @cached_property
    def acl(self) -> DataFrame:
        closed = self.conversations.where("scope IN ('private', 'explicit')").select("conversation_id")
        rows = self.units.where("anchor_message_id % 5 = 0").join(closed, "conversation_id", "left_semi")
        return check("acl", rows.selectExpr("unit_id", "'agent:guest' AS principal_key", "'read' AS permission"))

    @cached_property
    def queries(self) -> DataFrame:
        rows = self.read("embeddings").where("vec_id % 100 = 0").selectExpr("vec_id AS query_id", "CAST(vec_id / 100 AS BIGINT) AS n", "embedding")
        words = self.read("conversations").where("turn = 0").selectExpr("conv_id AS n", "lower(get(split(text, ' '), 1)) AS query_text")
        return check("queries", rows.join(words, "n", "left").selectExpr(
            "query_id", "concat('ws', n % 3) AS workspace_id",
            "element_at(array('user:u4', 'agent:a1', 'agent:guest', 'user:u7'), CAST(n % 4 + 1 AS INT)) AS requester",
            "embedding", "query_text",
            "array(concat('nation:', n), concat('customer:', n + 1)) AS subjects",
        ))

    @cached_property
    def first_terms(self) -> DataFrame:
        """The queries, asking for the first term of their text alone as the SQL of the lexical list does; a text may hold several."""
        return self.queries.withColumn("query_text", F.get(tokens(F.col("query_text")), F.lit(0)))

    @cached_property
    def entities(self) -> DataFrame:
        def one(table: str, kind: str, key: str, name: str) -> DataFrame:
            return self.read(table).selectExpr(f"concat('{kind}:', {key}) AS entity_id", f"'{kind}' AS entity_type", f"{name} AS display_name")

        rows = one("region", "region", "r_regionkey", "r_name").unionByName(one("nation", "nation", "n_nationkey", "n_name")).unionByName(one("customer", "customer", "c_custkey", "c_name"))
        return check("entities", rows.selectExpr("entity_id", "'ws1' AS workspace_id", "entity_type", "entity_id AS canonical_key", "display_name"))

    @cached_property
    def relations(self) -> DataFrame:
        start = "TIMESTAMP_NTZ '2024-01-01 00:00:00'"
        nation = self.read("nation").selectExpr("concat('n', n_nationkey) AS relation_id", "concat('nation:', n_nationkey) AS source_entity_id", "'est_situe_a' AS relation_type", "concat('region:', n_regionkey) AS target_entity_id", "CAST(NULL AS STRING) AS target_literal", f"{start} AS observed_at", "false AS invalidated", "1.0D AS confidence", "CAST(n_nationkey AS BIGINT) AS k")
        customer = self.read("customer").selectExpr("concat('c', c_custkey) AS relation_id", "concat('customer:', c_custkey) AS source_entity_id", "'appartient_a' AS relation_type", "concat('nation:', c_nationkey) AS target_entity_id", "CAST(NULL AS STRING) AS target_literal", f"{start} AS observed_at", "false AS invalidated", "0.5D AS confidence", "c_custkey AS k")
        order = self.read("orders").selectExpr("concat('o', o_orderkey) AS relation_id", "concat('customer:', o_custkey) AS source_entity_id", "'a_pour_etat' AS relation_type", "CAST(NULL AS STRING) AS target_entity_id", "o_orderstatus AS target_literal", "CAST(o_orderdate AS TIMESTAMP_NTZ) AS observed_at", "o_orderkey % 17 = 0 AS invalidated", "1.0D / (1 + o_orderkey % 4) AS confidence", "o_orderkey AS k")
        rows = nation.unionByName(customer).unionByName(order)
        return check("relations", rows.selectExpr("*", "'ws1' AS workspace_id", "observed_at AS valid_from", "CAST(NULL AS TIMESTAMP_NTZ) AS valid_until"))

    @cached_property
    def relation_sources(self) -> DataFrame:
        place = f"(3 * (k % {self.n_sourced}) + 1) * 1000"
        named = self.relations.selectExpr("relation_id", f"{place} + k % 3 AS message_id")
        again = self.relations.where("k % 5 = 0").selectExpr("relation_id", f"{place} + (k + 1) % 3 AS message_id")
        live = self.messages.select("message_id")
        return check("relation_sources", named.unionByName(again).join(live, "message_id", "left_semi"))

    @cached_property
    def relation_vectors(self) -> DataFrame:
        """Vectors of every tenth fact."""
        vectors = self.read("embeddings").select("vec_id", "embedding")
        rows = self.relations.where("k % 10 = 0").select("relation_id", (F.col("k") * 7 % self.n_vectors).alias("vec_id"))
        return check("relation_vectors", rows.join(vectors, "vec_id").select("relation_id", "embedding"))

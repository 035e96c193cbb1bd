"""Candidate retrieval: dense and lexical top-k under the access rule, for a batch of queries at once."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import IntegerType, StructField, StructType

from ..functions.text import tokens
from ..functions.vector import dot, norm
from .access import bounded, grants, guard, like, reason, require_requester, with_access

#: Queries whose vectors go to a task at once; more are worked off in blocks of so many.
BLOCK = 4096


def latest_units(units: DataFrame) -> DataFrame:
    """The latest active unit of each anchor."""
    order = Window.partitionBy("anchor_message_id").orderBy(F.desc("updated_at"), F.desc("unit_id"))
    return units.where("active").withColumn("nth", F.row_number().over(order)).where("nth = 1").drop("nth")


def top(rows: DataFrame, k: int, *order: Column, by: str = "query_id") -> DataFrame:
    """The k first rows of each query, with rank from 1; the limit is applied before the shuffle too."""
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy(by).orderBy(*order))).where(F.col("rank") <= k)


def restrict(rows: DataFrame, conversations: list[str] | None = None, metadata: Column | None = None) -> DataFrame:
    """Optional restrictions, applied before any limit."""
    rows = rows if conversations is None else rows.where(F.col("conversation_id").isin(conversations))
    return rows if metadata is None else rows.where(metadata)


def require_dimension(rows: DataFrame, name: str, dim: int | None) -> DataFrame:
    """Fails on a vector of another dimension, rather than dropping it."""
    if dim is None:
        return rows
    ok = F.col(name).isNull() | (F.size(name) == dim)
    return rows.where(F.when(ok, F.lit(True)).otherwise(F.raise_error(F.concat(F.lit(f"{name} has not {dim} but "), F.size(name).cast("string"), F.lit(" numbers"))).cast("boolean")))


def readable_units(units: DataFrame, messages: DataFrame, conversations: DataFrame, seen: DataFrame, acl: DataFrame, queries: DataFrame, *, conversation_ids: list[str] | None = None, metadata: Column | None = None) -> tuple[DataFrame, DataFrame]:
    """Live units with a vector, and who may read which.

    The second: query_id, and either conversation_id with scope, or the unit_id of a grant (scope null) in no conversation
    that the query reads anyway. Access comes first, so no unit meets a query that may not read it.
    """
    live = restrict(messages.where(~F.col("deleted")), conversation_ids, metadata).select(F.col("message_id").alias("anchor_message_id"))
    own = guard(units.where("active AND embedding IS NOT NULL"), conversations).join(live, "anchor_message_id", "left_semi")
    own = own.select("unit_id", "workspace_id", "anchor_message_id", "conversation_id", "start_sequence", "end_sequence", "embedding")
    place = own.select("unit_id", "workspace_id", "conversation_id")
    by_grant = grants(acl, queries).join(place, "unit_id").join(bounded(queries, "query_id", "workspace_id"), ["query_id", "workspace_id"])
    by_grant = by_grant.join(seen.select("query_id", "conversation_id"), ["query_id", "conversation_id"], "left_anti")
    nothing = lambda kind: F.lit(None).cast(kind)
    rights = seen.select("query_id", "conversation_id", nothing(units.schema["unit_id"].dataType).alias("unit_id"), "scope")
    return own, rights.unionByName(by_grant.select("query_id", "conversation_id", "unit_id", nothing("string").alias("scope")))


def _paired(own: DataFrame, rights: DataFrame, *columns: str) -> DataFrame:
    """Units (columns) by query that may read them, with scope."""
    by_scope = own.select(*columns).join(rights.where("unit_id IS NULL").drop("unit_id"), "conversation_id")
    by_grant = own.select(*columns).join(rights.where("unit_id IS NOT NULL").drop("conversation_id"), "unit_id")
    return by_scope.select("query_id", "scope", *columns).unionByName(by_grant.select("query_id", "scope", *columns))


_UNIT = ("unit_id", "anchor_message_id", "conversation_id", "start_sequence", "end_sequence")


def dense_candidates(units: DataFrame, messages: DataFrame, conversations: DataFrame, seen: DataFrame, acl: DataFrame, queries: DataFrame, *, dim: int | None = None, **restrictions) -> DataFrame:
    """Every readable active unit with its cosine (6 decimals). All of them: for the best ones see dense_search."""
    own, rights = readable_units(units, messages, conversations, seen, acl, queries, **restrictions)
    own = require_dimension(own, "embedding", dim).withColumn("norm", norm(F.col("embedding")))
    asked = require_dimension(queries, "embedding", dim).select("query_id", F.col("embedding").alias("question"), norm(F.col("embedding")).alias("question_norm"))
    rows = _paired(own, rights, *_UNIT, "embedding", "norm").join(like(asked, queries), "query_id")
    score = F.round(F.try_divide(dot(F.col("embedding"), F.col("question")), F.col("norm") * F.col("question_norm")), 6)
    rows = rows.withColumn("raw_score", score).where(F.col("raw_score").isNotNull() & ~F.isnan("raw_score"))
    return rows.select("query_id", *_UNIT, "raw_score", reason(F.col("scope")).alias("access_reason"))


def dense_search(units: DataFrame, messages: DataFrame, conversations: DataFrame, seen: DataFrame, acl: DataFrame, queries: DataFrame, *, k: int = 20, dim: int | None = None, **restrictions) -> DataFrame:
    """The k best units of each query by cosine (6 decimals), exactly.

    Each unit is read once, with the list of queries that may read it; a task multiplies its units by a block of queries and
    passes on the k best of each query only, so what is shuffled are units and tops, never units times queries.
    """
    own, rights = readable_units(units, messages, conversations, seen, acl, queries, **restrictions)
    asked = require_dimension(require_requester(queries), "embedding", dim).where("embedding IS NOT NULL").select("query_id", "embedding")
    blocks = -(-asked.count() // BLOCK)
    scores = [_block_scores(own, rights, asked, b, blocks, k) for b in range(max(1, blocks))]
    rows = reduce(DataFrame.unionByName, scores).withColumn("raw_score", F.round("raw_score", 6))
    return top(rows, k, F.desc("raw_score"), F.asc("unit_id"))


def _block_scores(own: DataFrame, rights: DataFrame, asked: DataFrame, block: int, blocks: int, k: int) -> DataFrame:
    """The best units of one block of queries, some of them several times k."""
    chosen = F.pmod(F.xxhash64("query_id"), F.lit(max(1, blocks))) == block
    vectors = asked.where(chosen).collect()  # about BLOCK rows
    ids = [r.query_id for r in vectors]
    matrix = np.array([r.embedding for r in vectors], dtype=np.float64).reshape(len(ids), -1)
    kind = asked.schema["query_id"].dataType
    numbered = F.broadcast(asked.sparkSession.createDataFrame([(q, i) for i, q in enumerate(ids)], StructType([StructField("query_id", kind), StructField("q", IntegerType())])))
    scope = F.when(F.col("scope") == "workspace", 0).when(F.col("scope").isNotNull(), 1).otherwise(2)
    readers = rights.where(chosen).join(numbered, "query_id").select("conversation_id", "unit_id", F.struct("q", scope.alias("s")).alias("reader"))
    by_scope = readers.where("unit_id IS NULL").groupBy("conversation_id").agg(F.collect_list("reader").alias("readers"))
    by_grant = readers.where("unit_id IS NOT NULL").groupBy("unit_id").agg(F.collect_list("reader").alias("granted"))
    columns = [*_UNIT, "embedding"]
    rows = own.select(*columns).join(by_scope, "conversation_id", "left").join(by_grant, "unit_id", "left").where("readers IS NOT NULL OR granted IS NOT NULL")
    none = F.array().cast("array<struct<q:int,s:int>>")
    rows = rows.select(*columns, F.concat(F.coalesce("readers", none), F.coalesce("granted", none)).alias("readers"))
    names = ["query_id", *_UNIT, "raw_score", "access_reason"]
    id_type = to_arrow_type(kind)
    reasons = pa.array(["workspace_scope", "conversation_participant", "explicit_acl"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lengths = np.linalg.norm(matrix, axis=1)
        who = pa.array(ids, id_type)
        for b in batches:
            if not b.num_rows:
                continue
            flat = b.column(len(columns) - 1).flatten().to_numpy(zero_copy_only=False).astype(np.float64)
            if len(flat) != b.num_rows * matrix.shape[1]:
                raise ValueError(f"vectors of {matrix.shape[1]} numbers were asked for, units have others")
            u = flat.reshape(b.num_rows, -1)
            lists = b.column(len(columns))
            who_reads = lists.flatten()
            row = np.repeat(np.arange(b.num_rows), np.diff(lists.offsets.to_numpy()))
            q, s = (who_reads.field(c).to_numpy(zero_copy_only=False) for c in ("q", "s"))
            with np.errstate(invalid="ignore", divide="ignore"):
                score = (u @ matrix.T / np.linalg.norm(u, axis=1)[:, None] / lengths)[row, q]
            keep = ~np.isnan(score)
            row, q, s, score = row[keep], q[keep], s[keep], score[keep]
            unit = b.column(0).take(pa.array(row)).to_numpy(zero_copy_only=False)
            order = np.lexsort((unit, -np.round(score, 6), q))
            first = np.searchsorted(q[order], q[order])  # where the query's rows begin
            order = order[np.arange(len(order)) - first < k]
            at = pa.array(row[order])
            yield pa.RecordBatch.from_arrays([who.take(pa.array(q[order])), *(b.column(c).take(at) for c in range(len(_UNIT))), pa.array(score[order]), reasons.take(pa.array(s[order]))], names)

    types = ", ".join(f"{c} {own.schema[c].dataType.simpleString()}" for c in _UNIT)
    return rows.mapInArrow(run, f"query_id {kind.simpleString()}, {types}, raw_score double, access_reason string")


def inverted(messages: DataFrame) -> DataFrame:
    """(message_id, workspace_id, term, times): the inverted index of live messages."""
    rows = messages.where(~F.col("deleted")).select("message_id", "workspace_id", F.explode(tokens(F.col("content"))).alias("term"))
    return rows.groupBy("message_id", "workspace_id", "term").agg(F.count(F.lit(1)).alias("times"))


def lexical_search(units: DataFrame, messages: DataFrame, conversations: DataFrame, seen: DataFrame, acl: DataFrame, queries: DataFrame, *, k: int = 20, conversation_ids: list[str] | None = None, metadata: Column | None = None) -> DataFrame:
    """Messages with all terms of the query, by number of occurrences; a query without terms finds nothing."""
    asked = queries.select("query_id", "workspace_id", F.array_distinct(tokens(F.col("query_text"))).alias("terms")).where(F.size("terms") > 0)
    wanted = asked.select("query_id", "workspace_id", F.size("terms").alias("need"), F.explode("terms").alias("term"))
    wanted = like(wanted, queries)
    hits = inverted(messages).join(wanted, ["workspace_id", "term"]).groupBy("query_id", "message_id").agg(F.count(F.lit(1)).alias("n"), F.max("need").alias("need"), F.sum("times").cast("double").alias("raw_score"))
    hits = hits.where("n = need").select("query_id", "message_id", "raw_score")
    live = guard(restrict(messages.where(~F.col("deleted")), conversation_ids, metadata), conversations).select("message_id", "conversation_id", "sequence_number")
    own = latest_units(units).select(F.col("anchor_message_id").alias("message_id"), "unit_id", "start_sequence", "end_sequence")
    rows = with_access(hits.join(live, "message_id").join(own, "message_id", "left"), seen, acl, queries)
    rows = rows.select("query_id", "unit_id", F.col("message_id").alias("anchor_message_id"), "conversation_id", F.coalesce("start_sequence", "sequence_number").alias("start_sequence"), F.coalesce("end_sequence", "sequence_number").alias("end_sequence"), "raw_score", "access_reason", "sequence_number")
    return top(rows, k, F.desc("raw_score"), F.desc("sequence_number"), F.asc("anchor_message_id"))


def dense_shape(candidates: DataFrame) -> DataFrame:
    """Best and upper median score of each query."""
    best = candidates.groupBy("query_id").agg(F.sort_array(F.collect_list("raw_score")).alias("s"))  # at most k scores a query
    return best.select("query_id", F.element_at("s", -1).alias("best"), F.element_at("s", (F.size("s") / 2).cast("int") + 1).alias("median"))


def no_answer(candidates: DataFrame, best_below: float, spread_below: float) -> DataFrame:
    """candidates without those of queries that nothing answers: low best score, close to the median."""
    shape = dense_shape(candidates).where((F.col("best") < best_below) & (F.col("best") - F.col("median") < spread_below))
    return candidates.join(shape.select("query_id"), "query_id", "left_anti")

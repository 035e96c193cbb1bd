"""Parameters of retrieval, with their defaults, and the columns of the logical tables."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame


@dataclass(frozen=True)
class Config:
    dense_top_k: int = 20
    lexical_top_k: int = 20
    graph_top_k: int = 20
    final_top_k: int = 8
    rerank_pool: int = 16
    max_memory_tokens: int = 2000
    chars_per_token: int = 4
    expand_before: int = 2
    expand_after: int = 2
    rrf_k: int = 60
    minimum_dense_score: float = 0.45
    minimum_score: float | None = None
    no_answer_best_below: float | None = None
    no_answer_spread_below: float | None = None
    fuse_graph: bool = False
    max_hops: int = 2
    max_seeds: int = 50
    sources_per_relation: int = 3
    similarity_threshold: float = 0.4
    previous_messages: int = 2
    max_chars: int = 1600
    extraction_batch: int = 12
    extraction_idle_s: int = 30
    single_valued: tuple[str, ...] = ("a_pour_etat",)
    indexed_roles: tuple[str, ...] = ("user", "assistant")


#: Columns that each logical table must have.
TABLES = {
    "messages": "message_id conversation_id workspace_id sequence_number author_key role content request_id created_at deleted metadata",
    "conversations": "conversation_id workspace_id scope deleted",
    "participants": "conversation_id participant_key left",
    "units": "unit_id workspace_id conversation_id anchor_message_id start_sequence end_sequence embedding active updated_at",
    "acl": "unit_id principal_key permission",
    "entities": "entity_id workspace_id entity_type canonical_key display_name",
    "relations": "relation_id workspace_id source_entity_id relation_type target_entity_id target_literal observed_at valid_from valid_until invalidated confidence",
    "relation_sources": "relation_id message_id",
    "relation_vectors": "relation_id embedding",
    "queries": "query_id workspace_id requester embedding query_text subjects",
}


WHOLE = {"tinyint", "smallint", "int", "bigint"}
TIME = {"timestamp", "timestamp_ntz"}
#: Types that a column may have, in every table; other columns (keys of the caller's) may have any.
KINDS = {
    "sequence_number": WHOLE, "start_sequence": WHOLE, "end_sequence": WHOLE, "deleted": {"boolean"}, "active": {"boolean"}, "left": {"boolean"}, "invalidated": {"boolean"},
    "created_at": TIME, "updated_at": TIME, "observed_at": TIME, "valid_from": TIME, "valid_until": TIME, "confidence": {"double", "float"},
    "embedding": {"array<float>", "array<double>"}, "subjects": {"array<string>"},
    **dict.fromkeys(("workspace_id", "conversation_id", "author_key", "role", "content", "scope", "participant_key", "principal_key", "permission", "relation_type", "target_literal", "metadata", "requester", "query_text"), {"string"}),
}


def check(name: str, df: DataFrame) -> DataFrame:
    """df, if it has the columns of the logical table in their types; a ValueError otherwise."""
    kinds = dict(df.dtypes)
    missing = [c for c in TABLES[name].split() if c not in kinds]
    if missing:
        raise ValueError(f"{name} lacks {', '.join(missing)}")
    wrong = [f"{c} is {kinds[c]}" for c in TABLES[name].split() if c in KINDS and kinds[c] not in KINDS[c]]
    if wrong:
        raise ValueError(f"{name}: {', '.join(wrong)}")
    return df

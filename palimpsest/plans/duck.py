"""The logical tables in DuckDB SQL, for the oracles."""

TABLES = r"""
messages AS (
  SELECT conv_id * 1000 + turn AS message_id, 'conv_' || lpad(conv_id::VARCHAR, 6, '0') AS conversation_id,
    'ws' || (conv_id % 3) AS workspace_id, turn + 1 AS sequence_number,
    CASE role WHEN 'user' THEN 'user:u' || (conv_id % 10) WHEN 'assistant' THEN 'agent:a' || (conv_id % 4) ELSE 'system:s0' END AS author_key,
    role, text AS content, 'r' || (conv_id * 1000 + turn) AS request_id,
    TIMESTAMP '2024-01-01 00:00:00' + to_hours(conv_id) + to_minutes(turn) AS created_at,
    (conv_id * 7 + turn) % 23 = 0 AS deleted,
    '{"importance":' || ((conv_id + turn) % 10) || CASE WHEN conv_id % 2 = 0 THEN ',"belief":"oui"' ELSE '' END || '}' AS metadata,
    conv_id, turn
  FROM conversations
), convs AS (
  SELECT DISTINCT 'conv_' || lpad(conv_id::VARCHAR, 6, '0') AS conversation_id, 'ws' || (conv_id % 3) AS workspace_id,
    ['participants', 'workspace', 'private', 'explicit'][(conv_id % 4 + 1)::INT] AS scope, conv_id % 29 = 28 AS deleted, conv_id
  FROM conversations
), participants AS (
  SELECT DISTINCT conversation_id, author_key AS participant_key, conv_id % 13 = 7 AND author_key LIKE 'agent%' AS "left"
  FROM messages WHERE role IN ('user', 'assistant')
), units AS (
  SELECT message_id + 1000000000 AS unit_id, workspace_id, conversation_id, message_id AS anchor_message_id,
    greatest(1, sequence_number - 2) AS start_sequence, sequence_number AS end_sequence, embedding, NOT deleted AS active, created_at AS updated_at
  FROM messages JOIN embeddings ON vec_id = (conv_id * 17 + turn) % (SELECT max(vec_id) + 1 FROM embeddings) WHERE role IN ('user', 'assistant')
), acl AS (
  SELECT unit_id, 'agent:guest' AS principal_key, 'read' AS permission FROM units
  WHERE anchor_message_id % 5 = 0 AND conversation_id IN (SELECT conversation_id FROM convs WHERE scope IN ('private', 'explicit'))
), queries AS (
  SELECT vec_id AS query_id, 'ws' || ((vec_id // 100) % 3) AS workspace_id,
    ['user:u4', 'agent:a1', 'agent:guest', 'user:u7'][((vec_id // 100) % 4 + 1)::INT] AS requester, embedding,
    lower(string_split(c.text, ' ')[2]) AS query_text, ['nation:' || (vec_id // 100), 'customer:' || (vec_id // 100 + 1)] AS subjects
  FROM embeddings LEFT JOIN conversations c ON c.conv_id = vec_id // 100 AND c.turn = 0 WHERE vec_id % 100 = 0
), entities AS (
  SELECT 'region:' || r_regionkey AS entity_id, 'ws1' AS workspace_id, 'region' AS entity_type, 'region:' || r_regionkey AS canonical_key, r_name AS display_name FROM region
  UNION ALL SELECT 'nation:' || n_nationkey, 'ws1', 'nation', 'nation:' || n_nationkey, n_name FROM nation
  UNION ALL SELECT 'customer:' || c_custkey, 'ws1', 'customer', 'customer:' || c_custkey, c_name FROM customer
), relations AS (
  SELECT *, 'ws1' AS workspace_id, observed_at AS valid_from, NULL::TIMESTAMP AS valid_until FROM (
    SELECT 'n' || n_nationkey AS relation_id, 'nation:' || n_nationkey AS source_entity_id, 'est_situe_a' AS relation_type, 'region:' || n_regionkey AS target_entity_id, NULL::VARCHAR AS target_literal, TIMESTAMP '2024-01-01' AS observed_at, false AS invalidated, 1.0::DOUBLE AS confidence, n_nationkey::BIGINT AS k FROM nation
    UNION ALL SELECT 'c' || c_custkey, 'customer:' || c_custkey, 'appartient_a', 'nation:' || c_nationkey, NULL, TIMESTAMP '2024-01-01', false, 0.5, c_custkey FROM customer
    UNION ALL SELECT 'o' || o_orderkey, 'customer:' || o_custkey, 'a_pour_etat', NULL, o_orderstatus, o_orderdate::TIMESTAMP, o_orderkey % 17 = 0, 1.0::DOUBLE / (1 + o_orderkey % 4), o_orderkey FROM orders)
), relation_sources AS (
  SELECT * FROM (
    SELECT relation_id, (3 * (k % (SELECT greatest(1, max(conv_id) // 3) FROM conversations)) + 1) * 1000 + k % 3 AS message_id FROM relations
    UNION ALL SELECT relation_id, (3 * (k % (SELECT greatest(1, max(conv_id) // 3) FROM conversations)) + 1) * 1000 + (k + 1) % 3 FROM relations WHERE k % 5 = 0)
  WHERE message_id IN (SELECT message_id FROM messages)
), relation_vectors AS (
  SELECT relation_id, embedding FROM relations JOIN embeddings ON vec_id = k * 7 % (SELECT max(vec_id) + 1 FROM embeddings) WHERE k % 10 = 0
), readable AS (
  SELECT q.query_id, c.conversation_id, c.scope FROM queries q JOIN convs c USING (workspace_id)
  WHERE NOT c.deleted AND (c.scope = 'workspace' OR (c.scope = 'participants' AND EXISTS (
    SELECT 1 FROM participants p WHERE p.conversation_id = c.conversation_id AND p.participant_key = q.requester AND NOT p."left")))
), dense_all AS (
  SELECT q.query_id, u.unit_id, u.anchor_message_id, u.conversation_id, u.start_sequence, u.end_sequence,
    round(list_cosine_similarity(u.embedding::DOUBLE[], q.embedding::DOUBLE[]), 6) AS raw_score,
    CASE WHEN r.scope = 'workspace' THEN 'workspace_scope' WHEN r.scope IS NOT NULL THEN 'conversation_participant' ELSE 'explicit_acl' END AS access_reason
  FROM queries q JOIN units u USING (workspace_id)
  JOIN messages m ON m.message_id = u.anchor_message_id AND NOT m.deleted
  JOIN convs c ON c.conversation_id = u.conversation_id AND c.workspace_id = q.workspace_id AND NOT c.deleted
  LEFT JOIN readable r ON r.query_id = q.query_id AND r.conversation_id = u.conversation_id
  WHERE u.active AND (r.conversation_id IS NOT NULL OR EXISTS (SELECT 1 FROM acl a WHERE a.unit_id = u.unit_id AND a.principal_key = q.requester AND a.permission = 'read'))
), dense AS (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY raw_score DESC, unit_id) AS rank FROM dense_all QUALIFY rank <= 20
), lexical_all AS (
  SELECT q.query_id, u.unit_id, m.message_id AS anchor_message_id, m.conversation_id,
    coalesce(u.start_sequence, m.sequence_number) AS start_sequence, coalesce(u.end_sequence, m.sequence_number) AS end_sequence,
    len(list_filter(regexp_extract_all(lower(m.content), '[\p{L}\p{N}]+'), lambda x: x = t.w))::DOUBLE AS raw_score,
    CASE WHEN r.scope = 'workspace' THEN 'workspace_scope' WHEN r.scope IS NOT NULL THEN 'conversation_participant' ELSE 'explicit_acl' END AS access_reason, m.sequence_number
  FROM queries q JOIN (SELECT query_id, regexp_extract_all(query_text, '[\p{L}\p{N}]+')[1] AS w FROM queries) t USING (query_id)
  JOIN messages m ON m.workspace_id = q.workspace_id AND NOT m.deleted
  JOIN convs c ON c.conversation_id = m.conversation_id AND c.workspace_id = q.workspace_id AND NOT c.deleted
  LEFT JOIN units u ON u.anchor_message_id = m.message_id AND u.active
  LEFT JOIN readable r ON r.query_id = q.query_id AND r.conversation_id = m.conversation_id
  WHERE list_contains(regexp_extract_all(lower(m.content), '[\p{L}\p{N}]+'), t.w)
    AND (r.conversation_id IS NOT NULL OR EXISTS (SELECT 1 FROM acl a WHERE a.unit_id = u.unit_id AND a.principal_key = q.requester AND a.permission = 'read'))
), lexical AS (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY raw_score DESC, sequence_number DESC, anchor_message_id) AS rank FROM lexical_all QUALIFY rank <= 20
), candidates AS (
  SELECT 0 AS list_idx, query_id, unit_id, anchor_message_id, conversation_id, start_sequence, end_sequence, raw_score, access_reason, rank FROM dense WHERE raw_score >= 0.1
  UNION ALL SELECT 1, query_id, unit_id, anchor_message_id, conversation_id, start_sequence, end_sequence, raw_score, access_reason, rank FROM lexical
), fused AS (
  SELECT query_id, anchor_message_id, arg_min(conversation_id, list_idx * 1000000 + rank) AS conversation_id,
    min(start_sequence) AS start_sequence, max(end_sequence) AS end_sequence,
    coalesce(sum(1.0::DOUBLE / (60 + rank)) FILTER (list_idx = 0), 0.0) + coalesce(sum(1.0::DOUBLE / (60 + rank)) FILTER (list_idx = 1), 0.0) AS score,
    min(rank) FILTER (list_idx = 0) AS dense_rank, min(rank) FILTER (list_idx = 1) AS lexical_rank,
    arg_min(access_reason, list_idx * 1000000 + rank) AS access_reason,
    arg_min(unit_id, list_idx * 1000000 + rank) FILTER (unit_id IS NOT NULL) AS unit_id,
    min(list_idx * 1000000 + rank) AS first_seen
  FROM candidates GROUP BY query_id, anchor_message_id
), marked AS (
  SELECT *, access_reason = 'explicit_acl' AS explicit,
    max(end_sequence) OVER (PARTITION BY query_id, conversation_id, access_reason = 'explicit_acl' ORDER BY start_sequence, score DESC, first_seen ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach
  FROM fused
), islands AS (
  SELECT *, sum(CASE WHEN reach IS NULL OR start_sequence > reach + 1 THEN 1 ELSE 0 END) OVER (PARTITION BY query_id, conversation_id, explicit ORDER BY start_sequence, score DESC, first_seen ROWS UNBOUNDED PRECEDING) AS island FROM marked
), merged AS (
  SELECT query_id, conversation_id, min(start_sequence) AS start_sequence, max(end_sequence) AS end_sequence, max(score) AS score,
    arg_min(anchor_message_id, [-score, start_sequence::DOUBLE, first_seen::DOUBLE]) AS anchor_message_id,
    arg_min(access_reason, [-score, start_sequence::DOUBLE, first_seen::DOUBLE]) AS access_reason,
    min(dense_rank) AS dense_rank, min(lexical_rank) AS lexical_rank
  FROM islands GROUP BY query_id, conversation_id, explicit, island
), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, conversation_id, start_sequence) AS rank FROM merged QUALIFY rank <= 8
), expanded AS (
  SELECT r.query_id, r.rank, r.conversation_id, r.anchor_message_id, r.access_reason, r.score, r.start_sequence AS core_from, r.end_sequence AS core_to,
    m.message_id, m.sequence_number, m.author_key, m.content, m.created_at, m.metadata,
    strlen(m.author_key) + 3 + strlen(m.content) + 1 AS bytes
  FROM ranked r JOIN messages m ON m.conversation_id = r.conversation_id AND NOT m.deleted
    AND m.sequence_number BETWEEN CASE WHEN r.access_reason = 'explicit_acl' THEN r.start_sequence ELSE greatest(0, r.start_sequence - 2) END
    AND CASE WHEN r.access_reason = 'explicit_acl' THEN r.end_sequence ELSE r.end_sequence + 2 END
)
"""


def oracle(body: str) -> str:
    """SQL of a query over the logical tables."""
    return f"WITH {TABLES.strip()}\n{body.strip()}"

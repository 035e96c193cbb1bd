import json

from pyspark.sql import functions as F

from palimpsest.operators import extraction as X
from palimpsest.sources import evaluation as E


def test_long_memories(spark, tmp_path):
    item = lambda k, kind: {"question_id": f"id{k}", "question_type": kind, "question": f"what {k}", "answer_session_ids": ["s2"], "haystack_dates": ["2023/05/20 (Sat) 02:21", "2023/05/21 (Sun) 10:00"], "haystack_session_ids": ["s1", "s2"], "haystack_sessions": [[{"role": "user", "content": "hi"}, {"role": "assistant", "content": " "}, {"role": "assistant", "content": "yo"}], []]}
    (tmp_path / "m.json").write_text(json.dumps([item(0, "a"), item(1, "a"), item(2, "b")]))
    messages, asked = E.long_memory(spark, str(tmp_path / "m.json"), 1)
    assert {(r.question_id, r.category) for r in asked.collect()} == {("id0", "a"), ("id2", "b")} and asked.first().sessions == ["s2"]
    rows = messages.where("workspace_id = 'q002'").orderBy("sequence_number").collect()
    assert [(r.conversation_id, r.sequence_number, r.author_key, r.content, str(r.created_at), r.session) for r in rows] == [
        ("q002_s000", 1, "user:user", "hi", "2023-05-20 02:21:00", "s1"),
        ("q002_s000", 2, "agent:assistant", "yo", "2023-05-20 02:23:00", "s1"),
    ]


def test_evidence_items(spark, tmp_path):
    folder = tmp_path / "changing_evidence"
    folder.mkdir()
    for name, n in (("b.json", 2), ("a.json", 1)):
        items = [{"question": f"{name}{k}", "conversations": [{"messages": [{"speaker": "User", "text": "x"}, {"speaker": "ASSISTANT", "text": "y"}]}] * 2, "message_evidences": [{"text": " X "}, {"text": "x"}]} for k in range(n)]
        (folder / name).write_text(json.dumps({"evidence_items": items}))
    messages, asked = E.evidence_items(spark, str(tmp_path), "changing_evidence", 2)
    assert [(r.question_id, r.text, r.evidence_texts) for r in asked.orderBy("question_id").collect()] == [("changing_000", "a.json0", ["x"]), ("changing_001", "b.json0", ["x"])]
    last = messages.orderBy(F.desc("conversation_id"), F.desc("sequence_number")).first()
    assert (last.conversation_id, last.role, str(last.created_at)) == ("changing_001_c01", "assistant", "2025-01-02 09:01:00")


def test_step_benchmark(spark, tmp_path):
    flat = {"message_list": [{"sid": 7, "user": "u", "assistant": "a", "time": "'2024-12-01 10:00' Sunday"}, {"user_message": "v", "assistant_message": ""}], "QA": {"question": "q1", "target_step_id": [[7, 0], []]}}
    nested = {"message_list": [[{"mid": 1, "user": "w"}], [{"mid": 2, "user": "z"}]], "QA": {"question": "q2", "target_step_id": None}}
    (tmp_path / "s.json").write_text(json.dumps({"other": [flat], "roles": [nested, {"message_list": [], "QA": {"question": ""}}], "movie": [flat]}))
    messages, asked = E.step_benchmark(spark, str(tmp_path / "s.json"), "simple")
    assert {r.question_id: r.steps for r in asked.collect()} == {"simple_movie_000": [7], "simple_roles_000": []}
    rows = messages.orderBy("conversation_id", "sequence_number").collect()
    assert [(r.conversation_id, r.content, r.step, r.role) for r in rows] == [("simple_movie_000_s00", "u", 7, "user"), ("simple_movie_000_s00", "a", 7, "assistant"), ("simple_movie_000_s00", "v", 1, "user"), ("simple_roles_000_s00", "w", 1, "user"), ("simple_roles_000_s01", "z", 2, "user")]
    assert str(rows[0].created_at) == "2024-12-01 10:00:00" and str(rows[3].created_at) == "2024-10-01 08:01:00"
    assert E.step_benchmark(spark, str(tmp_path / "s.json"), "simple", limit=1)[1].count() == 1


def test_extraction_is_converted(spark):
    messages = spark.createDataFrame([("c", k, f"line {k}" + (" Ana" if k == 14 else ""), k == 3) for k in range(1, 16)], "conversation_id string, sequence_number bigint, content string, deleted boolean")
    messages = messages.withColumn("message_id", F.col("sequence_number") + 100).withColumn("created_at", F.expr("TIMESTAMP_NTZ '2026-01-01 00:00:00' + make_dt_interval(0, 0, CAST(sequence_number AS INT), 0)"))
    windows = X.window_messages(X.with_context(messages, 12, 4))
    shown = {r.window: [(m.message_id, m.in_context) for m in r.messages] for r in windows.collect()}
    assert shown[0] == [(100 + k, False) for k in range(1, 14) if k != 3]
    assert shown[1] == [(110, True), (111, True), (112, True), (113, True), (114, False), (115, False)]
    entity = lambda t, name, **kw: {"temp_id": t, "entity_type": " Person ", "display_name": name, "aliases": ["ana", "elle", "A."], "resolved": True} | kw
    relation = lambda s, **kw: {"source_temp_id": s, "relation_type": "Lives In", "confidence": 3.0} | kw
    reply = {
        "entities": [entity("1", " Ana "), entity("2", "Ben", resolved=False), entity("3", "Cleo", canonical_key="person:known"), entity("4", "Dan", canonical_key="person:made-up"), entity("5", ""), entity("6", "...")],
        "relations": [
            relation("1", target_literal=" Rome ", observed_at="2026-02-01T00:00:00Z", source_message_ids=["115", "999", "x"]),
            relation("1", target_temp_id="2"), relation("2", target_temp_id="1"), relation("9", target_literal="x"), relation("1"),
            relation("1", target_temp_id="3", target_literal="both"), relation("3", target_literal="y", relation_type=" - "),
        ],
    }
    fenced = "```json\n" + json.dumps(reply) + "\n```"
    replies = X.parsed(spark.createDataFrame([("w", "c", 1, fenced), ("w", "c", 0, "sorry")], "workspace_id string, conversation_id string, window bigint, reply string"))
    assert {r.window: r.failed for r in replies.collect()} == {0: True, 1: False}
    known = spark.createDataFrame([("c", 1, "person:known")], "conversation_id string, window bigint, canonical_key string")
    found = X.entities(replies, known)
    keys = {r.temp_id: r.canonical_key for r in found.collect()}
    assert keys == {"1": "person:ana", "2": "unresolved-person:ben-c", "3": "person:known", "4": "person:dan"}
    assert found.where("temp_id = '1'").first().aliases == ["ana"]
    rows = {r.nth: r for r in X.relations(replies, found, windows).collect()}
    assert set(rows) == {0, 1, 2}
    assert rows[0].sources == [115] and str(rows[0].observed_at) == "2026-02-01 00:00:00" and rows[0].target_literal == "Rome" and rows[0].confidence == 1.0 and rows[0].relation_type == "lives_in"
    assert rows[1].sources == [114] and str(rows[1].observed_at) == "2026-01-01 00:14:00"  # the message that names Ana
    assert rows[2].sources == [114, 115]  # none names Ben
    text = windows.where("window = 1").select(X.candidate_text(windows).alias("t")).first().t
    assert text == "line 14 Ana\nline 15\n"

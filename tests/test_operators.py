import json
import random

import pytest
from pyspark.sql import functions as F

from palimpsest.operators import access, fusion, graph, ingest, models, search
from palimpsest.operators import jobs as work
from palimpsest.functions import french, similarity
from palimpsest.plans.search import Store, answer, candidates, excerpts, hybrid
from palimpsest.schema import Config, check
from palimpsest.sources import files
from palimpsest.streaming import ingest as stream


@pytest.fixture(scope="module")
def store(spark):
    ts = lambda df: df.withColumn("created_at", F.expr("TIMESTAMP_NTZ '2026-01-01 00:00:00' + make_dt_interval(0, 0, CAST(sequence_number AS INT), 0)"))
    m = [(100 + 10 * c + s, f"c{c}", "w", s, f"user:{'ab'[s % 2]}", "user", f"message {s} of {c} pomme", f"r{s}", s == 3 and c == 2, "{}") for c in range(5) for s in range(1, 5)]
    messages = ts(spark.createDataFrame(m, "message_id bigint, conversation_id string, workspace_id string, sequence_number bigint, author_key string, role string, content string, request_id string, deleted boolean, metadata string"))
    scopes = ["participants", "workspace", "private", "explicit", "workspace"]
    conversations = spark.createDataFrame([(f"c{c}", "w", s, c == 4) for c, s in enumerate(scopes)], "conversation_id string, workspace_id string, scope string, deleted boolean")
    participants = spark.createDataFrame([(f"c{c}", "user:a", False) for c in range(5)] + [("c0", "user:gone", True)], "conversation_id string, participant_key string, left boolean")
    units = messages.selectExpr("message_id + 1000 AS unit_id", "workspace_id", "conversation_id", "message_id AS anchor_message_id", "greatest(1L, sequence_number - 1) AS start_sequence", "sequence_number AS end_sequence", "CASE WHEN sequence_number = 4 THEN array(0f, 0f) ELSE array(CAST(sequence_number AS FLOAT), 1f) END AS embedding", "true AS active", "created_at AS updated_at")
    acl = spark.createDataFrame([(1000 + 100 + 21, "guest", "read"), (1000 + 100 + 32, "guest", "read"), (1000 + 100 + 41, "guest", "read"), (1000 + 100 + 22, "guest", "write")], "unit_id bigint, principal_key string, permission string")
    return Store(messages, conversations, participants, units, acl)


def queries(spark, *asked):
    rows = [(k, w, r, [1.0, 0.0], "pomme", []) for k, (w, r) in enumerate(asked)]
    return spark.createDataFrame(rows, "query_id int, workspace_id string, requester string, embedding array<double>, query_text string, subjects array<string>")


def test_scope_grants_and_guards(spark, store):
    q = queries(spark, ("w", "user:a"), ("w", "guest"), ("w", "user:gone"), ("other", "user:a"))
    seen = access.readable(store.conversations, store.participants, q)
    assert {(r.query_id, r.conversation_id) for r in seen.collect()} == {(0, "c0"), (0, "c1"), (1, "c1"), (2, "c1")}
    found = search.dense_candidates(store.units, store.messages, store.conversations, seen, store.acl, q).collect()
    guest = {(r.anchor_message_id, r.access_reason) for r in found if r.query_id == 1}
    assert {x for x in guest if x[1] == "explicit_acl"} == {(121, "explicit_acl"), (132, "explicit_acl")}
    assert all(r.anchor_message_id % 10 != 4 for r in found) and not any(r.query_id == 3 for r in found)  # zero vectors have no direction
    lexical = search.lexical_search(store.units, store.messages, store.conversations, seen, store.acl, q, k=3)
    assert {r["rank"] for r in lexical.where("query_id = 0").collect()} == {1, 2, 3}
    stemmed = models.stemmed_search(store.units, store.messages, store.conversations, seen, store.acl, q, k=50).collect()
    assert {(r.query_id, r.anchor_message_id) for r in stemmed} == {(r.query_id, r.anchor_message_id) for r in search.lexical_search(store.units, store.messages, store.conversations, seen, store.acl, q, k=50).collect()}


def test_every_strategy_checks_the_requester(spark, store):
    for name in ("dense", "lexical"):
        with pytest.raises(Exception, match="workspace and requester"):
            candidates(store, queries(spark, ("w", "")), Config(), (name,))[0][1].collect()
    with pytest.raises(ValueError, match="unknown"):
        candidates(store, queries(spark, ("w", "a")), Config(), ("sparse",))
    with pytest.raises(ValueError, match="lacks"):
        check("acl", store.units)
    with pytest.raises(ValueError, match="deleted is string"):
        check("messages", store.messages.withColumn("deleted", F.lit("no")))


def test_a_filter_never_adds_rows(spark, store):
    q = queries(spark, ("w", "user:a"))
    seen = access.readable(store.conversations, store.participants, q)
    args = (store.units, store.messages, store.conversations, seen, store.acl, q)
    every = {tuple(r) for r in search.dense_candidates(*args).collect()}
    some = {tuple(r) for r in search.dense_candidates(*args, conversation_ids=["c1"]).collect()}
    assert some < every and all(r[3] == "c1" for r in some)


def test_simultaneous_observations_and_masking(spark):
    at = lambda d: F.to_timestamp_ntz(F.lit(d))
    rows = spark.createDataFrame([("r1", "1", False), ("r2", "1", False), ("r3", "2", False), ("r4", "3", True)], "relation_id string, day string, invalidated boolean")
    rows = rows.withColumn("observed_at", F.to_timestamp_ntz(F.concat(F.lit("2026-01-0"), "day"))).selectExpr("*", "'w' AS workspace_id", "'e' AS source_entity_id", "'etat' AS relation_type", "CAST(NULL AS TIMESTAMP_NTZ) AS valid_until")
    chained = {r.relation_id: r.valid_until and r.valid_until.day for r in graph.chains(rows, ("etat",)).collect()}
    assert chained == {"r1": 2, "r2": 2, "r3": None, "r4": None}
    shown = rows.where("relation_id = 'r1'").selectExpr("1 AS query_id", "*").withColumn("valid_until", at("2026-01-02"))
    assert graph.mask(shown, rows).first().valid_until is None
    both = shown.unionByName(rows.where("relation_id = 'r3'").selectExpr("1 AS query_id", "*"))
    assert {r.relation_id: r.valid_until is not None for r in graph.mask(both, rows).collect()} == {"r1": True, "r3": False}
    assert graph.mask(shown.withColumn("valid_until", at("2026-01-09")), rows).first().valid_until is not None


def test_hops_are_exact(spark):
    edges = [("a", "b"), ("b", "c"), ("c", "d"), ("x", "a")]
    rel = spark.createDataFrame([(f"{s}{t}", s, t, False) for s, t in edges], "relation_id string, source_entity_id string, target_entity_id string, invalidated boolean")
    seed = spark.createDataFrame([(1, "a")], "query_id int, entity_id string")
    got = lambda n: {(r.entity_id, r.depth) for r in graph.reachable(seed, rel, n).collect()}
    assert got(1) == {("a", 0)} and got(2) == {("a", 0), ("b", 1), ("x", 1)} and got(3) == got(2) | {("c", 2)}
    assert {(r.relation_id, r.depth) for r in graph.facts(graph.reachable(seed, rel, 2), rel).collect()} == {("ab", 1), ("xa", 1), ("bc", 2)}


def test_unit_texts(spark, store):
    full = {r.anchor_message_id: r for r in ingest.build_units(store.messages, store.participants).collect()}
    text = full[103].embedding_text
    assert text.startswith("Conversation impliquant user:a.\n\nContexte précédent :\nuser:b : message 1") and text.endswith("Message principal :\nuser:b : message 3 of 0 pomme") and full[103].start_sequence == 1
    short = {r.anchor_message_id: r for r in ingest.build_units(store.messages, store.participants, Config(max_chars=118)).collect()}
    assert all(len(r.embedding_text.encode()) <= 118 for r in short.values()) and short[103].start_sequence == 3
    assert "Contexte" not in short[103].embedding_text
    tiny = ingest.build_units(store.messages, store.participants, Config(max_chars=20)).first()
    assert len(tiny.embedding_text.encode()) <= 20


def test_models_plug_in(spark, store):
    rows = models.embed(store.messages.select("message_id", "content"), "content", models.hash_embedder(8), "doc: ")
    assert rows.count() == store.messages.count() and len(rows.first().embedding) == 8
    with pytest.raises(Exception, match="vectors for"):
        models.embed(store.messages.select("content"), "content", lambda t: []).collect()
    pool = spark.createDataFrame([(1, "q", r, f"t{r}", 1.0 / r) for r in range(1, 5)] + [(2, "q", 1, "only", 1.0)], "query_id int, query_text string, rank int, content string, score double")
    out = models.rerank(pool, lambda q, texts: [3, 3, 99, 0], 3).orderBy("query_id", "rank").collect()
    assert [r.content for r in out] == ["t4", "t1", "t2", "only"] and [r.score for r in out] == [4.0, 3.0, 2.0, 1.0] and out[0].fusion_score == 0.25

    def broken(q, texts):
        raise RuntimeError

    assert [r.content for r in models.rerank(pool, broken, 2).orderBy("query_id", "rank").collect()] == ["t1", "t2", "only"]
    windows = models.extraction_windows(store.messages, 3)
    found = models.extract(windows, lambda text: [{"subject": "s", "relation_type": "r", "confidence": 7}, {"subject": ""}])
    assert found.count() == windows.count() and found.first().confidence == 1.0
    names = spark.createDataFrame([("w", "e1", "Paul"), ("w", "e2", "Zoé")], "workspace_id string, entity_id string, display_name string")
    texts = spark.createDataFrame([(1, "w", "Que cultive Paul ?")], "key int, workspace_id string, text string")
    assert [(r.entity_id, r.score) for r in models.similar_entities(names, texts).collect()] == [("e1", 1.0)]
    hits = spark.createDataFrame([("lexical", 1, 5), ("lexical", 2, 6), ("dense", 1, 7)], "strategy string, query_id int, anchor_message_id int")
    gold = spark.createDataFrame([(1, 5)], "query_id int, anchor_message_id int")
    assert {(r.strategy, r.queries, r.solved) for r in models.audit(hits, gold).collect()} == {("lexical", 2, 1), ("dense", 1, 0)}


def test_files(spark, tmp_path, monkeypatch):
    (tmp_path / "c.json").write_text(json.dumps({"conversations": [{"conversation_id": "c", "participants": ["a"], "messages": [{"author_key": "a", "role": "user", "content": "x", "id": "m1"}]}], "queries": [{"name": "q", "requester_key": "a", "query": "x", "expected_ids": ["m1"], "family": "lexical"}]}))
    messages, asked = files.corpus(spark, str(tmp_path / "c.json"))
    assert messages.first().sequence_number == 1 and messages.first().scope == "participants" and asked.first().expected_ids == ["m1"]
    (tmp_path / "l.json").write_text(json.dumps([{"sample_id": "s", "conversation": {"speaker_a": "A", "session_1": [{"speaker": "A", "dia_id": "D1:1", "text": "hi"}], "session_1_date_time": "x"}, "qa": [{"question": "?", "answer": "!", "evidence": ["D1:1"], "category": 1}]}]))
    turns, qa = files.sessions(spark, str(tmp_path / "l.json"))
    assert turns.first().text == "hi" and turns.count() == 1 and qa.first().evidence == ["D1:1"]
    rows = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string")
    assert [files.append_new(rows, str(tmp_path / "out"), "k"), files.append_new(rows, str(tmp_path / "out"), "k")] == [2, 0]
    monkeypatch.setenv("HOPS", "3")
    (tmp_path / "x.json").write_text('{"max_hops": ${HOPS}, "single_valued": ["a"]}')
    assert files.config(str(tmp_path / "x.json")).max_hops == 3
    (tmp_path / "y.json").write_text('{"max_hops": ${NOT_SET_ANYWHERE}}')
    with pytest.raises(KeyError):
        files.config(str(tmp_path / "y.json"))


def test_stream_drops_replays_and_closes_windows(spark, tmp_path):
    source = tmp_path / "in"
    source.mkdir()
    row = lambda c, s, minute: json.dumps({"conversation_id": c, "request_id": f"{c}{s}", "sequence_number": s, "author_key": "a", "content": "x", "created_at": f"2026-01-01T00:{minute:02d}:00Z"})
    parts = [[row("a", s, 0) for s in range(1, 6)] + [row("a", 1, 0), row("b", 1, 0)], [row("a", 6, 1), row("a", 2, 1)], [row("c", 1, 40)], [row("c", 2, 59)]]

    def run():
        frame = stream.debounced(stream.read(spark, str(source)), Config(extraction_batch=4))
        q = frame.writeStream.format("parquet").outputMode("append").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "check")).trigger(availableNow=True).start()
        q.awaitTermination(120)
        return [tuple(r) for r in spark.read.parquet(str(tmp_path / "out")).collect()]

    out = []
    for k, lines in enumerate(parts):
        (source / f"{k}.json").write_text("\n".join(lines))
        out = run()
    assert ("a", 1, 4, 4, "full") in out and ("a", 5, 6, 2, "idle") in out and ("b", 1, 1, 1, "idle") in out and len([x for x in out if x[0] != "c"]) == 3


@pytest.fixture(scope="module")
def graph_store(spark, store):
    entities = spark.createDataFrame([(f"e{k}", "w", "person", f"person:{n.lower()}", n) for k, n in enumerate(["Ana", "Ben", "Cleo", "Dan"])], "entity_id string, workspace_id string, entity_type string, canonical_key string, display_name string")
    rows = [("r1", "e0", "knows", "e1", None, 1), ("r2", "e1", "knows", "e2", None, 2), ("r3", "e2", "knows", "e3", None, 3), ("r4", "e0", "likes", None, "plums", 4)]
    rel = spark.createDataFrame(rows, "relation_id string, source_entity_id string, relation_type string, target_entity_id string, target_literal string, d int")
    at = F.make_timestamp_ntz(F.lit(2026), F.lit(1), "d", F.lit(0), F.lit(0), F.lit(0))
    rel = rel.withColumns({"workspace_id": F.lit("w"), "observed_at": at, "valid_from": at, "valid_until": F.lit(None).cast("timestamp_ntz"), "invalidated": F.lit(False), "confidence": F.lit(0.5)}).drop("d")
    sources = spark.createDataFrame([("r1", 101), ("r1", 102), ("r2", 113), ("r3", 112), ("r4", 104), ("r4", 121)], "relation_id string, message_id bigint")
    vectors = spark.createDataFrame([("r2", [1.0, 0.0]), ("r1", [0.0, 1.0])], "relation_id string, embedding array<double>")
    return Store(store.messages, store.conversations, store.participants, store.units, store.acl, entities, rel, sources, vectors)


def test_graph_is_a_strategy_with_facts_beside_results(spark, graph_store):
    q = queries(spark, ("w", "user:a")).withColumn("subjects", F.array(F.lit("user:Ana")))
    rows = candidates(graph_store, q, Config(), ("graph",))[0][1].orderBy("rank").collect()
    # the fact with the nearest vector leads, then the one with another vector, then those without
    assert [(r.anchor_message_id, r.raw_score) for r in rows] == [(113, 0.5), (102, 1.0), (101, 1.0), (104, 1.0)]
    assert rows[0].entities == ["Ben", "Cleo"] and rows[3].entities == ["Ana", "plums"]
    full = answer(graph_store, q, Config(minimum_dense_score=-1.0, fuse_graph=True, graph_top_k=2))
    facts = full.facts.orderBy("place").collect()
    assert [(f.relation_id, f.sources) for f in facts] == [("r2", [113]), ("r1", [102])]  # limited by rows, then by facts
    results = full.results.collect()
    assert results and all(r.source_type == "original_messages" and "final" not in r.asDict() for r in results)
    assert all((r.participants is None) == (r.access_reason == "explicit_acl") for r in results)
    text = full.context.first().block
    assert text.index(fusion.FACTS_TITLE) < text.index("- Ben knows Cleo (observé le 2026-01-02, valable depuis le 2026-01-02)") < text.index("source: ")
    only = answer(graph_store, q, Config(minimum_dense_score=-1.0), strategies=("lexical", "graph"), conversation_ids=["c1"])
    assert {f.relation_id for f in only.facts.collect()} == {"r2"} and {r.conversation_id for r in only.results.collect()} == {"c1"}
    with pytest.raises(Exception, match="workspace and requester"):
        candidates(graph_store, queries(spark, ("w", "")), Config(), ("graph",))[0][1].collect()


def test_a_failing_strategy_does_not_fail_the_search(spark, store, tmp_path):
    spark.sparkContext.setCheckpointDir(str(tmp_path))
    broken = Store(store.messages, store.conversations, store.participants, store.units.withColumn("embedding", F.array(F.lit(1.0))), store.acl)
    q, errors = queries(spark, ("w", "user:a")), {}
    found = candidates(broken, q, Config(), errors=errors)
    assert [n for n, _ in found] == ["lexical"] and "numbers were asked for" in errors["dense"] and found[0][1].count() > 0
    with pytest.raises(RuntimeError, match="all strategies"):
        candidates(broken, q, Config(), ("dense",), errors={})
    with pytest.raises(Exception, match="numbers"):
        search.dense_candidates(broken.units, store.messages, store.conversations, access.readable(store.conversations, store.participants, q), store.acl, q, dim=2).collect()


def test_gate_pool_and_exclusions_in_the_plan(spark, store):
    q = queries(spark, ("w", "user:a"))
    low = Config(minimum_dense_score=-1.0, max_memory_tokens=10_000)
    both = lambda c: {n: r.count() for n, r in candidates(store, q, c)}
    gated = both(Config(minimum_dense_score=-1.0, no_answer_best_below=2.0, no_answer_spread_below=2.0))
    assert gated["dense"] == 0 < both(low)["dense"] and gated["lexical"] == both(low)["lexical"] > 0
    every = {r.message_id for r in excerpts(store, q, low).collect()}
    out = spark.createDataFrame([(0, 102)], "query_id int, message_id bigint")
    assert {r.message_id for r in excerpts(store, q, low, exclude=out).collect()} == every - {102}
    two = Config(minimum_dense_score=-1.0, max_memory_tokens=10_000, final_top_k=1, rerank_pool=8)
    plain = hybrid(store, q, two).collect()
    turned = hybrid(store, q, two, reranker=lambda question, texts: list(range(len(texts)))[::-1]).collect()
    assert len(plain) == len(turned) == 1 and plain[0].conversation_id != turned[0].conversation_id and turned[0].score > 1


def test_similar_entities_equal_a_comparison_of_all(spark):
    rng = random.Random(8)
    word = lambda: "".join(rng.choice("abcde") for _ in range(rng.randint(2, 6)))
    names = [(f"e{i:03}", "w", f"{word()} {word()}"[: rng.randint(2, 12)].strip(), i % 5) for i in range(150)]
    texts = [(k, "w", " ".join(word() for _ in range(8))) for k in range(12)] + [(99, "w", ""), (98, "other", names[0][2])]
    e = spark.createDataFrame([(*n[:3], [word()] if n[3] else None, n[3]) for n in names], "entity_id string, workspace_id string, display_name string, aliases array<string>, updated int")
    called = {r.entity_id: [r.display_name, *(r.aliases or [])] for r in e.collect()}
    e = e.withColumn("updated_at", F.timestamp_seconds("updated"))
    t = spark.createDataFrame(texts, "key int, workspace_id string, text string")
    got = {}
    for r in models.similar_entities(e, t, 0.4, 7).collect():
        got.setdefault(r.key, []).append((r.entity_id, round(r.score, 9)))
    for k, w, text in texts:
        scored = [(max(similarity.word_similarity(n, text) for n in called[i]), u, i) for i, ww, _, u in names if ww == w]
        best = sorted((x for x in scored if x[0] >= 0.4), key=lambda x: (-x[0], -x[1], x[2]))[:7]
        assert sorted(got.get(k, [])) == sorted((i, round(s, 9)) for s, _, i in best), k


def test_stemmed_search_equals_a_scan(spark, store):
    rng = random.Random(9)
    words = ["cheval", "chevaux", "pomme", "pommes", "jardin", "vert", "verte", "le", "manger", "mangeait"]
    said = [(100 + i, "c1", "w", i, "user:a", "user", " ".join(rng.choice(words) for _ in range(rng.randint(1, 6))), f"r{i}", False, "{}") for i in range(80)]
    m = spark.createDataFrame(said, "message_id bigint, conversation_id string, workspace_id string, sequence_number bigint, author_key string, role string, content string, request_id string, deleted boolean, metadata string").withColumn("created_at", F.expr("TIMESTAMP_NTZ '2026-01-01 00:00:00'"))
    asked = ["cheval pomme", "cheval or jardin", '"pommes vertes"', "pomme -jardin", "le", "", "manger verte cheval", "absent or pomme jardin"]
    q = spark.createDataFrame([(k, "w", "user:a", None, t, []) for k, t in enumerate(asked)], "query_id int, workspace_id string, requester string, embedding array<double>, query_text string, subjects array<string>")
    seen = access.readable(store.conversations, store.participants, q)
    got = {}
    for r in models.stemmed_search(store.units.where("false"), m, store.conversations, seen, store.acl, q, k=100).collect():
        got.setdefault(r.query_id, {})[r.anchor_message_id] = round(r.raw_score, 9)
    for k, t in enumerate(asked):
        want = {x[0]: round(s, 9) for x in said if (s := french.rank(x[6], t)) is not None}
        assert got.get(k, {}) == want, t


def test_pages_follow_each_other(spark, store):
    q = queries(spark, ("w", "user:a"), ("w", "guest"))
    args = (store.messages, store.units, store.conversations, access.readable(store.conversations, store.participants, q), store.acl, q)
    whole = {r.query_id: [] for r in q.collect()}
    for r in ingest.list_messages(*args, 100).orderBy("query_id", "rank").collect():
        whole[r.query_id].append((r.message_id, r.access_reason))
    assert len(whole[0]) == 8 and ("explicit_acl" in {x[1] for x in whole[1]}) and len(whole[1]) == len({x[0] for x in whole[1]})
    page = ingest.list_messages(*args, 3)
    last = page.where("rank = 3").select("query_id", F.col("created_at").alias("at"), F.col("message_id").alias("id"))
    second = ingest.list_messages(*args, 3, after=last).orderBy("query_id", "rank").collect()
    assert [r.message_id for r in second if r.query_id == 0] == [x[0] for x in whole[0][3:6]] and all(r.more for r in second if r.query_id == 0)
    some = ingest.list_messages(*args, 100, conversation_ids=["c1"]).where("query_id = 0").collect()
    assert {r.conversation_id for r in some} == {"c1"}


def test_clients(spark):
    rows = spark.createDataFrame([("a", "w", ["user:*"], "s1", None), ("b", "w", ["x"], "s2", None)], "label string, workspace_id string, identities array<string>, token string, revoked_at timestamp")
    stored = work.valid_clients(rows)
    assert "token" not in stored.columns
    gone = work.revoke(stored, spark.createDataFrame([("b",), ("b",)], "label string"), F.lit("2026-01-01").cast("timestamp"))
    asked = spark.createDataFrame([(1, "s1"), (2, "s2"), (3, ""), (4, "s3")], "key int, token string")
    found = work.resolve(gone, asked).collect()
    assert [(r.key, r.label) for r in found] == [(1, "a")]
    assert spark.createDataFrame([(["user:*"], "w", "w", "user:z"), (["user:*"], "w", "v", "user:z"), ([], "w", "w", "user:z")], "p array<string>, o string, w string, k string").select(access.authorised(*(F.col(c) for c in "powk"))).collect() == [(True,), (False,), (False,)]
    for bad in (("", "w", ["x"], "s"), ("a", None, ["x"], "s"), ("a", "w", [], "s"), ("a", "w", [""], "s"), ("a", "w", ["x"], "")):
        with pytest.raises(Exception, match="are required"):
            work.valid_clients(spark.createDataFrame([bad], "label string, workspace_id string, identities array<string>, token string")).collect()


def test_quantiles_equal_sorted_lists(spark):
    from palimpsest.operators import evaluate

    rng = random.Random(14)
    groups = {"a": [rng.random() * 100 for _ in range(3000)], "b": [float(rng.randint(0, 3)) for _ in range(777)], "c": [5.0], None: [1.0, 2.0]}
    df = spark.createDataFrame([(k, v) for k, vs in groups.items() for v in vs] + [("a", None)], "k string, v double")
    out = {r.k: r for r in evaluate.latency(df, "v", "k").collect()}
    for k, vs in groups.items():
        s = sorted(vs)
        at = lambda q: s[int(q * (len(s) - 1))]  # noqa: B023, E731
        assert (out[k].p50, out[k].p95, out[k].p99, out[k].max) == (at(0.5), at(0.95), at(0.99), s[-1])


def test_stemmed_search_reads_messages_once_and_joins_no_terms(spark, store):
    q = spark.createDataFrame([(1, "w", "user:a", None, "cheval", [])], "query_id int, workspace_id string, requester string, embedding array<double>, query_text string, subjects array<string>")
    m = spark.createDataFrame([(1, "c", "w", 1, False, "un cheval")], "message_id bigint, conversation_id string, workspace_id string, sequence_number bigint, deleted boolean, content string")
    seen = access.readable(store.conversations, store.participants, q)
    plan = models.stemmed_search(store.units, m, store.conversations, seen, store.acl, q)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("MapInArrow") == 1 and "PythonUDF" not in plan and "Generate" not in plan


def test_alike_names_are_compared_in_tasks_and_ties_kept(spark):
    """Very many names that differ little, among them equal ones, and no pairs of names and texts as rows."""
    rng = random.Random(5)
    rows = [(f"e{i:04d}", f"w{i % 2}", f"Customer#{rng.randrange(400):09d}", i % 5) for i in range(1500)]
    e = spark.createDataFrame(rows, "entity_id string, workspace_id string, display_name string, t int").selectExpr("entity_id", "workspace_id", "display_name", "IF(t = 0, NULL, timestamp_seconds(t)) AS updated_at")
    asked = [(k, f"w{k % 2}", f"customer {rng.randrange(400):09d}") for k in range(6)] + [(6, "w0", ""), (7, "w0", None)]
    t = spark.createDataFrame(asked, "key int, workspace_id string, text string")
    got = models.similar_entities(e, t, 0.4, 7)
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan
    by_key = {}
    for r in got.collect():
        by_key.setdefault(r.key, []).append((-r.score, r.entity_id))
    for k, place, text in asked:
        scored = [(-similarity.word_similarity(n, text or ""), -late, i) for i, w, n, late in rows if w == place]
        want = [(s, i) for s, _, i in sorted(scored)[:7] if -s >= 0.4]
        assert sorted(by_key.get(k, [])) == sorted(want)

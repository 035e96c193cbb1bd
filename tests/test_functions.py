import base64
import json
import random
import uuid

import pytest
from pyspark.sql import functions as F

from palimpsest.functions import french, similarity
from palimpsest.functions import text as T
from palimpsest.functions.filters import InvalidFilter, compile_filter, validate

DOCUMENTS = [
    {"kind": "memo", "pages": 12, "ratio": 0.25, "when": "1999-12-31", "open": False, "gone": None, "x.y": "dot", "quote'd": 3, "deep": {"a": 1}, "many": [1, 2]},
    {"kind": "Memo", "pages": 12.0, "ratio": "0.25", "when": 19991231, "open": "false", "é": "ü"},
    {"pages": -3, "kind": "", "gone": 0, "when": "2000-01-01T00:00:00Z", "big": 123456789012345678},
    {},
]
VALUES = ["memo", "", "2000-01-01", "dot", "ü", 12, 12.0, -3, 0, 0.25, 123456789012345678, True, False, None]
KEYS = ["kind", "pages", "ratio", "when", "open", "gone", "x.y", "quote'd", "é", "big", "nowhere", "deep", "many"]
NUMBER = (int, float)


def kind_of(v):
    return "bool" if isinstance(v, bool) else "number" if isinstance(v, NUMBER) else type(v).__name__


def holds(tree, document):
    """What a filter says of a document, read off its definition one predicate at a time."""
    if "all" in tree:
        return all(holds(t, document) for t in tree["all"])
    if "any" in tree:
        return any(holds(t, document) for t in tree["any"])
    there, mine, value, op = tree["key"] in document, document.get(tree["key"]), tree["value"], tree["op"]
    same = lambda v: there and kind_of(mine) == kind_of(v) and mine == v
    if op == "exists":
        return there == value
    if op in ("eq", "ne"):
        return same(value) == (op == "eq")
    if op == "in":
        return any(map(same, value))
    if not there or kind_of(mine) != kind_of(value):
        return False
    return {"lt": mine < value, "lte": mine <= value, "gt": mine > value, "gte": mine >= value}[op]


def leaves():
    for key in KEYS:
        for op in ("eq", "ne", "lt", "lte", "gt", "gte"):
            for v in VALUES:
                if op in ("eq", "ne") or kind_of(v) in ("number", "str"):
                    yield {"key": key, "op": op, "value": v}
        yield from ({"key": key, "op": "exists", "value": v} for v in (True, False))
        yield {"key": key, "op": "in", "value": VALUES[:6]}
        yield {"key": key, "op": "in", "value": VALUES[6:]}


def test_filters_over_json(spark):
    rng = random.Random(20)
    trees = rng.sample(list(leaves()), 220)
    trees += [{rng.choice(["all", "any"]): [rng.choice(trees[:220]), {rng.choice(["all", "any"]): rng.sample(trees[:220], 2)}]} for _ in range(60)]
    df = spark.createDataFrame([(i, json.dumps(d, ensure_ascii=False)) for i, d in enumerate(DOCUMENTS)], "i int, m string")
    for k in range(0, len(trees), 70):  # a plan for each part
        part = trees[k : k + 70]
        for row in df.select("i", *(compile_filter(t, "m").alias(f"c{n}") for n, t in enumerate(part))).collect():
            assert [(t, row[f"c{n}"]) for n, t in enumerate(part)] == [(t, holds(t, DOCUMENTS[row.i])) for t in part]
    assert df.where(compile_filter(None, "m")).count() == len(DOCUMENTS)
    others = spark.createDataFrame([(None,), ("[1]",), ("{}",), ("no json",)], "m string")
    ne, eq = {"key": "a", "op": "ne", "value": 1}, {"key": "a", "op": "eq", "value": 1}
    assert [tuple(r) for r in others.select(compile_filter(ne, "m"), compile_filter(eq, "m")).collect()] == [(True, False)] * 4


@pytest.mark.parametrize(
    "tree",
    [
        [], {"all": []}, {"all": [], "any": []}, {"key": "", "op": "eq", "value": 1}, {"key": "k" * 129, "op": "eq", "value": 1},
        {"key": "k", "op": "like", "value": 1}, {"key": "k", "op": "lt", "value": True}, {"key": "k", "op": "exists", "value": 1},
        {"key": "k", "op": "in", "value": []}, {"key": "k", "op": "in", "value": list(range(257))}, {"key": "k", "op": "eq"},
        {"all": [{"any": [{"all": [{"any": [{"key": "k", "op": "eq", "value": 1}]}]}]}]},
        {"all": [{"key": "k", "op": "eq", "value": i} for i in range(33)]},
    ],
)
def test_invalid_filters(tree):
    with pytest.raises(InvalidFilter):
        validate(tree)


def test_keys_and_bytes(spark):
    names = ["Café Noir!", "  A--b  ", "éte", "été 1", "...", "日本 x"]
    df = spark.createDataFrame([(n,) for n in names], "n string")
    got = [tuple(r) for r in df.select(T.slug(F.col("n")), T.relation_type(F.col("n")), T.uuid5(F.col("n")), T.length_prefixed(F.col("n"))).collect()]
    for n, (slug, kind, ident, prefixed) in zip(names, got):
        assert ident == str(uuid.uuid5(uuid.NAMESPACE_URL, n)) and prefixed == f"{len(n.encode())}:{n}"
        assert kind == slug.replace("-", "_")
    assert [g[0] for g in got] == ["café-noir", "a-b", "éte", "été-1", "", "日本-x"]
    cases = [(s, k) for s in ("aé€😀b", "", "plain") for k in range(-1, 14)]
    rows = spark.createDataFrame(cases, "s string, k int").select("s", "k", T.truncate_bytes(F.col("s"), F.col("k"))).collect()
    for s, k, t in rows:
        assert t == s.encode()[: max(0, k)].decode("utf-8", "ignore")
    lists = spark.createDataFrame([([],), (["a"],), (["a", "b"],), (["a", "b", "c"],)], "x array<string>")
    assert [r[0] for r in lists.select(T.join_french(F.col("x"))).collect()] == ["", "a", "a et b", "a, b et c"]
    fences = spark.createDataFrame([("```json\n{}\n```",), ("{}",)], "x string")
    assert [r[0] for r in fences.select(T.strip_fences(F.col("x"))).collect()] == ["{}", "{}"]


def cleaned(aliases):
    seen, out = set(), []
    for a in (x.strip(" ") for x in aliases):
        key = a.strip("'\u2019.,;:!?").lower()
        if len(key) >= 2 and key not in T.NO_ALIAS and key not in seen:
            seen.add(key)
            out.append(a)
    return out


def test_aliases_equal_a_loop(spark):
    rng = random.Random(6)
    pool = [" Ana ", "ana!", "ANA", "x", "?", "The", "it.", "qui", "«eux»", "eux", "ça", "l'", "mes", "PP7", "'du'", "RH", "y", "Leurs", "celui,", "Ben"]
    lists = [rng.sample(pool, rng.randint(0, len(pool))) for _ in range(60)]
    got = spark.createDataFrame([(k, x) for k, x in enumerate(lists)], "k int, x array<string>").select("k", T.clean_aliases(F.col("x")).alias("y")).collect()
    assert all(r.y == cleaned(lists[r.k]) for r in got) and any("eux" in r.y for r in got)


def test_query_texts_cursors_and_times(spark):
    m = "array<struct<author_key:string,content:string>>"
    rows = [("user:z", ["a", "b"], [(f"w{i}", f"t{i}") for i in range(6)], "why"), (None, None, [], "why"), ("", [], None, None)]
    got = [r[0] for r in spark.createDataFrame(rows, f"r string, s array<string>, m {m}, q string").select(T.query_text(*(F.col(c) for c in "rsmq"))).collect()]
    assert got[0] == "Demandeur : user:z\nSujet mentionné : a\nSujet mentionné : b\n\nContexte récent :\nw2 : t2\nw3 : t3\nw4 : t4\nw5 : t5\n\nQuestion actuelle :\nwhy"
    assert got[1] == "\nQuestion actuelle :\nwhy"
    rows = spark.createDataFrame([("2026-02-03 04:05:06.789", 17)], "t string, i bigint").select(F.to_timestamp_ntz("t").alias("t"), "i")
    back = rows.withColumn("c", T.cursor(F.col("t"), F.col("i"))).withColumn("p", T.parse_cursor(F.col("c"))).first()
    assert back.p.at == back.t and back.p.id == 17
    bad = ["", "%%", "abcd", base64.b64encode(b"2026|1").decode(), None]
    assert all(r.p is None for r in spark.createDataFrame([(b,) for b in bad], "c string").withColumn("p", T.parse_cursor(F.col("c"))).collect())
    times = ["2026-01-02T03:04:05Z", "2026-01-02T03:04:05.5+02:00", "2026-01-02", "2026-13-02T03:04:05Z", "", None]
    out = [r[0] for r in spark.createDataFrame([(t,) for t in times], "t string").select(F.date_format(T.parse_time(F.col("t")), "HH:mm:ss.S")).collect()]
    assert out == ["03:04:05.0", "01:04:05.5", None, None, None, None]
    assert spark.range(1).select(T.fact_text(F.lit("a"), F.lit("knows"), F.lit("b"))).first()[0] == "a knows b"
    keys = spark.range(1).select(T.canonical_key(F.lit(" Person "), F.lit("Ana B.")), T.unresolved_key(F.lit("person"), F.lit("Ana"), F.lit("c7"))).first()
    assert tuple(keys) == ("person:ana-b", "unresolved-person:ana-c7")


def plain_word_similarity(a, text):
    own, other = set(similarity.trigrams(a)), similarity.trigrams(text)
    stretches = [set(other[i:j]) for i in range(len(other)) for j in range(i + 1, len(other) + 1)]
    return max((len(own & x) / len(own | x) for x in stretches), default=0.0)


def test_trigrams():
    assert similarity.trigrams("Ab c") == ["  a", " ab", "ab ", "  c", " c "]
    assert similarity.similarity("word", "two words") == 4 / 11  # the published example of the method
    assert round(similarity.word_similarity("word", "two words"), 2) == 0.8
    rng = random.Random(2)
    word = lambda: "".join(rng.choice("abcé") for _ in range(rng.randint(1, 5)))
    for _ in range(200):
        a, text = " ".join(word() for _ in range(rng.randint(1, 2))), " ".join(word() for _ in range(rng.randint(0, 5)))
        assert abs(similarity.word_similarity(a, text) - plain_word_similarity(a, text)) < 1e-12, (a, text)


def test_french_search():
    text = "Les chevaux mangeaient des pommes vertes dans le jardin, le cheval mange une pomme"
    assert french.stem("chevaux") == french.stem("cheval") and french.stem("pommes") == french.stem("pomme")
    assert french.rank(text, "cheval pomme") and french.rank(text, "le la") is None and french.rank(text, "") is None
    assert french.rank(text, "cheval -jardin") is None and french.rank(text, "avion or pomme") and french.rank(text, '"pommes vertes"')
    assert french.rank(text, '"vertes pommes"') is None
    assert french.rank("pomme cheval", "cheval pomme") > french.rank("pomme rouge grande belle cheval", "cheval pomme")

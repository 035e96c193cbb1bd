import os
import random
import subprocess
import sys
from pathlib import Path

import numpy as np
from pyspark.sql import functions as F

from palimpsest.llm import language as L


def brute_phrases(text, sample):
    n, i = 0, 0
    while i < len(text):
        k = i + 1
        while k < len(text) and text[i : k + 1] in sample:
            k += 1
        i, n = k, n + 1
    return n


def test_phrases_equal_brute_force():
    rng = random.Random(3)
    letters = "abcdxyz "
    word = lambda n: "".join(rng.choice(letters) for _ in range(n))
    samples = {"one": [word(90), word(50)], "two": [word(120)]}
    model = L.fit(samples)
    texts = [L.normal(word(rng.randint(1, 200)) + "q") for _ in range(40)]
    got = model.phrases(texts)
    for n, name in enumerate(model.names):
        sample = "|".join(map(L.normal, samples[name]))
        for j, t in enumerate(texts):
            assert got[n, j] == brute_phrases(t, sample)


def test_long_texts_are_parsed_as_a_whole():
    model = L.fit({"a": ["abc" * 100]})
    assert model.phrases(["abc" * 1000])[0, 0] == 10  # phrases are longer than a stretch
    assert np.array_equal(model.phrases([]), np.zeros((1, 0)))
    rng = random.Random(5)
    stems = ["tion ", "the ", "ing", "er", "sch", "ü", "q"]
    samples = {"one": ["".join(rng.choice(stems) for _ in range(400))], "two": ["".join(rng.choice(stems[2:]) for _ in range(300))]}
    model = L.fit(samples)
    base = L.normal(samples["one"][0])
    texts = ["".join(rng.choice(stems) for _ in range(4000)), base, base * 4, base + "q " * 300 + base, "q" * 700, "x" * 600]
    texts = [L.normal(t) for t in texts]
    assert len(texts[0]) > 10_000
    got = model.phrases(texts)
    for n, name in enumerate(model.names):
        sample = "|".join(map(L.normal, samples[name]))
        assert [int(x) for x in got[n]] == [brute_phrases(t, sample) for t in texts]


def test_only_letters_count():
    assert L.normal("²½ Ⅷ 12 _") == "" and L.normal("x² Äß-é") == "x äß é"


def test_executors_need_not_have_the_library(tmp_path):
    code = f"""
import sys
sys.path.insert(0, {str(Path(L.__file__).parents[2])!r})
from pyspark.sql import SparkSession, functions as F
s = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "2").config("spark.checkpoint.dir", {str(tmp_path)!r}).getOrCreate()
from palimpsest.llm.language import identify
docs = s.createDataFrame([(1, "the thing", "en"), (2, "das ding", "de"), (3, "²", "en")], "doc_id bigint, text string, lang string")
print(sorted((r.doc_id, r.lang_pred) for r in identify(docs, F.lit(True)).collect()))
"""
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    out = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=120)
    assert "[(1, 'en'), (2, 'de'), (3, 'und')]" in out.stdout, out.stderr[-2000:]


def test_held_out_languages_and_edges(spark):
    rng = random.Random(8)
    stems = {"aa": ["tion", "the", "ing", "er"], "bb": ["keit", "ung", "sch", "ü"], None: ["zz"]}
    rows = []
    for i in range(240):
        lang = ("aa", "bb", None)[i % 3]
        rows.append((i, " ".join("".join(rng.choice(stems[lang]) for _ in range(3)) for _ in range(30)), lang, 1.5))
    rows += [(900, None, "aa", 0.0), (901, "", "aa", 0.0), (902, "12 -- 34", "bb", 0.0), (None, "KEIT ung", "bb", 0.0), (903, "tion " * 40_000, None, 0.0), (3, rows[3][1], "aa", 0.0)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, score double")
    out = L.identify(docs, F.col("doc_id") % 4 != 2).collect()
    by = {r.doc_id: r for r in out}
    assert len(out) == len(rows)
    assert all(by[i].lang_pred == ("aa", "bb")[i % 3] for i in range(240) if i % 3 < 2)
    assert [by[i].lang_pred for i in (900, 901, 902, None, 903)] == ["und", "und", "und", "bb", "aa"]
    assert all(0 <= r.score <= 1 for r in out)
    assert {r.lang_pred for r in L.identify(docs, F.lit(False)).collect()} == {"und"}
    assert L.identify(docs.where("false"), F.lit(True)).count() == 0

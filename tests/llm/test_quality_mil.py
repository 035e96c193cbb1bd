import math
import random

import numpy as np
from pyspark.sql import functions as F

from palimpsest.llm import quality_mil as Q


def test_gradient_equals_finite_differences():
    rng = np.random.default_rng(1)
    shapes = {"w": (Q.FEATURES, Q.HIDDEN), "b": (Q.HIDDEN,), "v": (Q.HIDDEN, Q.GATE), "u": (Q.HIDDEN, Q.GATE), "a": (Q.GATE,), "c": (Q.HIDDEN,), "d": (1,)}
    p = {k: rng.normal(0, 0.3, s) for k, s in shapes.items()}
    x, first, y = rng.normal(size=(7, Q.FEATURES)), np.array([0, 1, 5]), np.array([0.0, 1.0, 1.0])

    def loss(p):
        h, e, _, _ = Q._encode(x, p)
        total = 0.0
        for k, (i, j) in enumerate(((0, 1), (1, 5), (5, 7))):
            w = np.exp(e[i:j])
            o = 1 / (1 + np.exp(-((w / w.sum()) @ h[i:j] @ p["c"] + p["d"][0])))
            total -= (y[k] * np.log(o) + (1 - y[k]) * np.log(1 - o)) / 3
        return total

    g = Q._gradient(x, first, y, p)
    for k, s in shapes.items():
        at = tuple(rng.integers(0, n) for n in s)
        step = np.zeros(s)
        step[at] = 1e-5
        want = (loss(p | {k: p[k] + step}) - loss(p | {k: p[k] - step})) / 2e-5
        assert abs(g[k][at] - want) < 1e-6


def test_slices_of_long_texts_score_alike(monkeypatch):
    rng = np.random.default_rng(2)
    bags = [rng.normal(size=(int(rng.integers(1, 5)), Q.FEATURES)).astype(np.float32) + k % 2 for k in range(40)]
    model = Q.fit(bags, np.array([float(k % 2) for k in range(40)]), 0.5)
    whole = [model.score(b) for b in bags]
    monkeypatch.setattr(Q, "SLICE", 2)
    assert np.allclose(whole, [model.score(b) for b in bags])
    assert all((s > 0.5) == k % 2 for k, s in enumerate(whole))


def test_held_out_texts_and_edges(spark):
    rng = random.Random(4)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 8)))
    rows, labels = [], []
    for i in range(300):
        n = rng.randint(20, 300)
        rows.append((i, " ".join(word() + ("###" if i % 3 == 0 else "") for _ in range(n)), 2.0))
        labels.append((i, int(i % 3 != 0)))
    rows += [(900, None, 0.0), (901, "", 0.0), (902, " \n", 0.0), (None, "a### b###", 0.0), (903, "plain words " * 40_000, 0.0), (1, rows[1][1], 0.0)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, score double")
    lab = spark.createDataFrame([*labels, (5, 0), (6, None)], "doc_id bigint, quality int")
    out = Q.quality(docs, lab, F.col("doc_id") % 4 != 2).collect()
    by = {r.doc_id: r.score for r in out}
    assert len(out) == len(rows) and len({by[900], by[901], by[902]}) == 1
    held = [i for i in range(300) if i % 4 == 2]
    assert sum((by[i] >= 0.7) == (i % 3 != 0) for i in held) == len(held)
    assert by[903] >= 0.7 > by[None] and all(0 <= s <= 1 for s in by.values())
    assert {r.score for r in Q.quality(docs, lab.where("false"), F.lit(True)).collect()} == {0.5}
    assert Q.quality(docs.where("false"), lab, F.lit(True)).count() == 0


def plain_features(text):
    """Features of every passage, counted character by character."""
    words, kinds = text.split(), []
    for b in text.encode():
        c = chr(b)
        table = [c in " \t\r\x0b\x0c", c == "\n", "a" <= c <= "z", "A" <= c <= "Z", "0" <= c <= "9", c == ".", c in ",;:", c == "!", c == "|", c in "#*$%&<>"]
        kinds.append(12 if 0x80 <= b < 0xC0 else 11 if b >= 0xC0 else table.index(True) if True in table else 10)
    passages, word, counts = [words[i : i + Q.WORDS] for i in range(0, len(words), Q.WORDS)] or [[]], -1, {}
    for i, k in enumerate(kinds):
        if k > 1 and (i == 0 or kinds[i - 1] <= 1):
            word += 1
        if i:
            counts.setdefault(max(word, 0) // Q.WORDS, []).append(kinds[i - 1] * Q.CLASSES + k)
    out = []
    for n, part in enumerate(passages):
        pairs = counts.get(n, []) if part else []
        row = [math.sqrt(pairs.count(p) / max(1, len(pairs))) for p in range(Q.CLASSES**2)]
        row += [len(set(part)) / len(part), sum(len(w.encode()) for w in part) / len(part) / 10, len(part) / Q.WORDS] if part else [0, 0, 0]
        out.append(row)
    return out


def plain_score(text, m):
    p, codes, weights = m.weights, [], []
    for row in plain_features(text):
        x = [(v - a) / s for v, a, s in zip(row, m.mean, m.spread)]
        h = [math.tanh(sum(v * p["w"][i, j] for i, v in enumerate(x)) + p["b"][j]) for j in range(Q.HIDDEN)]
        gate = lambda name, f: [f(sum(v * p[name][i, j] for i, v in enumerate(h))) for j in range(Q.GATE)]  # noqa: B023, E731
        both = [t * s for t, s in zip(gate("v", math.tanh), gate("u", lambda z: 1 / (1 + math.exp(-z))))]
        codes.append(h)
        weights.append(math.exp(sum(g * a for g, a in zip(both, p["a"]))))
    mean = [sum(w * h[j] for w, h in zip(weights, codes)) / sum(weights) for j in range(Q.HIDDEN)]
    return 1 / (1 + math.exp(-(sum(v * c for v, c in zip(mean, p["c"])) + p["d"][0] + m.shift)))


def test_scores_equal_a_plain_computation(spark):
    rng = random.Random(4)
    word = lambda: "".join(rng.choice("abcdé") for _ in range(rng.randint(1, 7)))
    rows = []
    for i in range(60):
        w = [word() + (rng.choice("#|!") if i % 2 else rng.choice(["", ".", ","])) for _ in range(rng.randint(1, 200))]
        rows.append((i, "".join(x + rng.choice([" ", " ", "\n"]) for x in w), i % 2))
    rows.append((60, "  ", 1))
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, quality int")
    train = F.col("doc_id") % 4 != 2
    model = Q.learn(docs, docs.select("doc_id", "quality"), train)
    got = {r.doc_id: r.score for r in Q.quality(docs, docs.select("doc_id", "quality"), train).collect()}
    for i, t, _ in rows:
        assert abs(got[i] - plain_score(t, model)) < 1e-4, i


def test_the_fit_sees_a_bounded_part_of_long_texts():
    bag = np.arange(1000)[:, None]
    part = Q.spread(bag)
    assert len(part) == Q.PASSAGES and part[0] == 0 and part[-1] == 999 and len(Q.spread(bag[:5])) == 5

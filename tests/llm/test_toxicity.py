import itertools
import random

from pyspark.sql import functions as F

from palimpsest.llm import toxicity as T


def brute_segments(values):
    """Ruzzo and Tompa's definition: take the best segment, then recurse on both sides of it."""

    def go(a, b):
        best = max(((sum(values[i:j]), -(j - i), -i, i, j) for i in range(a, b) for j in range(i + 1, b + 1)), default=(0,))
        if best[0] <= 0:
            return []
        return go(a, best[3]) + [(best[3], best[4], best[0])] + go(best[4], b)

    return go(0, len(values))


def test_segments_equal_the_recursive_definition():
    rng = random.Random(3)
    for _ in range(200):
        values = [rng.choice([-7, -3, -2, -1, 1, 2, 5]) + rng.randint(0, 999) / 4096 for _ in range(rng.randint(0, 25))]
        got, want = T.segments(values), brute_segments(values)
        assert [x[:2] for x in got] == [x[:2] for x in want]


def test_held_out_texts_and_edge_cases(spark):
    rng = random.Random(5)
    clean = ["".join(rng.choice("abcdefgh") for _ in range(4)) for _ in range(300)]
    rows, labels = [], []
    for i in range(400):
        w = [rng.choice(clean) for _ in range(rng.randint(20, 80))]
        if i % 5 == 0:
            for k in range(3):
                w.insert(rng.randint(0, len(w)), rng.choice(["vileword", "badly", "horridness"]))
        rows.append((i, " ".join(w), "x"))
        labels.append((i, int(i % 5 == 0)))
    rows += [(1000, None, "x"), (1001, "", "x"), (1002, "12 !!", "x"), (None, "badly badly vileword", "x"), (7, rows[7][1], "x"), (1003, "quiet " * 60_000, "x")]
    labels += [(0, 0), (1, None)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, score string")
    lab = spark.createDataFrame(labels, "doc_id bigint, toxic int")
    out = T.toxicity(docs, lab, F.col("doc_id") % 3 != 1).collect()
    assert len(out) == len(rows)
    by = {r.doc_id: r for r in out}
    held = [i for i in range(400) if i % 3 == 1]
    assert all((by[i].score >= 0.7) == (i % 5 == 0) for i in held)
    assert by[None].score >= 0.7 and by[None].passages[0].start == 0
    assert len({by[i].score for i in (1000, 1001, 1002, 1003)}) == 1 and by[1000].score < 0.7
    assert all(r.passages for r, i in itertools.product([by[5]], [0]))
    none = T.toxicity(docs, lab.where("toxic = 0"), F.lit(True))
    assert none.where("score >= 0.7").count() == 0
    assert T.toxicity(docs.where("false"), lab, F.lit(True)).count() == 0


def test_wrong_labels_do_not_hide_toxic_texts():
    clean = {0: 5000, 1: 2000, 2: 700, 3: 250, 4: 90, 5: 30}
    for scale in (1, 20, 400):
        levels = {k: n * scale for k, n in clean.items()}
        plain = T._kappa(levels, 10**6 * scale, 10**4 * scale)
        assert 0.001 < plain < 0.1
        assert T._kappa(levels | {60: 20 * scale, 200: 3 * scale}, 10**6 * scale, 10**4 * scale) < 3 * plain
    assert T._kappa({}, 0, 0) > 0

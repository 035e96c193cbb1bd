import random

from pyspark.sql import functions as F

from palimpsest.llm import mixing as M


def water(sizes, weights=(5, 2, 1), cap=3):
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    w = {s: weights[i % 3] for i, s in enumerate(names)}
    total, capped = sum(sizes.values()), set()
    while True:
        left = total - sum(cap * sizes[s] for s in capped)
        rest = sum(w[s] for s in names if s not in capped)
        share = {s: cap * sizes[s] if s in capped else left * w[s] / rest for s in names}
        over = {s for s in names if s not in capped and share[s] > cap * sizes[s]}
        if not over:
            return share
        capped |= over


def test_targets_equal_the_iteration(spark):
    rng = random.Random(2)
    for _ in range(8):
        sizes = {s: rng.choice([0, 1, 5, 50, 1000]) for s in ["b", "a", "é", "Z", None, "c", "d"][: rng.randint(1, 7)]}
        got = M.source_targets(spark.createDataFrame(list(sizes.items()), "source string, source_size bigint")).collect()
        want = water(sizes)
        assert all(abs(r.target - want[r.source]) < 1e-6 * max(1, want[r.source]) for r in got) and len(got) == len(sizes)


def test_words_taken_come_near_the_targets(spark):
    rng = random.Random(4)
    rows = [(i, "w " * rng.choice([0, 1, 10, 100, 900]), rng.choice(["a", "a", "a", "b", "c", None]), "x") for i in range(900)]
    rows += [(5, rows[5][1], "a", "x"), (None, None, "a", "x"), (901, "one two", "zz", "x")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, source string, copies string").repartition(5)
    plan = M.plan_mix(docs).collect()
    assert len(plan) == len(rows) and all(r.taken == r.size * r.copies and 0 <= r.copies <= 3 for r in plan)
    taken, target = {}, {}
    for r in plan:
        taken[r.source_size] = taken.get(r.source_size, 0) + r.taken
        target[r.source_size] = r.target
    assert all(abs(taken[s] - target[s]) <= 2700 for s in taken)
    assert sorted(map(str, plan)) == sorted(map(str, M.plan_mix(docs.repartition(2)).collect()))
    mixed = M.mix(docs)
    assert mixed.columns == docs.columns and mixed.count() == sum(r.copies for r in plan)
    assert M.plan_mix(docs.where("false")).count() == 0 and M.mix(docs.where("false")).count() == 0
    assert M.plan_mix(docs.withColumn("text", F.lit(""))).where("taken <> 0").count() == 0


def test_what_is_taken_does_not_depend_on_files(spark):
    rows = [(i % 50, "w " * (i % 7 + 1), f"s{i % 3}", i % 11) for i in range(400)] + [(7, "w", "s1", 7)] * 5
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, source string, n_chars int")
    got = [sorted(map(tuple, M.mix(docs.repartition(n)).collect())) for n in (1, 3, 7)]
    assert got[0] == got[1] == got[2] and set(got[0]) <= set(rows)
    plan = M.plan_mix(docs.withColumn("k", F.monotonically_increasing_id()), "k")
    assert len(got[0]) == plan.groupBy().sum("copies").first()[0]

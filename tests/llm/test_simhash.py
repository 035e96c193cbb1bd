import random
from itertools import combinations

import numpy as np
import xxhash
from pyspark.sql import functions as F

from palimpsest.llm import simhash
from palimpsest.llm.bitslice import clusters, within
from palimpsest.llm.components import components


def brute(values, radius):
    label = list(range(len(values)))

    def find(x):
        while label[x] != x:
            x = label[x]
        return x

    for i in range(len(values)):
        for j in range(i):
            if bin((values[i] ^ values[j]) & (1 << 64) - 1).count("1") <= radius:
                a, b = find(i), find(j)
                label[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(values))]


def near_values(rng, n):
    base = [rng.getrandbits(64) for _ in range(max(1, n // 8))]
    return sorted({rng.choice(base) ^ sum(1 << b for b in rng.sample(range(64), rng.randint(0, 5))) for _ in range(n)})


def test_bit_sliced_clusters_equal_brute_force():
    for seed in range(12):
        rng = random.Random(seed)
        values = near_values(rng, rng.choice([1, 2, 63, 64, 65, 200]))
        for radius in (1, 2, 3, 5):
            got = clusters(np.zeros(len(values), dtype=int), np.array(values, dtype=np.uint64), radius)
            assert got.tolist() == brute(values, radius)


def test_pairs_within_a_radius_equal_brute_force():
    rng = np.random.default_rng(4)
    for n in (0, 1, 63, 64, 65, 500):
        a = rng.integers(0, 1 << 63, (n, 2), dtype=np.uint64)
        flips = rng.random((n, 128)) < rng.random((n, 1))
        b = a ^ np.packbits(flips, axis=1, bitorder="little").view("<u8").reshape(n, 2)
        apart = np.bitwise_count(a ^ b).sum(axis=1)
        for radius in (1, 3, 31, 44, 63):
            assert within(a, b, radius).tolist() == (apart <= radius).tolist()


def dense_family(rng, mask_bits, n):
    """Different values that agree on the given number of bits."""
    base, free = rng.getrandbits(64), rng.sample(range(64), 64 - mask_bits)
    return sorted({base ^ sum(1 << b for b in free if rng.random() < 0.3) for _ in range(n)})


def test_dense_families_lose_no_link(spark, monkeypatch):
    """Buckets of every level are hot."""
    monkeypatch.setattr(simhash, "BUCKET", 5)
    for seed, bits in enumerate((16, 32, 40, 44, 49, 55)):
        rng = random.Random(seed)
        values = dense_family(rng, bits, 60)
        fps = spark.createDataFrame([(simhash._signed(v),) for v in values], "fp bigint")
        roots = {r.node: r.root for r in components(simhash.links(fps)).collect()}
        groups = {}
        for v, w in zip(values, brute(values, 3)):
            groups.setdefault(w, set()).add(roots.get(simhash._signed(v), simhash._signed(v)))
        assert all(len(g) == 1 for g in groups.values()) and len({min(g) for g in groups.values()}) == len(groups), bits


def test_links_cut_hot_buckets_and_lose_none(spark, monkeypatch):
    monkeypatch.setattr(simhash, "BUCKET", 5)
    values = near_values(random.Random(7), 300)
    signed = [v - (1 << 64) if v >> 63 else v for v in values]
    fps = spark.createDataFrame([(v,) for v in signed], "fp bigint")
    roots = {r.node: r.root for r in components(simhash.links(fps)).collect()}
    want = brute(values, 3)
    groups = {}
    for v, w in zip(signed, want):
        groups.setdefault(w, set()).add(roots.get(v, v))
    assert all(len(g) == 1 for g in groups.values()) and len({min(g) for g in groups.values()}) == len(groups)


def test_hot_buckets_of_masks_that_are_not_cut_are_compared(spark, monkeypatch):
    monkeypatch.setattr(simhash, "BUCKET", 1)
    fifth = simhash.first_masks(2, 3)
    for _ in range(4):
        fifth = sorted({x for m in fifth for x in simhash._split(m, 4)})
    cut = np.array([m for m in fifth if bin(m).count("1") <= 48], dtype=np.uint64)
    # two fingerprints that differ in three bits and agree on no mask of the fifth level that is cut again
    apart = next((x for x in (sum(1 << b for b in c) for c in combinations(range(64), 3)) if (cut & np.uint64(x)).all()), None)
    assert apart is not None
    fps = spark.createDataFrame([(0,), (simhash._signed(apart),)], "fp bigint")
    assert {frozenset(r) for r in simhash.links(fps).collect()} == {frozenset((0, simhash._signed(apart)))}


def expected(text):
    w = (text or "").encode().lower().split()
    s = [b" ".join(w[i : i + 3]) for i in range(len(w) - 2)] or ([b" ".join(w)] if w else [])
    h = [xxhash.xxh64_intdigest(x, seed=42) for x in s]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_documents_with_nulls_ties_and_extra_columns(spark):
    text = " ".join(f"w{i}" for i in range(300))
    rows = [(5, text, 1), (3, text.upper(), 2), (9, text + " tail", 3), (1, "", 4), (2, None, 5), (2, None, 5), (None, "alone here", 6), (7, "É b\tc d" * 5000, 7)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, fp int")
    def signed(v):
        return v - (1 << 64) if v >> 63 else v

    want = [(d, signed(expected(t)), c) for (d, t, _), c in zip(rows, [3, 3, 3, 1, 1, 1, None, 7])]
    want[2] = (9, signed(expected(rows[2][1])), 3)
    out = [tuple(r) for r in simhash.near_duplicates(docs).collect()]
    assert sorted(map(str, out)) == sorted(map(str, want))
    assert simhash.near_duplicates(docs.where(F.lit(False))).count() == 0

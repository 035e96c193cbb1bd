import hashlib
import random
import re
from collections import Counter

import xxhash

from palimpsest.llm import fingerprint as P


def text(rng, n):
    w = ["".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 8))) for _ in range(n)]
    return "".join(x + rng.choice([" ", " ", " ", " ", "\n", "\n\n", "  "]) for x in w)


def test_equal_texts_and_only_those_have_equal_roots():
    rng = random.Random(1)
    seen = {}
    for _ in range(300):
        t = text(rng, rng.randint(0, 30))
        for v in (t, t + " ", t.replace(" ", "\n", 1), t.upper(), t[1:]):
            assert seen.setdefault(P.fingerprint(v.encode()), v) == v
    assert P.fingerprint(b"") == P.fingerprint(b"") and P.likeness(P.fingerprint(b""), P.fingerprint(b"a")) == 0


def test_likeness_and_location_of_edits():
    rng = random.Random(2)
    t = text(rng, 900)
    w = t.split(" ")
    k = 400
    changed = " ".join([*w[:k], "EDITED", *w[k + 1 :]])
    a, b = P.fingerprint(t.encode()), P.fingerprint(changed.encode())
    n = len(P._leaves(a[33:]))
    assert 0.97 < P.likeness(a, b) < 1 and P.likeness(a, a) == 1 and P.likeness(a, P.fingerprint(text(rng, 900).encode())) < 0.05
    spots = P.differing(a, b)
    assert spots and all(z - x <= 10 for x, z, _, _ in spots) and 0.3 * n < spots[0][0] < 0.75 * n
    assert P.differing(a, a) == [] and P.differing(a, P.fingerprint(b""))


def test_documents_equal_brute_force(spark):
    rng = random.Random(3)
    rows = [(i * 3, text(rng, rng.randint(0, 60)), "c") for i in range(150)]
    rows += [(1000, None, "c"), (1001, "", "c"), (1002, "é" * 7, "c"), (5000, "long " * 30_000, "c"), (300, rows[100][1], "c"), (None, "no key", "c")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, key string").repartition(7)
    for n in (1, 9):
        spark.conf.set("spark.sql.shuffle.partitions", n)
        got = sorted((tuple(r) for r in P.with_following(docs).collect()), key=str)
        ordered = sorted(((k, t or "") for k, t, _ in rows), key=lambda r: (r[0] is not None, r[0] or 0))
        want = []
        for i, (k, t) in enumerate(ordered):
            nxt = ordered[(i + 1) % len(ordered)][1]
            q = len(t) // 4
            new = t[: len(t) - q] + nxt[:q]
            fp, own, other = (P.fingerprint(x.encode()) for x in (t, new, nxt))
            want.append((k, len(t), hashlib.sha256(new.encode()).hexdigest(), fp, own, P.likeness(fp, own), P.likeness(fp, other)))
        assert got == sorted(want, key=str)
    spark.conf.set("spark.sql.shuffle.partitions", 4)
    assert P.with_following(docs.where("false")).count() == 0
    assert P.with_following(docs.where("doc_id = 30")).count() == 1
    assert P.fingerprints(docs).count() == len(rows)


def leaves_of(t):
    """The leaves of a text as texts."""
    out, now = [], ""
    for token in re.findall(r"[^ \t-\r]+[ \t-\r]*|^[ \t-\r]+", t):
        now += token
        if xxhash.xxh64_intdigest(token.encode()) % P.LEAF == 0 or "\n" in token:
            out.append(now)
            now = ""
    return out + ([now] if now else [])


def test_likeness_is_the_share_of_common_leaves():
    rng = random.Random(8)
    for _ in range(150):
        a = text(rng, rng.randint(1, 120))
        w = a.split(" ")
        i, j = sorted(rng.randrange(len(w) + 1) for _ in range(2))
        b = rng.choice([" ".join(w[:i] + w[j:]), " ".join(w[i:j] + w[:i] + w[j:]), a + a, a[len(a) // 3 :], text(rng, 40)])
        x, y = Counter(leaves_of(a)), Counter(leaves_of(b))
        want = 2 * (x & y).total() / max(1, x.total() + y.total())
        assert abs(P.likeness(P.fingerprint(a.encode()), P.fingerprint(b.encode())) - want) < 1e-12

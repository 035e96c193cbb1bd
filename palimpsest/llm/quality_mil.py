"""Quality classifier: attention-based multiple-instance learning.

A text is a bag of passages of `WORDS` words. Each passage is described by the frequencies of byte-class pairs (how
letters, digits, marks and spaces follow each other), its share of different words, word length and size, and encoded
by a tanh layer; gated attention (tanh times sigmoid) weighs the passages, and the weighted mean is scored by a logistic
unit. All weights are learnt together from document labels by gradient descent.

The sample for fitting has at most `SAMPLE` labelled training rows of each class, chosen by a hash of their keys, and of
each at most `PASSAGES` passages, evenly over the whole text; the score is corrected to the classes' shares among all training labels. Every passage of every text is scored.

Defined results: null, empty and wordless texts are one passage of zeros; with labels of one class only, or none, the
score is that class's smoothed share (0.5 without labels); of repeated labels the larger counts; repeated rows each
get a row; further columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import stage

WORDS = 64
SAMPLE = 2000
#: Passages of a sampled text that the fit sees, at most, evenly over the whole text; so a few very long texts do not fill the driver.
PASSAGES = 64
HIDDEN, GATE = 24, 12
EPOCHS, BATCH, RATE, DECAY = 40, 64, 0.01, 1e-4
#: Passages of one text that are encoded at a time.
SLICE = 4096

CLASSES = 13
_CLASS = np.full(256, 10, dtype=np.int64)
_CLASS[0x80:0xC0], _CLASS[0xC0:] = 12, 11
for _k, _chars in enumerate((b" \t\r\x0b\x0c", b"\n", bytes(range(97, 123)), bytes(range(65, 91)), b"0123456789", b".", b",;:", b"!", b"|", b"#*$%&<>")):
    _CLASS[list(_chars)] = _k
FEATURES = CLASSES * CLASSES + 3


def features(text: bytes) -> np.ndarray:
    """[passages, FEATURES] of a text."""
    words = text.split()
    n = -(-len(words) // WORDS)
    if not n:
        return np.zeros((1, FEATURES), dtype=np.float32)
    c = _CLASS[np.frombuffer(text, dtype=np.uint8)]
    begins = np.concatenate([[c[0] > 1], (c[1:] > 1) & (c[:-1] <= 1)])
    passage = np.maximum(np.cumsum(begins) - 1, 0) // WORDS
    pair = passage[1:] * CLASSES**2 + c[:-1] * CLASSES + c[1:]
    counts = np.bincount(pair, minlength=n * CLASSES**2)[: n * CLASSES**2].reshape(n, -1).astype(np.float32)
    out = np.empty((n, FEATURES), dtype=np.float32)
    out[:, :-3] = np.sqrt(counts / np.maximum(counts.sum(axis=1, keepdims=True), 1))
    for k in range(n):
        part = words[k * WORDS : (k + 1) * WORDS]
        out[k, -3:] = len(set(part)) / len(part), sum(map(len, part)) / len(part) / 10, len(part) / WORDS
    return out


@dataclass
class Model:
    mean: np.ndarray
    spread: np.ndarray
    weights: dict[str, np.ndarray]
    shift: float
    constant: float | None = None

    def score(self, bag: np.ndarray) -> float:
        if self.constant is not None:
            return self.constant
        top, total, sums = -math.inf, 0.0, np.zeros(HIDDEN)
        for k in range(0, len(bag), SLICE):  # a running softmax, so a long text needs no more memory
            h, e = _encode((bag[k : k + SLICE] - self.mean) / self.spread, self.weights)[:2]
            high = max(top, float(e.max()))
            w, old = np.exp(e - high), math.exp(top - high) if total else 0.0
            top, total, sums = high, total * old + w.sum(), sums * old + w @ h
        logit = sums @ self.weights["c"] / total + self.weights["d"][0] + self.shift
        return float(1 / (1 + np.exp(-np.clip(logit, -50, 50))))


def _encode(x: np.ndarray, p: dict[str, np.ndarray]) -> tuple[np.ndarray, ...]:
    """Codes, attention logits, and the two factors of the gate, for passages x."""
    h = np.tanh(x @ p["w"] + p["b"])
    t, s = np.tanh(h @ p["v"]), 1 / (1 + np.exp(-(h @ p["u"])))
    return h, (t * s) @ p["a"], t, s


def _gradient(x: np.ndarray, first: np.ndarray, y: np.ndarray, p: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
    """Gradient of the mean log loss over bags; first: where each bag begins in x."""
    size = np.diff(np.append(first, len(x)))
    owner = np.repeat(np.arange(len(first)), size)
    h, e, t, s = _encode(x, p)
    w = np.exp(e - np.maximum.reduceat(e, first)[owner])
    w /= np.add.reduceat(w, first)[owner]
    z = np.add.reduceat(w[:, None] * h, first)
    out = 1 / (1 + np.exp(-(z @ p["c"] + p["d"][0])))
    dlogit = (out - y) / len(y)
    dz = dlogit[:, None] * p["c"]
    toward = (dz[owner] * h).sum(axis=1)
    de = w * (toward - np.add.reduceat(w * toward, first)[owner])
    dgate = de[:, None] * p["a"]
    dt, ds = dgate * s * (1 - t * t), dgate * t * s * (1 - s)
    dh = (w[:, None] * dz[owner] + dt @ p["v"].T + ds @ p["u"].T) * (1 - h * h)
    return {"w": x.T @ dh, "b": dh.sum(axis=0), "v": h.T @ dt, "u": h.T @ ds, "a": (t * s).T @ de, "c": z.T @ dlogit, "d": np.array([dlogit.sum()])}


def fit(bags: list[np.ndarray], y: np.ndarray, share: float) -> Model:
    """share: that of label 1 among all training labels."""
    rows = np.concatenate(bags)
    mean, spread = rows.mean(axis=0), rows.std(axis=0) + 0.05
    bags = [((b - mean) / spread).astype(np.float64) for b in bags]
    rng = np.random.default_rng(0)
    shapes = {"w": (FEATURES, HIDDEN), "b": (HIDDEN,), "v": (HIDDEN, GATE), "u": (HIDDEN, GATE), "a": (GATE,), "c": (HIDDEN,), "d": (1,)}
    p = {k: rng.normal(0, 1 / math.sqrt(s[0]), s) if k not in "bd" else np.zeros(s) for k, s in shapes.items()}
    m, v = ({k: np.zeros(s) for k, s in shapes.items()} for _ in range(2))
    step = 0
    for epoch in range(EPOCHS):
        rate = RATE * (1 - epoch / EPOCHS)
        order = rng.permutation(len(bags))
        for k in range(0, len(order), BATCH):
            at = order[k : k + BATCH]
            sizes = [len(bags[i]) for i in at]
            g = _gradient(np.concatenate([bags[i] for i in at]), np.concatenate([[0], np.cumsum(sizes)[:-1]]), y[at], p)
            step += 1
            for n in p:
                d = g[n] + DECAY * p[n]
                m[n] = 0.9 * m[n] + 0.1 * d
                v[n] = 0.999 * v[n] + 0.001 * d * d
                p[n] = p[n] - rate * (m[n] / (1 - 0.9**step)) / (np.sqrt(v[n] / (1 - 0.999**step)) + 1e-8)
    sampled = y.mean()
    return Model(mean, spread, p, math.log(share / (1 - share)) - math.log(sampled / (1 - sampled)))


def spread(bag: np.ndarray) -> np.ndarray:
    """At most PASSAGES passages of a bag, evenly over the whole text: what the fit sees of a text. Scores use all of them."""
    return bag if len(bag) <= PASSAGES else bag[np.linspace(0, len(bag) - 1, PASSAGES).round().astype(np.int64)]


def learn(docs: DataFrame, labels: DataFrame, train: Column, key: str = "doc_id", text: str = "text") -> Model:
    """labels: key, quality."""
    known = labels.where(train & F.col("quality").isin(0, 1)).groupBy(key).agg(F.max("quality").cast("int").alias("quality"))
    known = stage(known.where(F.col(key).isNotNull()), "quality-labels")
    counts = {r.quality: r["count"] for r in known.groupBy("quality").count().collect()}
    good, bad = counts.get(1, 0), counts.get(0, 0)
    if not good or not bad:
        return Model(np.zeros(FEATURES), np.ones(FEATURES), {}, 0.0, (good + 0.5) / (good + bad + 1))
    order = F.xxhash64(F.col(key), F.lit(5))
    chosen = known.where("quality = 0").orderBy(order).limit(SAMPLE).unionByName(known.where("quality = 1").orderBy(order).limit(SAMPLE))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            made = [spread(features(t.as_py() or b"")).astype(np.float16).tobytes() for t in b.column(1).cast(pa.binary())]
            yield pa.RecordBatch.from_arrays([b.column(2), pa.array(made, pa.binary()), b.column(0)], ["quality", "bag", "o"])

    rows = docs.select(key, text).join(F.broadcast(stage(chosen, "quality-sample")), key)  # 2 * SAMPLE narrow rows
    made = rows.select(F.xxhash64(key, text).alias("o"), text, "quality").mapInArrow(run, "quality int, bag binary, o bigint").collect()
    made.sort(key=lambda r: r.o)
    if len({r.quality for r in made}) < 2:
        return Model(np.zeros(FEATURES), np.ones(FEATURES), {}, 0.0, (good + 0.5) / (good + bad + 1))
    bags = [np.frombuffer(bytes(r.bag), dtype=np.float16).reshape(-1, FEATURES).astype(np.float32) for r in made]
    return fit(bags, np.array([float(r.quality) for r in made]), good / (good + bad))


def quality(docs: DataFrame, labels: DataFrame, train: Column, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key and score of every row of docs."""
    model = learn(docs, labels, train, key, text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            score = [model.score(features(t.as_py() or b"")) for t in b.column(1).cast(pa.binary())]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(score, pa.float64())], [key, "score"])

    return docs.select(key, text).mapInArrow(run, f"`{key}` {docs.schema[key].dataType.simpleString()}, score double")

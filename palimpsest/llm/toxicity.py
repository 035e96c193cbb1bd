"""Toxicity by maximum-scoring segment search over token log-odds.

Learning: for every token of labelled texts, the number of toxic and clean texts it occurs in. A token's toxic
share has a Dirichlet prior centred on the share of its longest known prefix, that one on the next shorter,
down to the share of the corpus, so rare inflections borrow from their stem. A token's score is its own log-odds against
the corpus, positive or negative, less a small drift that every token pays. Outside known families the log-odds count
with the probability that the token's share differs from the corpus's at all (Chernoff bound against one in twice the
number of keys). Families are prefixes of several tokens that are nearly all toxic; they score unseen tokens. Tokens whose score differs from the drift by less than `LEAST` are left out of the
lexicon and get the drift; there is no other limit to it. A token in it needs about log(keys) / log(1 / share) labelled
texts, so it grows with the evidence, not with the vocabulary; it goes to the tasks as 12 bytes a token.

Scoring: all maximal scoring segments of the token scores in one linear scan. A segment of score S in n tokens has the
expected number of chance segments E = K n exp(-lambda S) (extreme-value theory). lambda solves sum p exp(lambda s) = 1 over
the tokens of clean texts; K is the least with which, at every level of lambda S that some segments of clean labelled texts
reach, no more of them are found than expected.
Segments with E below `EVALUE` are significant passages; -ln E of all with E < 1 add up to the evidence of the text. A
logistic curve over ln(1 + evidence), fitted to the labelled texts, gives the score; the logarithm keeps a few wrong labels of
strong texts from flattening it.

Counts cover every labelled training row.

Defined results: null, empty and wordless texts have no evidence and get the score at evidence 0; without
labels of both kinds every score is the share of toxic labels (0 without labels); of repeated labels the larger
counts; repeated rows each get a row; further columns are ignored.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import small, stage

TOKEN = re.compile(r"[^\W\d_]+")
PREFIXES = (3, 4, 5, 6, 7, 8)
#: Weight of the prior in texts.
PRIOR = 1.0
#: Nats by which the bound of a key must pass the number of keys to be as likely different as not.
MARGIN = 1.0
#: Tokens that share a prefix, and its toxic share, for it to stand for unseen tokens.
FAMILY, PURE = 3, 0.8
#: What every token pays, the least that a lexicon's token differs from that, and the highest score.
DRIFT, LEAST, TOP = -0.25, 0.01, 8.0
EVALUE = 0.05
#: Segments at a level for it to bear on K: so many, and this share of the clean texts. Fewer may be wrong labels.
ENOUGH, SHARE = 10, 1 / 400
#: Cells in which texts of like evidence are counted for the fit, for each unit of ln(1 + evidence).
CELLS = 16
#: Different tokens that a task counts before it passes them on, and of which it remembers the scores.
FLUSH, REMEMBER = 300_000, 200_000


@dataclass(frozen=True)
class Model:
    """keys: sorted hashes of tokens; scores: theirs; families: scores of prefixes; scale: lambda."""

    keys: np.ndarray
    scores: np.ndarray
    families: dict[str, float]
    scale: float


def token_key(token: str) -> int:
    return xxhash.xxh64_intdigest(token.encode("utf-8", "surrogatepass"))


class Scores(dict):
    """Token scores, filled in as tokens are met."""

    def __init__(self, model: Model):
        super().__init__()
        self.model = model

    def __missing__(self, token: str) -> float:
        if len(self) > REMEMBER:
            self.clear()
        m, key = self.model, np.uint64(token_key(token))
        at = int(np.searchsorted(m.keys, key))
        if at < len(m.keys) and m.keys[at] == key:
            value = float(m.scores[at])
        else:
            found = (m.families.get(token[:n]) for n in reversed(PREFIXES) if len(token) > n)
            value = next((x for x in found if x is not None), DRIFT)
        self[token] = value
        return value


def segments(values: list[float]) -> list[tuple[int, int, float]]:
    """All maximal scoring segments (first, after last, score) of values, in order, in linear time."""
    stack: list[tuple[int, int, float, float]] = []  # first, after last, sum before, sum at the end
    total = 0.0
    for i, v in enumerate(values):
        before, total = total, total + v
        if v <= 0:
            continue
        first, low, high = i, before, total
        while stack:
            k = len(stack) - 1
            while k >= 0 and stack[k][2] >= low:
                k -= 1
            if k < 0 or stack[k][3] >= high:
                break
            first, low = stack[k][0], stack[k][2]
            del stack[k:]
        stack.append((first, i + 1, low, high))
    return [(a, b, hi - lo) for a, b, lo, hi in stack]


def scan(text: str, scores: Scores, scale: float) -> tuple[int, list[tuple[int, int, float]]]:
    """Number of tokens, and all maximal segments: characters from, to, and lambda times their score."""
    low = text.lower()
    values = [scores[t] for t in TOKEN.findall(low)]
    if not values or max(values) <= 0:
        return len(values), []
    spots = [m.span() for m in TOKEN.finditer(low)]
    return len(values), [(spots[a][0], spots[b - 1][1], scale * s) for a, b, s in segments(values)]


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (text, toxic): for each token the toxic and the clean texts with it."""
    seen: tuple[Counter, Counter] = (Counter(), Counter())

    def out() -> pa.RecordBatch:
        tokens = list(seen[0] | seen[1])
        columns = [pa.array(tokens, pa.string()), pa.array([seen[1][t] for t in tokens], pa.int64()), pa.array([seen[0][t] for t in tokens], pa.int64())]
        return pa.RecordBatch.from_arrays(columns, ["token", "toxic", "clean"])

    for b in batches:
        for text, y in zip(b.column(0), b.column(1).to_pylist()):
            seen[y].update(set(TOKEN.findall((text.as_py() or "").lower())))
        if len(seen[0]) + len(seen[1]) > FLUSH:
            yield out()
            seen = (Counter(), Counter())
    yield out()


def _bound(hits: Column, all_: Column, share: float) -> Column:
    """Nats of the Chernoff bound on hits of all_ as far from this share, above or below."""
    q = hits / all_
    term = lambda a, b: F.when(a > 0, a * F.ln(a / b)).otherwise(0.0)
    return all_ * (term(q, F.lit(share)) + term(1 - q, F.lit(1 - share)))


def _scale(scored: list[tuple[float, float]]) -> float:
    """lambda > 0 with sum p exp(lambda s) = 1; scored: (share among tokens of clean texts, score) of positive scores."""
    positive = sum(p for p, _ in scored)
    if not positive:
        return 1.0

    def at(x: float) -> float:
        return (1 - positive) * math.exp(x * DRIFT) + sum(p * math.exp(x * s) for p, s in scored) - 1

    low, high = 1e-3, 1.0
    while at(high) < 0 and high < 64:
        high *= 2
    for _ in range(60):
        mid = (low + high) / 2
        low, high = (mid, high) if at(mid) < 0 else (low, mid)
    return low


def learn_lexicon(labelled: DataFrame) -> Model:
    """labelled: (text, toxic 0/1), every training row."""
    words = stage(labelled.mapInArrow(_counts, "token string, toxic bigint, clean bigint").groupBy("token").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean")), "toxicity-words")
    totals = words.agg(F.sum("toxic"), F.sum("clean"), F.count(F.lit(1))).collect()[0]
    toxic, clean, kinds = (x or 0 for x in totals)
    if not toxic or not clean:
        return Model(np.empty(0, dtype=np.uint64), np.empty(0, dtype=np.float32), {}, 1.0)
    share = toxic / (toxic + clean)
    base, need = math.log(share / (1 - share)), math.log(kinds * 2) + MARGIN
    prefix = F.explode(F.filter(F.array(*(F.when(F.length("token") > n, F.substring("token", 1, n)) for n in PREFIXES)), lambda x: x.isNotNull()))
    stems = words.select(prefix.alias("stem"), "toxic", "clean").groupBy("stem").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"), F.count(F.lit(1)).alias("family"))
    bound = _bound(F.col("toxic"), F.col("toxic") + F.col("clean"), share)
    heads = stems.where((F.col("family") >= FAMILY) & (F.col("toxic") >= PURE * (F.col("toxic") + F.col("clean")))).where(bound >= need)
    heads = small(stage(heads, "toxicity-families"))
    # log-odds are at most TOP each way, so keys of a smaller bound cannot differ from the drift by LEAST; those of a family can
    within = words.select("token", prefix.alias("stem")).join(heads.select("stem"), "stem", "left_semi").select("token").distinct().withColumn("family", F.lit(True))
    tokens = words.join(within, "token", "left").withColumn("bound", bound)
    tokens = tokens.where(F.col("family") | (F.col("bound") >= need - math.log(TOP / LEAST))).withColumnRenamed("token", "stem")

    shares: dict[str, float] = {}
    parent = lambda k: next((shares[k[:n]] for n in range(len(k) - 1, 2, -1) if k[:n] in shares), share)
    smooth = lambda r: min(1 - 1e-9, max(1e-9, (r.toxic + PRIOR * parent(r.stem)) / (r.toxic + r.clean + PRIOR)))
    odds = lambda s: max(-TOP, min(TOP, math.log(s / (1 - s)) - base))
    for r in sorted(heads.collect(), key=lambda r: len(r.stem)):
        shares[r.stem] = smooth(r)
    families = {k: odds(s) + DRIFT for k, s in shares.items() if odds(s) > 0}
    lexicon: dict[int, float] = {}
    chance: list[tuple[float, float]] = []
    for r in tokens.toLocalIterator():
        differs = 1.0 if r.family else 1 / (1 + math.exp(max(-50.0, min(50.0, need - r.bound))))
        score = differs * odds(smooth(r))
        if r.family or abs(score) >= LEAST:
            lexicon[token_key(r.stem)] = score + DRIFT
            chance.append(((r.clean + 0.05) / clean, score + DRIFT))
    keys = np.array(sorted(lexicon), dtype=np.uint64)
    return Model(keys, np.array([lexicon[int(k)] for k in keys], dtype=np.float32), families, _scale(chance))


def gather(docs: DataFrame, model: Model, key: str = "doc_id", text: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """key, the columns in keep, n_tokens and segments (characters from, to, lambda times score) of every row."""
    # plain values: a broadcast of the class itself would need the library on the executors
    shared = docs.sparkSession.sparkContext.broadcast((model.keys, model.scores, model.families, model.scale))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Model(*shared.value)
        scores = Scores(own)
        kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("s", pa.float64())]))
        for b in batches:
            found = [scan(t.as_py() or "", scores, own.scale) for t in b.column(1)]
            parts = [[{"start": a, "end": z, "s": s} for a, z, s in p] for _, p in found]
            yield pa.RecordBatch.from_arrays([*b.columns[:1], *b.columns[2:], pa.array([n for n, _ in found], pa.int64()), pa.array(parts, kind)], names)

    names = [key, *keep, "n_tokens", "segments"]
    kinds = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in (key, *keep))
    return docs.select(key, text, *keep).mapInArrow(run, f"{kinds}, n_tokens bigint, segments array<struct<start:int,end:int,s:double>>")


def _kappa(levels: dict[int, int], tokens: int, texts: int) -> float:
    """K with which no level of lambda S has more chance segments than expected. levels: segments of clean texts by whole lambda S."""
    most, above = 0.5 / (tokens + 1), 0
    for level in sorted(levels, reverse=True):
        above += levels[level]
        if above >= max(ENOUGH, SHARE * texts):
            most = max(most, above / (tokens + 1) * math.exp(min(level, 500)))
    return most


def _logistic(cells: list[tuple[float, int, int]]) -> tuple[float, float]:
    """Intercept and slope for cells (x, clean, toxic), by Newton steps with a weak ridge on the slope."""
    toxic, clean = sum(c[2] for c in cells), sum(c[1] for c in cells)
    a, b = math.log((toxic + 0.5) / (clean + 0.5)), 0.0
    if not toxic or not clean:
        return a, b
    for _ in range(100):
        g0 = g1 = h00 = h01 = h11 = 0.0
        for x, n0, n1 in cells:
            p = 1 / (1 + math.exp(-max(-30.0, min(30.0, a + b * x))))
            d, w = n1 - (n0 + n1) * p, max((n0 + n1) * p * (1 - p), 1e-9)
            g0, g1, h00, h01, h11 = g0 + d, g1 + d * x, h00 + w, h01 + w * x, h11 + w * x * x
        g1, h11, h00 = g1 - 0.01 * b, h11 + 0.01, h00 + 1e-6
        det = h00 * h11 - h01 * h01
        step = ((h11 * g0 - h01 * g1) / det, (h00 * g1 - h01 * g0) / det)
        size = max(1.0, abs(step[0]) / 2, abs(step[1]) / 2)
        a, b = a + step[0] / size, max(0.0, b + step[1] / size)
        if max(map(abs, step)) < 1e-9:
            break
    return a, b


def toxicity(docs: DataFrame, labels: DataFrame, train: Column, key: str = "doc_id", text: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """key, the columns in keep, score, evidence and passages (characters from, to, -ln E) of every row of docs.

    labels: key, toxic; train: which keys may be learnt from.
    """
    known = labels.where("toxic IS NOT NULL").where(train).groupBy(key).agg(F.max("toxic").cast("int").alias("toxic"))
    known = stage(known.where(F.col("toxic").isin(0, 1)), "toxicity-labels")
    model = learn_lexicon(docs.select(key, text).join(small(known), key).select(text, "toxic"))
    found = stage(gather(docs, model, key, text, keep), "toxicity-segments")
    labelled = found.join(small(known), key)
    clean = labelled.where("toxic = 0")
    size, texts = clean.agg(F.sum("n_tokens"), F.count(F.lit(1))).first()
    levels = clean.select(F.explode("segments.s").alias("s")).groupBy(F.floor("s").cast("int").alias("level")).count().collect()
    kappa = _kappa({r.level: r["count"] for r in levels}, size or 0, texts)
    # ln(1 / E) = lambda S - ln(K n)
    nats = F.transform("segments", lambda x: x["s"] - F.ln(F.lit(kappa) * F.greatest("n_tokens", F.lit(1))))
    evidence = F.aggregate(nats, F.lit(0.0), lambda acc, x: acc + F.greatest(x, F.lit(0.0)))
    passages = F.filter(
        F.zip_with("segments", nats, lambda x, e: F.struct(x["start"].alias("start"), x["end"].alias("end"), e.alias("evidence"))), lambda x: x["evidence"] > -math.log(EVALUE)
    )
    cell = F.floor(F.log1p("evidence") * CELLS)
    cells = labelled.withColumn("evidence", evidence).groupBy(cell).agg(F.avg(F.log1p("evidence")), F.count_if(F.col("toxic") == 0), F.count_if(F.col("toxic") == 1)).collect()
    a, b = _logistic([(r[1], r[2], r[3]) for r in sorted(cells)]) if cells else (-math.inf, 0.0)
    score = F.lit(0.0) if a == -math.inf else 1 / (1 + F.exp(-(F.lit(a) + F.lit(b) * F.log1p("evidence"))))
    return found.withColumn("evidence", evidence).select(key, *keep, score.alias("score"), "evidence", passages.alias("passages"))

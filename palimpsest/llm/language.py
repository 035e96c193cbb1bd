"""Language identification by cross-parsing entropy.

For each language a suffix automaton of labelled text recognises every substring of it. A text is parsed greedily into
the longest phrases that occur in the language's sample; the number of phrases, times the logarithm of the sample's length
and divided by the text's, estimates the cross-entropy, and the language of least entropy wins.

Automata are stored as dense transition tables, and many stretches of texts are parsed in step with array lookups. Each
stretch is parsed as if a phrase began with it; then every parse goes on into the next stretch until one of its phrases
begins where one of the next parse does, from where on both are the same. So the phrases counted are those of one parse of
the whole text; a text in which a parse does not meet the next one within a stretch is parsed from end to end.

The samples are bounded: of the labelled training rows of a language with at most `CHARS` characters, in order of a hash
of their keys, the first `ROWS` whole texts as long as their characters add up to `CHARS` at most; where a language has longer
texts only, its shortest one. Texts are lower-cased; everything but letters becomes a single space.

Defined results: null texts and texts without a letter are `und` with score 0, as is every text if nothing was
labelled; ties go to the first language by name; rows with null keys are scored but not learnt from; repeated rows
each get a row; further columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import small, stage

LETTERS = re.compile(r"[^\W\d_]+")
ROWS, CHARS = 150, 30_000
STRETCH, CHUNK = 256, 3_000_000
#: Sharpness of the score over entropies in nats a character.
SHARPNESS = 3.0
UNKNOWN = "und"


def normal(text: str | None) -> str:
    bare = " ".join(LETTERS.findall(text.lower())) if text else ""
    if bare and not bare.replace(" ", "").isalpha():  # superscripts, fractions and the like, which the pattern takes for letters
        bare = " ".join("".join(c if c.isalpha() else " " for c in bare).split())
    return bare


def automaton(symbols: list[int], width: int) -> np.ndarray:
    """Transition table [states, width] of the suffix automaton; state 0 is the root, entry 0 means none."""
    step: list[dict[int, int]] = [{}]
    link, length, last = [-1], [0], 0
    for c in symbols:
        new = len(step)
        step.append({})
        length.append(length[last] + 1)
        link.append(0)
        p = last
        while p >= 0 and c not in step[p]:
            step[p][c] = new
            p = link[p]
        if p >= 0:
            q = step[p][c]
            if length[p] + 1 == length[q]:
                link[new] = q
            else:
                copy = len(step)
                step.append(dict(step[q]))
                length.append(length[p] + 1)
                link.append(link[q])
                while p >= 0 and step[p].get(c) == q:
                    step[p][c] = copy
                    p = link[p]
                link[q] = link[new] = copy
        last = new
    table = np.zeros((len(step), width), dtype=np.int32)
    for s, to in enumerate(step):
        for c, t in to.items():
            table[s, c] = t
    return table


def _parsed(symbols: np.ndarray, flat: np.ndarray, width: int) -> int:
    """Phrases of one text, parsed from end to end."""
    state = count = 0
    for c in symbols.tolist():
        to = int(flat[state * width + c])
        count += to == 0 or state == 0
        state = to or int(flat[c])
    return count


@dataclass(frozen=True)
class Model:
    names: list[str]
    tables: list[np.ndarray]
    sizes: list[int]
    codes: np.ndarray

    def symbols(self, text: str) -> np.ndarray:
        return self.codes[np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype="<u4")]

    def phrases(self, texts: list[str]) -> np.ndarray:
        """[languages, texts]: phrases that each text parses into."""
        coded = [self.symbols(t) for t in texts]
        owner = np.repeat(np.arange(len(coded)), [-(-len(c) // STRETCH) for c in coded])
        parts = [c[i : i + STRETCH] for c in coded for i in range(0, len(c), STRETCH)]
        lengths = np.array([len(p) for p in parts], dtype=np.int64)
        lanes = len(parts)
        follows = np.append(owner[1:] == owner[:-1], False) if lanes else np.zeros(0, dtype=bool)
        order = np.argsort(-lengths, kind="stable")  # columns of the grid: longest first
        column = np.empty(lanes, dtype=np.int64)
        column[order] = np.arange(lanes)
        after = np.append(column[1:], 0)[:lanes]  # column of the next stretch
        grid = np.zeros((STRETCH, lanes), dtype=np.int32)
        for j, p in zip(column.tolist(), parts):
            grid[: len(p), j] = p
        live = [int(np.searchsorted(-lengths[order], -t, side="left")) for t in range(int(lengths.max()) if lanes else 0)]
        out = np.zeros((len(self.names), len(texts)), dtype=np.int64)
        for n, table in enumerate(self.tables):
            flat, width = table.ravel(), table.shape[1]
            state, begins = np.zeros(lanes, dtype=np.int32), np.zeros((STRETCH, lanes), dtype=bool)
            for t, end in enumerate(live):
                c, s = grid[t, :end], state[:end]
                to = flat[s * width + c]
                new = to == 0
                np.logical_or(new, s == 0, out=begins[t, :end])
                state[:end] = np.where(new, flat[c], to)
            # entry: where in a stretch the parse of the whole text is met; extra: phrases begun beyond the stretch before that
            entry, extra, met = np.zeros(lanes, dtype=np.int64), np.zeros(lanes, dtype=np.int64), ~follows
            at, t = np.flatnonzero(follows), 0
            state = state[column]
            while len(at) and t < STRETCH:
                over = lengths[at + 1] <= t  # the text ends before they meet
                if over.any():
                    entry[at[over] + 1], met[at[over]] = t, True
                    at = at[~over]
                c, s = grid[t, after[at]], state[at]
                to = flat[s * width + c]
                new = (to == 0) | (s == 0)
                same = new & begins[t, after[at]]
                entry[at[same] + 1], met[at[same]] = t, True
                extra[at] += new & ~same
                state[at] = np.where(to == 0, flat[c], to)
                at, t = at[~same], t + 1
            counted = begins.sum(axis=0)[column] + extra
            for j in np.flatnonzero(entry).tolist():
                counted[j] -= int(begins[: entry[j], column[j]].sum())
            np.add.at(out[n], owner, counted)
            for k in np.unique(owner[~met]).tolist():
                out[n, k] = _parsed(coded[k], flat, width)
        return out

    def predict(self, texts: list[str | None]) -> tuple[list[str], list[float]]:
        bare = [normal(t) for t in texts]
        best, score = [UNKNOWN] * len(texts), [0.0] * len(texts)
        todo = [k for k, t in enumerate(bare) if t] if self.names else []
        while todo:
            size, now = 0, []
            while todo and (not now or size + len(bare[todo[-1]]) <= CHUNK):
                size += len(bare[todo[-1]])
                now.append(todo.pop())
            found = self.phrases([bare[k] for k in now]) * np.log(self.sizes)[:, None] / np.array([len(bare[k]) for k in now])
            weight = np.exp(-SHARPNESS * (found - found.min(axis=0)))
            for j, k in enumerate(now):
                n = int(found[:, j].argmin())
                best[k], score[k] = self.names[n], float(weight[n, j] / weight[:, j].sum())
        return best, score


def fit(samples: dict[str, list[str]]) -> Model:
    """samples: whole texts by language."""
    bare = {name: [t for t in map(normal, texts) if t] for name, texts in sorted(samples.items())}
    taken = {name: texts for name, texts in bare.items() if texts}
    letters = sorted({c for texts in taken.values() for t in texts for c in t})
    codes = np.zeros(0x110000, dtype=np.int32)
    for k, c in enumerate(letters):
        codes[ord(c)] = k + 1
    mark = len(letters) + 1  # ends a text; no text to parse contains it
    joined = {n: [s for t in texts for s in [*(int(codes[ord(c)]) for c in t), mark]] for n, texts in taken.items()}
    return Model(list(joined), [automaton(s, mark + 1) for s in joined.values()], [len(s) for s in joined.values()], codes)


def learn(docs: DataFrame, train: Column, key: str = "doc_id", text: str = "text", lang: str = "lang") -> Model:
    order = F.xxhash64(F.col(key), F.lit(11))
    known = docs.where(train & F.col(lang).isNotNull() & F.col(text).isNotNull())
    size = F.length(text)
    first = Window.partitionBy("lang").orderBy("long", "o", "key")  # the shortest of the long texts comes first
    rows = known.select(F.col(lang).alias("lang"), F.col(key).alias("key"), size.alias("size"), F.xxhash64(text).alias("same"), F.greatest(size - CHARS, F.lit(0)).alias("long"), order.alias("o"))
    rows = stage(rows.withColumn("place", F.row_number().over(first)).where(F.col("place") <= ROWS), "language-rows")
    so_far = F.sum("size").over(first.rowsBetween(Window.unboundedPreceding, 0))
    chosen = rows.withColumn("sum", so_far).where((F.col("place") == 1) | (F.col("sum") <= CHARS))
    chosen = stage(chosen.select("lang", F.col("key").alias("__key"), F.col("same").alias("__same")).distinct(), "language-sample")
    match = (F.col(key) == F.col("__key")) & (F.xxhash64(text) == F.col("__same")) & (docs[lang] == chosen["lang"])
    found = known.join(F.broadcast(chosen), match, "left_semi").select(lang, key, text).distinct().collect()  # CHARS characters a language
    samples: dict[str, list[str]] = {}
    for r in sorted(found, key=lambda r: (r[0], r[1], r[2])):
        samples.setdefault(r[0], []).append(r[2])
    return fit(samples)


def identify(docs: DataFrame, train: Column, key: str = "doc_id", text: str = "text", lang: str = "lang") -> DataFrame:
    """key, lang_pred and score of every row of docs; train: which rows may be learnt from."""
    learnt = learn(docs, train, key, text, lang)
    # plain arrays: a broadcast of the class itself would need the library on the executors
    shared = docs.sparkSession.sparkContext.broadcast((learnt.names, learnt.tables, learnt.sizes, learnt.codes))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = Model(*shared.value)
        for b in batches:
            best, score = model.predict(b.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(best, pa.string()), pa.array(score, pa.float64())], [key, "lang_pred", "score"])

    kind = docs.schema[key].dataType.simpleString()
    return docs.select(key, text).mapInArrow(run, f"`{key}` {kind}, lang_pred string, score double")

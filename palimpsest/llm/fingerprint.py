"""Merkle fingerprints of documents.

A text is cut into tokens (a word and the white space after it), these into leaves of about `LEAF` words that end
after a token whose hash says so (so an edit moves no cut elsewhere), leaves into paragraphs (lines) and these into
sections (at empty lines). A node's digest is made of its children's; the root, 128 bits, tests equality. The
fingerprint is the root and, level by level, the digests of the tree (24 bits a leaf), so two fingerprints can be
compared without the texts: equal branches are passed over, differing ones lead to the edited leaves.

`likeness` is the share of leaves that two trees have in common: 2 * common / (leaves of both), copies counted.

Defined results: a null text is an empty one; the empty fingerprint is like itself (1) and unlike any other (0);
white space counts; rows are ordered by key, null keys first, ties by a hash of the text; a table of one row is its own
next document; further columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import partitions, stage
from .tokens import mix

TOKEN = re.compile(rb"[^ \t-\r]+[ \t-\r]*|^[ \t-\r]+")
LEAF = 6
_POWERS = np.cumprod(np.concatenate([[1], np.full(4095, 0x9E3779B97F4A7C15, dtype=np.uint64)]).astype(np.uint64))


def _fold(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    """A digest of each stretch of values that begins at first: order and length count."""
    if not len(first):
        return np.empty(0, dtype=np.uint64)
    size = np.diff(np.append(first, len(values)))
    place = np.arange(len(values)) - np.repeat(first, size)
    return mix(np.add.reduceat(mix(values + place.astype(np.uint64)) * _POWERS[place % 4096], first) + size.astype(np.uint64))


def fingerprint(text: bytes) -> str:
    tokens = TOKEN.findall(text)
    if not tokens:
        return hashlib.blake2b(b"", digest_size=16).hexdigest() + ":"
    h = np.fromiter(map(xxhash.xxh64_intdigest, tokens), dtype=np.uint64, count=len(tokens))
    lines = np.fromiter((t.count(b"\n") for t in tokens), dtype=np.int64, count=len(tokens)) if b"\n" in text else np.zeros(len(tokens), dtype=np.int64)
    ends = (h % np.uint64(LEAF) == 0) | (lines > 0)
    ends[-1] = True
    leaf_end = np.flatnonzero(ends)
    leaves = _fold(h, np.concatenate([[0], leaf_end[:-1] + 1]))
    kind = lines[leaf_end]
    kind[-1] = max(2, kind[-1])
    para_end = np.flatnonzero(kind > 0)
    paras = _fold(leaves, np.concatenate([[0], para_end[:-1] + 1]))
    section_end = np.flatnonzero(kind[para_end] > 1)
    sections = _fold(paras, np.concatenate([[0], section_end[:-1] + 1]))
    root = hashlib.blake2b(sections.tobytes() + len(text).to_bytes(8, "little"), digest_size=16).hexdigest()
    code = base64.urlsafe_b64encode(np.ascontiguousarray(leaves.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :3]).tobytes()).decode()
    out, start = [], 0
    for end, k in zip((4 * (para_end + 1)).tolist(), kind[para_end].tolist()):
        out.append(code[start:end] + ("/" if k > 1 else "."))
        start = end
    return f"{root}:{''.join(out)}"


def _leaves(branch: str) -> list[str]:
    flat = branch.replace("/", "").replace(".", "")
    return [flat[k : k + 4] for k in range(0, len(flat), 4)]


def likeness(a: str, b: str) -> float:
    """Share of leaves in common, 1 for equal roots. Equal sections and paragraphs are passed over as wholes."""
    if a[:32] == b[:32]:
        return 1.0
    left, right, same, total = [a[33:]], [b[33:]], 0, (len(a[33:].replace("/", "").replace(".", "")) + len(b[33:].replace("/", "").replace(".", ""))) // 4
    for cut in ("/", "."):
        one, two = (Counter(x for s in side for x in s.split(cut) if x) for side in (left, right))
        both = one & two
        same += sum(n * (len(x.replace(".", "")) // 4) for x, n in both.items())
        left, right = list((one - both).elements()), list((two - both).elements())
    one, two = (Counter(x for s in side for x in _leaves(s)) for side in (left, right))
    same += (one & two).total()
    return 2 * same / total if total else 0.0


def differing(a: str, b: str) -> list[tuple[int, int, int, int]]:
    """Ranges of leaves (from, to in a, from, to in b) outside which the two trees agree."""

    def go(x: list[str], y: list[str], at: int, to: int, cuts: str) -> list[tuple[int, int, int, int]]:
        head = 0
        while head < min(len(x), len(y)) and x[head] == y[head]:
            head += 1
        tail = 0
        while tail < min(len(x), len(y)) - head and x[-1 - tail] == y[-1 - tail]:
            tail += 1
        size = lambda part: sum(len(_leaves(p)) for p in part)
        at, to = at + size(x[:head]), to + size(y[:head])
        x, y = x[head : len(x) - tail], y[head : len(y) - tail]
        if not x and not y:
            return []
        if cuts and len(x) == len(y):
            out = []
            for p, q in zip(x, y):
                split = (lambda s: [t for t in s.split(cuts[0]) if t]) if cuts[0] != "4" else _leaves
                out += go(split(p), split(q), at, to, cuts[1:]) if p != q else []
                at, to = at + len(_leaves(p)), to + len(_leaves(q))
            return out
        return [(at, at + size(x), to, to + size(y))]

    return [] if a[:32] == b[:32] else go([a[33:]], [b[33:]], 0, 0, "/.4")


def edited(text: str, following: str) -> str:
    """text with its last quarter replaced by as many first characters of the following one, or all it has."""
    q = len(text) // 4
    return text[: len(text) - q] + following[:q]


class _Row:
    __slots__ = ("key", "text", "print")

    def __init__(self, key, text: str):
        self.key, self.text, self.print = key, text, fingerprint(text.encode())

    def facts(self, following: _Row) -> tuple:
        new = edited(self.text, following.text).encode()
        own = fingerprint(new)
        return len(self.text), hashlib.sha256(new).hexdigest(), self.print, own, likeness(self.print, own), likeness(self.print, following.print)


_NAMES = ("n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next")
_FACTS = "n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
_KINDS = (pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64())


def fingerprints(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key and the fingerprint of every row's whole text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            made = [fingerprint(t.as_py() or b"") for t in b.column(1).cast(pa.binary())]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(made, pa.string())], [key, "fingerprint"])

    return docs.select(key, text).mapInArrow(run, f"`{key}` {docs.schema[key].dataType.simpleString()}, fingerprint string")


def _ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The first (edge 1) and the last row (edge 2) of a partition."""
    names = ["key", "text", "hash", "part", "edge"]
    last: pa.RecordBatch | None = None
    for b in batches:
        if not b.num_rows:
            continue
        if last is None:
            yield pa.RecordBatch.from_arrays([*b.slice(0, 1).columns, pa.array([1], pa.int32())], names)
        last = b.slice(b.num_rows - 1, 1)
    if last is not None:
        yield pa.RecordBatch.from_arrays([*last.columns, pa.array([2], pa.int32())], names)


def _neighbours(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Facts of every row of a sorted partition but the last."""
    held: _Row | None = None
    for b in batches:
        made, keys = [], []
        for k, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
            row = _Row(k, t)
            if held is not None:
                made.append(held.facts(row))
                keys.append(held.key)
            held = row
        yield _batch(pa.array(keys, b.column(0).type), made)


def _pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Facts of rows (key, text, following)."""
    for b in batches:
        made = [_Row(None, t).facts(_Row(None, f)) for t, f in zip(b.column(1).to_pylist(), b.column(2).to_pylist())]
        yield _batch(b.column(0), made)


def _batch(keys: pa.Array, made: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*made)) if made else [()] * len(_NAMES)
    return pa.RecordBatch.from_arrays([keys, *(pa.array(c, k) for c, k in zip(columns, _KINDS))], ["key", *_NAMES])


def with_following(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Every row's fingerprint, that of its edited text, and likenesses to it and to the next row by key.

    One range shuffle puts neighbours together. The last row of each partition meets the first one of the next partition that
    has rows: a window over keys and partition numbers, two rows a partition, says which that is, and an equi-join on that number
    brings its text.
    """
    kind = docs.schema[key].dataType.simpleString()
    rows = docs.select(F.col(key).alias("key"), F.coalesce(F.col(text), F.lit("")).alias("text")).withColumn("hash", F.xxhash64("text"))
    laid = rows.repartitionByRange(partitions(docs.sparkSession), "key").sortWithinPartitions("key", "hash")
    inside = laid.mapInArrow(_neighbours, f"key {kind}, {_FACTS}")
    edges = laid.withColumn("part", F.spark_partition_id()).mapInArrow(_ends, f"key {kind}, text string, hash bigint, part int, edge int")
    edges = stage(edges, "fingerprint-edges")
    order = Window.orderBy(F.col("key").asc_nulls_first(), "hash", "part", "edge")
    places = edges.select("key", "hash", "part", "edge").withColumn("next", F.coalesce(F.lead("part").over(order), F.first("part").over(order))).where("edge = 2")
    firsts = edges.where("edge = 1").select(F.col("part").alias("next"), F.col("text").alias("following"))
    last = edges.where("edge = 2").select("key", "text", "part").join(places.select("part", "next"), "part").join(firsts, "next").select("key", "text", "following")
    return inside.unionByName(last.mapInArrow(_pairs, f"key {kind}, {_FACTS}")).withColumnRenamed("key", key)

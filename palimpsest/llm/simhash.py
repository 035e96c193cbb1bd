"""SimHash near-duplicates by bit-sliced comparison within buckets.

Fingerprints of two texts link if they differ in at most `radius` bits. The 64 bits are cut into m blocks; two
linked fingerprints agree on at least m - radius blocks, so each fingerprint goes to one bucket for each choice
of m - radius blocks (m grows with the number of different fingerprints, so buckets stay small). A bucket above
`BUCKET` fingerprints is cut again: its free bits are split into radius + 1 groups and linked fingerprints agree
on one of them; this repeats until no bucket is too large or too few bits are free. Every link is thus found in
some bucket. Buckets are compared by carry-save counters (bitslice.py) and give each member one link to its
cluster's first; copies are one fingerprint from the start. Components come from star contraction.

Defined results: ASCII letters are lower-cased; a text with fewer words than a shingle is one shingle; null
and texts without words have fingerprint 0 and link like others; null ids are kept, and a component's id is the
smallest id that is not null; repeated rows each get a row; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bitslice import clusters
from .common import partitions, small, stage
from .components import components

RADIUS = 3
SHINGLE = 3
SEED = 42
#: Fingerprints in one bucket before it is cut again.
BUCKET = 4096
#: Fingerprints that random data would put into one bucket, at most.
EXPECTED = 8


def fingerprint(text: bytes, shingle: int = SHINGLE) -> int:
    """SimHash of a UTF-8 text as a signed 64-bit number."""
    w = text.lower().split()
    if not w:
        return 0
    parts = [b" ".join(w)] if len(w) <= shingle else map(b" ".join, zip(*(w[k:] for k in range(shingle)), strict=False))
    h = np.fromiter(map(partial(xxhash.xxh64_intdigest, seed=SEED), parts), dtype="<u8", count=max(1, len(w) - shingle + 1))
    set_bits = np.zeros(64, dtype=np.int64)
    for k in range(0, len(h), 8192):
        set_bits += np.unpackbits(h[k : k + 8192].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * set_bits > len(h), bitorder="little").view("<i8")[0])


def fingerprints(docs: DataFrame, key: str = "doc_id", text: str = "text", shingle: int = SHINGLE, keep: tuple[str, ...] = ()) -> DataFrame:
    """key, the columns in keep and the fingerprint fp (bigint) of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b.column(1).cast(pa.binary())
            f = [fingerprint(t.as_py() or b"", shingle) for t in texts]
            yield pa.RecordBatch.from_arrays([*b.columns[:1], *b.columns[2:], pa.array(f, pa.int64())], [key, *keep, "fp"])

    kinds = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in (key, *keep))
    return docs.select(key, text, *keep).mapInArrow(run, f"{kinds}, fp bigint")


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _split(mask: int, groups: int) -> list[int]:
    """mask with one of the groups of its free bits added, for each group."""
    free = [b for b in range(64) if not mask >> b & 1]
    return [mask | sum(1 << b for b in free[g::groups]) for g in range(groups)]


def first_masks(rows: int, radius: int) -> list[int]:
    """Masks of the first buckets: all choices of m - radius of m blocks."""
    for m in range(radius + 1, radius + 6):
        edges = [64 * k // m for k in range(m + 1)]
        blocks = [sum(1 << b for b in range(edges[k], edges[k + 1])) for k in range(m)]
        if rows / 2 ** (64 * (m - radius) / m) <= EXPECTED or m == radius + 5:
            return [sum(c) for c in combinations(blocks, m - radius)]
    raise AssertionError


def _clustered(batches: Iterator[pa.RecordBatch], radius: int) -> Iterator[pa.RecordBatch]:
    """Rows (mask, part, fp) sorted by bucket; a link from each fingerprint to its cluster's first."""
    held: list[np.ndarray] = [np.empty((3, 0), dtype=np.int64)]

    def links(rows: np.ndarray) -> pa.RecordBatch:
        change = np.any(rows[:2, 1:] != rows[:2, :-1], axis=0)
        keys = np.concatenate([[0], np.cumsum(change)])[: rows.shape[1]]
        label = clusters(keys, np.ascontiguousarray(rows[2]).view(np.uint64), radius)
        at = np.flatnonzero(label != np.arange(len(label)))
        return pa.RecordBatch.from_arrays([pa.array(rows[2][at]), pa.array(rows[2][label[at]])], ["a", "b"])

    for b in batches:
        held.append(np.stack([b.column(k).to_numpy(zero_copy_only=False) for k in range(3)]))
        if sum(x.shape[1] for x in held) < 65536:
            continue
        rows = np.concatenate(held, axis=1)
        cut = np.flatnonzero(np.any(rows[:2, 1:] != rows[:2, :-1], axis=0))
        if len(cut):
            yield links(rows[:, : cut[-1] + 1])
            rows = rows[:, cut[-1] + 1 :]
        held = [rows]
    rows = np.concatenate(held, axis=1)
    if rows.shape[1]:
        yield links(rows)


def links(fps: DataFrame, radius: int = RADIUS) -> DataFrame:
    """fps: one column fp of different fingerprints, staged. Links (a, b) whose closure is that of all pairs within radius."""
    spark = fps.sparkSession
    groups, masks = radius + 1, first_masks(fps.count(), radius)
    rows = fps.withColumn("mask", F.explode(F.array(*(F.lit(_signed(m)) for m in masks))))
    ready: DataFrame | None = None
    while True:
        rows = stage(rows.select("mask", F.col("fp").bitwiseAND(F.col("mask")).alias("part"), "fp"), "simhash-buckets")
        deeper = {_signed(m): [_signed(x) for x in _split(m, groups)] for m in masks if bin(m).count("1") <= 48}
        sizes = rows.groupBy("mask", "part").count().where((F.col("count") > BUCKET) & F.col("mask").isin(list(deeper)))
        hot = stage(sizes.select("mask", "part"), "simhash-hot")
        if not deeper or hot.isEmpty():
            ready = rows if ready is None else ready.unionByName(rows)
            break
        hot, key = small(hot), ["mask", "part"]
        calm = rows.join(hot, key, "left_anti").select("mask", "part", "fp")
        ready = calm if ready is None else ready.unionByName(calm)
        steps = F.create_map(*(x for m, to in deeper.items() for x in (F.lit(m), F.array(*map(F.lit, to)))))
        rows = rows.join(hot, key, "left_semi").select("fp", F.explode(steps[F.col("mask")]).alias("mask"))
        masks = sorted({x & (1 << 64) - 1 for to in deeper.values() for x in to})
    n = partitions(spark)
    spread = ready.repartition(n, "mask", "part").sortWithinPartitions("mask", "part", "fp")
    return spread.mapInArrow(partial(_clustered, radius=radius), "a bigint, b bigint")


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", radius: int = RADIUS, shingle: int = SHINGLE, keep: tuple[str, ...] = ()) -> DataFrame:
    """key, the columns in keep, fp and component_id (the smallest key that links reach) of every row."""
    marked = stage(fingerprints(docs, key, text, shingle, keep), "simhash")
    each = stage(marked.groupBy("fp").agg(F.min(key).alias("least")), "simhash-different")
    roots = components(stage(links(each.select("fp"), radius), "simhash-links"), "simhash-components")
    rooted = each.join(roots.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    least = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    member = rooted.select("fp", "root").join(least, "root").select("fp", "component_id")
    return marked.join(member, "fp").select(key, *keep, "fp", "component_id")

"""Bit-sliced Hamming comparison of 64-bit fingerprints.

Fingerprints are laid out vertically: plane b holds bit b of 64 fingerprints in each machine word (lane i of
word w is fingerprint 64 * w + i). Comparing every fingerprint with the one d places further shifts a plane by
d lanes, takes the exclusive or, and feeds it to carry-save counters, so one operation counts 64 distances.
Words of which every lane has exceeded the radius are abandoned before the other planes are read.
"""

from __future__ import annotations

import numpy as np

LANES = 64
#: Planes between two looks for words to abandon.
STRIDE = 8


def planes(values: np.ndarray, spare: int) -> np.ndarray:
    """[64, words + spare]: the bit planes of values, zero words at the end."""
    words = -(-len(values) // LANES)
    padded = np.zeros(words * LANES, dtype="<u8")
    padded[: len(values)] = values
    bits = np.unpackbits(padded.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    packed = np.packbits(np.ascontiguousarray(bits.T), axis=1, bitorder="little").view("<u8")
    return np.concatenate([packed, np.zeros((64, spare), dtype="<u8")], axis=1)


def near(plane: np.ndarray, at: np.ndarray, d: int, valid: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """For the words at, and their lanes in valid, those lanes whose distance to the fingerprint d further is within radius."""
    q, r = divmod(d, LANES)
    over = ~valid
    counters = [np.zeros(len(at), dtype="<u8") for _ in range(radius.bit_length())]
    for b in range(64):
        if b % STRIDE == 0 and b:
            live = over != ~np.uint64(0)
            if not live.all():
                at, over, counters = at[live], over[live], [c[live] for c in counters]
                if not len(at):
                    return at, over
        p = plane[b]
        other = p[at + q] if r == 0 else (p[at + q] >> np.uint64(r)) | (p[at + q + 1] << np.uint64(LANES - r))
        carry = p[at] ^ other
        for k, c in enumerate(counters):
            counters[k], carry = c ^ carry, c & carry
        over |= carry
    return at, ~over


def clusters(keys: np.ndarray, values: np.ndarray, radius: int) -> np.ndarray:
    """keys: bucket of each value, equal ones together. For each value the place of its cluster's first member.

    Two values of a bucket within radius are in one cluster; clusters are the closure of that.
    """
    n = len(values)
    label = np.arange(n)
    if n < 2:
        return label
    last = np.flatnonzero(np.append(keys[1:] != keys[:-1], True))
    room = last[np.searchsorted(last, np.arange(n))] - np.arange(n)  # partners that follow in the bucket
    plane = planes(values, int(room.max()) // LANES + 2)
    lanes = np.zeros(-(-n // LANES) * LANES, dtype=room.dtype)
    lanes[:n] = room
    lanes = lanes.reshape(-1, LANES)
    most = lanes.max(axis=1)

    def find(x: int) -> int:
        while label[x] != x:
            label[x] = label[label[x]]
            x = label[x]
        return x

    for d in range(1, int(room.max()) + 1):
        at = np.flatnonzero(most >= d)
        valid = np.packbits(lanes[at] >= d, axis=1, bitorder="little").view("<u8").ravel()
        at, hits = near(plane, at, d, valid, radius)
        if not len(at):
            continue
        w, lane = np.nonzero(np.unpackbits(hits.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little"))
        i = at[w] * LANES + lane
        i = i[np.bitwise_count(values[i] ^ values[i + d]) <= radius]  # counters of radius 2**k - 1 need no such check
        for x in i[label[i] != label[i + d]].tolist():
            a, b = find(x), find(x + d)
            if a != b:
                label[max(a, b)] = min(a, b)
        while (label[label] != label).any():
            label = label[label]
    return label


def within(a: np.ndarray, b: np.ndarray, radius: int) -> np.ndarray:
    """[n] booleans: are the fingerprints a[i] and b[i], rows of 64-bit words, within radius bits of each other?

    Pairs are laid out as lanes. Counters start so that a lane overflows with the first bit beyond the radius, and words of
    which every lane has overflowed are abandoned.
    """
    n, k = a.shape
    if not n:
        return np.zeros(0, dtype=bool)
    words = -(-n // LANES)
    differ = np.zeros((words * LANES, k), dtype="<u8")
    differ[:n] = a ^ b
    bits = np.unpackbits(differ.view(np.uint8), axis=1, bitorder="little")
    plane = np.packbits(np.ascontiguousarray(bits.T), axis=1, bitorder="little").view("<u8")
    width = radius.bit_length()
    start = (1 << width) - 1 - radius
    counters = [np.full(words, ~np.uint64(0) if start >> j & 1 else 0, dtype="<u8") for j in range(width)]
    over, at = np.zeros(words, dtype="<u8"), np.arange(words)
    near = np.zeros(words, dtype="<u8")
    for p in range(LANES * k):
        if p % STRIDE == 0 and p:
            live = over != ~np.uint64(0)
            if not live.all():
                at, over, counters = at[live], over[live], [c[live] for c in counters]
                if not len(at):
                    break
        carry = plane[p, at]
        for j, c in enumerate(counters):
            counters[j], carry = c ^ carry, c & carry
        over |= carry
    near[at] = ~over
    return np.unpackbits(near.view(np.uint8), bitorder="little")[:n].astype(bool)

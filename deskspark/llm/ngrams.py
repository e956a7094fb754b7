"""Hashed word n-grams of many texts at once (numpy, inside tasks)."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

# Bytes of text worked on at a time, so that intermediate arrays stay in cache.
CHUNK = 1 << 20
# Rows taken out of a batch at a time.
ROWS = 256
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[ord("A") : ord("Z") + 1] += 32
M1, M2, M3 = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB))
TAIL = np.array([(1 << (8 * k)) - 1 for k in range(8)] + [(1 << 64) - 1], np.uint64)


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection on unsigned 64-bit numbers that spreads every bit."""
    x = (x ^ (x >> np.uint64(30))) * M2
    x = (x ^ (x >> np.uint64(27))) * M3
    return x ^ (x >> np.uint64(31))


def chunks(column: pa.Array) -> Iterator[tuple[int, list[bytes]]]:
    """(first row, texts as bytes) of about CHUNK bytes each; null is empty."""
    held, size, first = [], 0, 0
    for low in range(0, len(column), ROWS):
        for i, text in enumerate(column.slice(low, ROWS).cast(pa.large_binary()).to_pylist(), low):
            held.append(text or b"")
            size += len(held[-1])
            if size >= CHUNK:
                yield first, held
                held, size, first = [], 0, i + 1
    if held:
        yield first, held


def word_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hash of every word, A-Z lower-cased, and how many words each text has.

    Words are maximal runs of bytes other than blank and 0x09-0x0D.
    """
    blob = np.frombuffer(b" ".join(texts) + b" " * 9, np.uint8)
    low = LOWER[blob]
    blank = SPACE[low]
    edges = np.flatnonzero(blank[1:] != blank[:-1]) + 1
    if not blank[0]:
        edges = np.concatenate(([0], edges))
    starts, ends = edges[::2], edges[1::2]
    lengths = ends - starts
    lanes = np.lib.stride_tricks.as_strided(low[:8].view("<u8"), (len(low) - 7,), (1,))
    h = lengths.astype(np.uint64) * M1
    live, at, left = np.arange(len(starts)), starts, lengths
    while len(live):
        lane = lanes[at] & TAIL[np.minimum(left, 8)]
        h[live] = mixed(h[live] ^ lane) + M1
        more = left > 8
        live, at, left = live[more], at[more] + 8, left[more] - 8
    bounds = np.cumsum([len(t) + 1 for t in texts])
    upto = np.searchsorted(starts, bounds)
    return h, np.diff(np.concatenate(([0], upto)))


def shingles(texts: list[bytes], k: int) -> list[np.ndarray]:
    """Distinct k-word shingle hashes of each text, ascending; a shorter text is one shingle as a whole."""
    h, counts = word_hashes(texts)
    ends = np.cumsum(counts)
    grams = mixed(h)
    for t in range(1, k):
        grams = grams[:-1] if len(grams) else grams
        grams = mixed(grams * M1 + h[t:])
    out = []
    for end, n in zip(ends, counts):
        if n >= k:
            out.append(np.unique(grams[end - n : end - k + 1]))
        elif n:
            short = mixed(h[end - n : end - n + 1])
            for t in range(1, n):
                short = mixed(short * M1 + h[end - n + t : end - n + t + 1])
            out.append(short)
        else:
            out.append(np.empty(0, np.uint64))
    return out

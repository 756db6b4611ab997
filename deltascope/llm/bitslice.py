"""Bit-sliced Hamming comparison of fingerprints, in numpy.

64 fingerprints are stored vertically: plane b is one machine word that holds
their bits b. A query is compared with all 64 at once: each plane, inverted where
the query's bit is set, is added to counters kept as bit planes too (carry-save:
a half adder per counter bit). Counters start so that they overflow exactly
beyond the radius; a (query, word) pair whose 64 lanes have all overflowed is
abandoned.
"""

from __future__ import annotations

import numpy as np

#: (query, word) pairs handled at once.
STEP = 1 << 17
FULL = np.uint64(0xFFFFFFFFFFFFFFFF)


def planes_of(prints: np.ndarray) -> np.ndarray:
    """Word w holds rows 64 w to 64 w + 63, whatever run they are in: words x bits."""
    width, n_words = prints.shape[1], -(-len(prints) // 64)
    planes = np.empty((n_words, width * 8), np.uint64)
    for a in range(0, n_words, 128):
        rows = prints[64 * a : 64 * (a + 128)]
        slots = np.zeros((-(-len(rows) // 64) * 64, width), np.uint8)
        slots[: len(rows)] = rows
        bits = np.unpackbits(slots, axis=1, bitorder="little").reshape(-1, 64, width * 8).transpose(0, 2, 1)
        planes[a : a + 128] = np.ascontiguousarray(np.packbits(bits, axis=2, bitorder="little")).view("<u8")[:, :, 0]
    return planes


def _below(n: np.ndarray) -> np.ndarray:
    """Masks of the lowest n lanes, 0 <= n <= 64."""
    n = n.astype(np.uint64)
    return np.where(n >= 64, FULL, (np.uint64(1) << np.minimum(n, np.uint64(63))) - np.uint64(1))


def near_pairs(prints: np.ndarray, starts: np.ndarray, sizes: np.ndarray, radius: int):
    """Yields arrays (i, j), i < j, of rows (n x bytes) of the same run within the radius. Runs follow each other."""
    planes, n = planes_of(prints), len(prints)
    width = planes.shape[1]
    end = np.repeat(starts + sizes, sizes)
    # a row meets the words from its successor's to its run's last
    first = (np.arange(n) + 1) // 64
    todo = np.where(end > np.arange(n) + 1, (end - 1) // 64 - first + 1, 0)
    total = np.concatenate([[0], np.cumsum(todo)])
    at = 0
    while at < n:
        upto = max(at + 1, int(np.searchsorted(total, total[at] + STEP, side="right")) - 1)
        query = np.repeat(np.arange(at, upto), todo[at:upto])
        word = first[query] + np.arange(len(query)) - (total[query] - total[at])
        at = upto
        if not len(query):
            continue
        bits = radius.bit_length()
        start = (1 << bits) - 1 - radius
        counters = [np.full(len(query), FULL if start >> b & 1 else 0, np.uint64) for b in range(bits)]
        lanes = _below(np.minimum(end[query] - 64 * word, 64)) & ~_below(np.maximum(query + 1 - 64 * word, 0))
        over = ~lanes
        for p in range(width):
            flip = (prints[query, p >> 3] >> (p & 7) & 1).astype(np.uint64) * FULL
            carry = planes[word, p] ^ flip
            for b in range(bits):
                counters[b], carry = counters[b] ^ carry, counters[b] & carry
            over |= carry
            if p % 16 == 15 and p > radius:
                alive = over != FULL
                if alive.mean() < 0.7:
                    query, word, over = query[alive], word[alive], over[alive]
                    counters = [c[alive] for c in counters]
                    if not len(query):
                        break
        alive = over != FULL
        query, word, near = query[alive], word[alive], ~over[alive]
        for k in range(0, len(query), 1 << 14):
            hit, lane = np.nonzero(np.unpackbits(near[k : k + (1 << 14)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little"))
            yield query[k + hit], 64 * word[k + hit] + lane


def forest(i: np.ndarray, j: np.ndarray):
    """Links of a spanning forest of the graph with the edges (i, j): each touched node but the least of its tree, with that least."""
    nodes, back = np.unique(np.concatenate([i, j]), return_inverse=True)
    a, b = back[: len(i)], back[len(i) :]
    label = np.arange(len(nodes))
    while True:
        before = label.copy()
        low = np.minimum(label[a], label[b])
        np.minimum.at(label, label[a], low)
        np.minimum.at(label, label[b], low)
        while True:
            jumped = label[label]
            if (jumped == label).all():
                break
            label = jumped
        if (label == before).all():
            break
    child = np.nonzero(label != np.arange(len(nodes)))[0]
    return nodes[child], nodes[label[child]]

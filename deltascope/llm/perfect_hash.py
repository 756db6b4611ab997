"""A minimal perfect hash in numpy, built shard by shard and looked up for whole arrays.

Keys are pairs of 64-bit hashes. A shard's keys go to a bit array of GAMMA bits
each; keys alone on their bit are settled, the others go to the next, smaller
array. A key's slot is the number of set bits before its own, over all shards, so
slots run from 0 to the number of keys without a gap. Any other pair would get
some slot as well: each slot's stored second hash tells them apart. Where no others
are looked up, these needn't be stored.
"""

from __future__ import annotations

import numpy as np

GAMMA = 1.5
_STEP, _A, _B = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB))


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    h = (h ^ (h >> np.uint64(30))) * _A
    h = (h ^ (h >> np.uint64(27))) * _B
    return h ^ (h >> np.uint64(31))


def _bit(h1: np.ndarray, h2: np.ndarray, level: int, size: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        return (mix(h1 + np.uint64(level + 1) * (h2 | np.uint64(1)) + _STEP) % size).astype(np.int64)


def build_shard(h1: np.ndarray, h2: np.ndarray) -> tuple[list[int], bytes, bytes]:
    """Of distinct pairs: the levels' sizes in bits, their bits, and the second hashes by slot."""
    sizes, bits, keys = [], [], []
    while len(h1):
        size = 64 * max(1, -(-int(GAMMA * len(h1)) // 64))
        place = _bit(h1, h2, len(sizes), np.uint64(size))
        alone = np.bincount(place, minlength=size)[place] == 1
        level = np.zeros(size, np.uint8)
        level[place[alone]] = 1
        sizes.append(size)
        bits.append(np.packbits(level, bitorder="little").tobytes())
        keys.append(h2[alone][np.argsort(place[alone])].tobytes())
        h1, h2 = h1[~alone], h2[~alone]
    return sizes, b"".join(bits), b"".join(keys)


class PerfectHash:
    """The shards first to first + len(parts) - 1 of n_shards; pairs of other shards have no slot. Parts without stored hashes (None) are for looking up keys alone."""

    def __init__(self, parts: list[tuple[list[int], bytes, bytes | None]], first: int, n_shards: int):
        self.first, self.n_shards = first, n_shards
        depth = max((len(p[0]) for p in parts), default=0)
        self.sizes = np.array([[*p[0], *[0] * (depth - len(p[0]))] for p in parts], np.int64).reshape(len(parts), depth)
        self.begins = np.cumsum(self.sizes).reshape(self.sizes.shape) - self.sizes
        self.words = np.frombuffer(b"".join(p[1] for p in parts), np.uint64)
        self.before = np.concatenate([[0], np.cumsum(np.bitwise_count(self.words), dtype=np.int64)])
        self.keys = None if any(p[2] is None for p in parts) else np.frombuffer(b"".join(p[2] for p in parts), np.uint64)

    def __len__(self) -> int:
        return int(self.before[-1])

    def slots(self, h1: np.ndarray, h2: np.ndarray) -> np.ndarray:
        """Each pair's slot, or -1 if it isn't a key."""
        found = np.full(len(h1), -1, np.int64)
        shard = shard_of(h1, self.n_shards) - self.first
        at = np.flatnonzero((shard >= 0) & (shard < len(self.sizes)))
        for level in range(self.sizes.shape[1]):
            if not len(at):
                break
            size = self.sizes[shard[at], level]
            at, size = at[size > 0], size[size > 0]
            place = self.begins[shard[at], level] + _bit(h1[at], h2[at], level, size.astype(np.uint64))
            word, bit = self.words[place >> 6], (place & 63).astype(np.uint64)
            hit = (word >> bit & np.uint64(1)) == 1
            below = word[hit] & ((np.uint64(1) << bit[hit]) - np.uint64(1))
            slot = self.before[place[hit] >> 6] + np.bitwise_count(below)
            own = slice(None) if self.keys is None else self.keys[slot] == h2[at[hit]]
            found[at[hit][own]] = slot[own]
            at = at[~hit]
        return found


def shard_of(h1: np.ndarray, n_shards: int) -> np.ndarray:
    """From the upper bits, which bit places don't depend on alone."""
    return ((h1 >> np.uint64(32)) * np.uint64(n_shards) >> np.uint64(32)).astype(np.int64)

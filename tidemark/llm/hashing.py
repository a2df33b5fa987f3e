"""Vectorised hashing of spans inside one buffer, and a numpy hash map.

A span (word, stem) is hashed without making a Python object of it: the sum over its places of
``value[code] * weight[place]``, both random 64-bit numbers, modulo 2**64. The weights are
independent of each other, so no word and its rearrangement cancel out as they do for powers of
one base (Thue-Morse words, modulo 2**64). Two different spans meet with a chance of about 2**-63.
A Hasher made from a secret seed can't be attacked by words made to collide, either.
"""

from __future__ import annotations

import numpy as np

U = np.uint64
#: Elements that are hashed at a time, unless a single span is longer.
CHUNK = 1 << 17


def mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser, by element."""
    x = x.astype(np.uint64, copy=True)
    x += U(0x9E3779B97F4A7C15)
    x ^= x >> U(30)
    x *= U(0xBF58476D1CE4E5B9)
    x ^= x >> U(27)
    x *= U(0x94D049BB133111EB)
    x ^= x >> U(31)
    return x


def values(n: int, seed: int) -> np.ndarray:
    """n random numbers that follow from a seed."""
    return mix(mix(np.arange(n, dtype=np.uint64) + U(seed & 0xFFFFFFFF)) ^ U(seed & (1 << 64) - 1))


class Hasher:
    """Hashes of spans of codes; equal seeds give equal hashes."""

    def __init__(self, codes: int, seed: int) -> None:
        self.seed = seed
        self.value = values(codes, seed)
        self.weight = values(64, ~seed) | U(1)

    def _weights(self, n: int) -> np.ndarray:
        if len(self.weight) < n:
            self.weight = values(max(n, 2 * len(self.weight)), ~self.seed) | U(1)
        return self.weight

    def spans(self, codes: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """A 64-bit hash, never 0, of each span of ``codes``. Spans aren't empty."""
        lengths = ends - starts
        n = len(lengths)
        out = np.empty(n, np.uint64)
        if not n:
            return out
        weight = self._weights(int(lengths.max()))
        upto = np.cumsum(lengths)
        a = 0
        while a < n:
            b = min(n, max(a + 1, int(np.searchsorted(upto, (upto[a - 1] if a else 0) + CHUNK, "right"))))
            size = lengths[a:b]
            first = np.cumsum(size) - size
            place = np.arange(int(size.sum())) - np.repeat(first, size)
            at = place + np.repeat(starts[a:b], size)
            out[a:b] = np.add.reduceat(self.value.take(codes.take(at)) * weight.take(place), first)
            a = b
        out = mix(out ^ (lengths.astype(np.uint64) * U(0xD6E8FEB86659FD93)))
        out[out == 0] = U(1)
        return out


class IntMap:
    """Open-addressing map from uint64 keys (not 0) to int32 values, filled and read by arrays."""

    def __init__(self, capacity: int = 1 << 12) -> None:
        self.size = 1 << max(4, (2 * capacity - 1).bit_length())
        self.keys = np.zeros(self.size, np.uint64)
        self.vals = np.full(self.size, -1, np.int32)
        self.used = 0

    def _slots(self, keys: np.ndarray) -> np.ndarray:
        h = keys * U(0xFF51AFD7ED558CCD)
        return ((h ^ (h >> U(33))) & U(self.size - 1)).astype(np.int64)

    def get(self, keys: np.ndarray) -> np.ndarray:
        """Values, or -1 where a key is absent."""
        slot = self._slots(keys)
        at = self.keys.take(slot)
        same = at == keys
        out = np.where(same, self.vals.take(slot), np.int32(-1))
        rest = np.flatnonzero(~same & (at != 0))
        while len(rest):
            s = (slot[rest] + 1) & (self.size - 1)
            slot[rest] = s
            at = self.keys[s]
            hit = at == keys[rest]
            out[rest[hit]] = self.vals[s[hit]]
            rest = rest[~hit & (at != 0)]
        return out

    def add(self, keys: np.ndarray, vals: np.ndarray) -> None:
        """Puts distinct keys that aren't in the map."""
        if (self.used + len(keys)) * 2 > self.size:
            old_keys, old_vals = self.keys, self.vals
            live = old_keys != 0
            self.size = 1 << max(4, (4 * (self.used + len(keys)) - 1).bit_length())
            self.keys = np.zeros(self.size, np.uint64)
            self.vals = np.full(self.size, -1, np.int32)
            self.used = 0
            self._put(old_keys[live], old_vals[live])
        self._put(keys, vals)

    def _put(self, keys: np.ndarray, vals: np.ndarray) -> None:
        keys = np.asarray(keys, np.uint64)
        vals = np.asarray(vals, np.int32)
        slot = self._slots(keys)
        rest = np.arange(len(keys))
        while len(rest):
            s = slot[rest]
            free = self.keys[s] == 0
            self.keys[s[free]] = keys[rest[free]]
            won = free & (self.keys[s] == keys[rest])
            self.vals[s[won]] = vals[rest[won]]
            rest = rest[~won]
            slot[rest] = (slot[rest] + 1) & (self.size - 1)
        self.used += len(keys)


def ragged(offsets: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Indices offsets[0]..offsets[0]+lengths[0]-1, offsets[1].., flattened."""
    total = int(lengths.sum())
    if not total:
        return np.zeros(0, np.int64)
    lengths = lengths.astype(np.int64)
    first = np.cumsum(lengths) - lengths
    return np.repeat(offsets.astype(np.int64) - first, lengths) + np.arange(total)

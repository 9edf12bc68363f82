"""A hash map from 64-bit keys to integers that is read and filled a vector at a time."""

from __future__ import annotations

import numpy as np

from . import _text as t

_SPREAD = np.uint64(0x9E3779B97F4A7C15)


class IntMap:
    """Open addressing with linear probing; a key of 0 stands for an empty slot and is kept as 1."""

    def __init__(self, bits: int = 12):
        self._clear(bits)

    def _clear(self, bits: int) -> None:
        self.bits, self.count = bits, 0
        self.keys = np.zeros(1 << bits, np.uint64)
        self.values = np.zeros(1 << bits, np.int64)

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys * _SPREAD) >> np.uint64(64 - self.bits)).astype(np.int64)

    def get(self, keys: np.ndarray, default: int = -1) -> np.ndarray:
        keys = np.maximum(keys, np.uint64(1))
        out = np.full(len(keys), default, np.int64)
        slot = self._slot(keys)
        left = None
        while True:
            here = self.keys[slot]
            hit = here == keys
            rows = np.flatnonzero(hit)
            out[rows if left is None else left[rows]] = self.values[slot[rows]]
            on = np.flatnonzero(~hit & (here != 0))
            if not len(on):
                return out
            left = on if left is None else left[on]
            keys, slot = keys[on], (slot[on] + 1) & ((1 << self.bits) - 1)

    def put(self, keys: np.ndarray, values: np.ndarray) -> None:
        """Adds distinct keys that are not there."""
        if 2 * (self.count + len(keys)) > 1 << self.bits:
            old_keys, old_values = self.keys, self.values
            full = old_keys != 0
            self._clear(int(np.ceil(np.log2(4 * (int(full.sum()) + len(keys)) + 1))))
            self._fill(old_keys[full], old_values[full])
        self._fill(np.maximum(keys, np.uint64(1)), np.asarray(values, np.int64))

    def _fill(self, keys: np.ndarray, values: np.ndarray) -> None:
        self.count += len(keys)
        slot = self._slot(keys)
        while len(keys):
            free = np.flatnonzero(self.keys[slot] == 0)
            self.keys[slot[free]] = keys[free]
            mine = np.zeros(len(keys), bool)
            mine[free] = self.keys[slot[free]] == keys[free]  # of keys that want one slot, the last got it
            self.values[slot[mine]] = values[mine]
            keys, values, slot = keys[~mine], values[~mine], (slot[~mine] + 1) & ((1 << self.bits) - 1)


class PieceCache:
    """Token ids of text pieces, found by the piece's hash and confirmed by its bytes.

    Holds at most `limit` pieces, and `limit` * 4 ids and numbers of text; a
    fuller cache starts anew, so one lookup may go beyond by what it brings.
    """

    def __init__(self, limit: int = 1_000_000):
        self.limit = limit
        self._reset()

    def _reset(self) -> None:
        self.map, self.used, self.n, self.filled = IntMap(16), 0, 0, 0
        self.pool = np.zeros(1 << 16, np.uint32)
        self.rest = np.zeros(1 << 16, np.uint64)
        self.head = np.zeros(1 << 14, np.uint64)
        self.start, self.size, self.begin, self.length = (np.zeros(1 << 14, np.int64) for _ in range(4))

    @staticmethod
    def _fit(x: np.ndarray, n: int) -> np.ndarray:
        while n > len(x):
            x = np.concatenate([x, np.zeros_like(x)])
        return x

    def _ids(self, flat: np.ndarray) -> int:
        """Where the ids now lie in the pool."""
        self.pool = self._fit(self.pool, self.used + len(flat))
        self.pool[self.used : self.used + len(flat)] = flat
        self.used += len(flat)
        return self.used - len(flat)

    def _add(self, hashes: np.ndarray, one: np.ndarray, text: t.Blocks, flat: np.ndarray, sizes: np.ndarray) -> None:
        lo, hi = self.n, self.n + len(one)
        self.head, self.start, self.size, self.begin, self.length = (self._fit(x, hi) for x in (self.head, self.start, self.size, self.begin, self.length))
        more = np.zeros(len(text.head), np.int64)
        more[text.long] = text.more
        first = np.zeros(len(text.head), np.int64)
        first[text.long] = text.first
        more, first = more[one], first[one]
        n = int(more.sum())
        self.rest = self._fit(self.rest, self.filled + n)
        self.rest[self.filled : self.filled + n] = text.rest[t.ragged(first, more)]
        self.head[lo:hi], self.length[lo:hi] = text.head[one], text.length[one]
        self.begin[lo:hi] = self.filled + np.cumsum(more) - more
        self.start[lo:hi] = self._ids(flat) + np.cumsum(sizes) - sizes
        self.size[lo:hi] = sizes
        self.map.put(hashes, np.arange(lo, hi))
        self.n, self.filled = hi, self.filled + n

    def lookup(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray, encode) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(starts in the pool, sizes, pool) of each piece. encode(positions) gives (flat ids, sizes) of new pieces."""
        if self.n > self.limit or max(self.used, self.filled) > 4 * self.limit:
            self._reset()
        text = t.Blocks(data, starts, ends)
        hashes = text.hashes()
        at = self.map.get(hashes)
        missing = np.flatnonzero(at < 0)
        if len(missing):
            new, one, back = np.unique(hashes[missing], return_index=True, return_inverse=True)
            at[missing] = self.n + back.reshape(-1)
            one = missing[one]
            self._add(new, one, text, *encode(one))
        begin, size = self.start[at], self.size[at]
        same = (self.length[at] == text.length) & (self.head[at] == text.head)
        on = np.flatnonzero(same[text.long])
        more = text.more[on]
        apart = self.rest[t.ragged(self.begin[at[text.long[on]]], more)] != text.rest[t.ragged(text.first[on], more)]
        if apart.any():
            same[text.long[on[np.repeat(np.arange(len(on)), more)[apart]]]] = False
        other = np.flatnonzero(~same)  # pieces that only share a hash with what is held
        if len(other):
            flat, sizes = encode(other)
            begin[other] = self._ids(flat) + np.cumsum(sizes) - sizes
            size[other] = sizes
        return begin, size, self.pool

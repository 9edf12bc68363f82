"""Vectorised text kernels over the UTF-8 buffers of Arrow string columns.

Words are maximal runs of bytes other than 0x20 and 0x09-0x0D, which in UTF-8
are the runs of `[^\\x20\\x09-\\x0D]+`. Hashes are 64-bit, depend on the bytes
alone and are no linear function of them.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Bytes of text that one step works on; a longer text is a step of its own.
SLICE_BYTES = 2 << 20
#: Bytes hashed at once.
_BLOCK = 1 << 18

U64 = np.uint64
_WS = np.zeros(256, bool)
_WS[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32
_MASK = np.array([(1 << 8 * k) - 1 for k in range(9)], U64)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser."""
    x = x ^ (x >> U64(30))
    x *= U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


def slices(texts: pa.Array, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets of the rows within the bytes); null is empty."""
    texts = texts.cast(pa.large_string())
    if texts.null_count:
        texts = texts.fill_null("")
    n = len(texts)
    if not n:
        return
    _, offs, data = texts.buffers()
    offsets = np.frombuffer(offs, np.int64, n + 1, texts.offset * 8)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    i = 0
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + limit, "right")) - 1)
        j = min(j, n)
        yield i, j, raw[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
        i = j


def word_bounds(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words in bytes, and for each text its first word's index (n + 1 entries)."""
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    ws = _WS[data]
    before = np.empty(len(ws), bool)
    before[0] = True
    before[1:] = ws[:-1]
    edge = offsets[(offsets > 0) & (offsets < len(data))]
    before[edge] = True
    starts = np.flatnonzero(~ws & before)
    after = np.empty(len(ws), bool)
    after[-1] = True
    after[:-1] = ws[1:]
    after[edge - 1] = True
    ends = np.flatnonzero(~ws & after) + 1
    return starts, ends, np.searchsorted(starts, offsets)


class Blocks:
    """The bytes of spans as numbers of 8 bytes, the last one of a span filled up with zeros.

    head: each span's first number; rest: the others of the spans at `long`,
    one span after another, `more` of each.
    """

    def __init__(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray):
        padded = np.zeros(len(data) + 8, np.uint8)
        padded[: len(data)] = data
        wide = np.ndarray((len(data) + 1,), "<u8", padded, strides=(1,))
        self.length = ends - starts
        self.head = wide[starts] & _MASK[np.minimum(self.length, 8)]
        self.long = np.flatnonzero(self.length > 8)
        self.more = (self.length[self.long] - 1) >> 3
        self.first = np.cumsum(self.more) - self.more
        owner = np.repeat(np.arange(len(self.long)), self.more)
        self.place = np.arange(len(owner)) - self.first[owner] + 1
        at = starts[self.long][owner] + 8 * self.place
        self.rest = wide[at] & _MASK[np.minimum(ends[self.long][owner] - at, 8)]

    def hashes(self, seed: int = 0) -> np.ndarray:
        """A hash of each span; seeds give independent hashes.

        Every number is scrambled with a key of its place before a span's are
        added up, so that no arithmetic relation between texts survives; two
        spans of up to 8 bytes and one length never share a hash.
        """
        keys = lambda place: mix((place * U64(0x2545F4914F6CDD1D) + U64(seed + 1)) * U64(0x9E3779B97F4A7C15))
        total = mix(self.head ^ keys(np.zeros(1, U64)))
        if len(self.long):
            total[self.long] += np.add.reduceat(mix(self.rest ^ keys(self.place.astype(U64))), self.first)
        total += self.length.astype(U64) * U64(0xD6E8FEB86659FD93)
        return mix(total)


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, fold: bool = True, seed: int = 0) -> np.ndarray:
    """A hash of the bytes of each of the ascending, disjoint spans; fold lower-cases A-Z."""
    out = np.empty(len(starts), U64)
    k = 0
    while k < len(starts):
        e = max(k + 1, int(np.searchsorted(ends, starts[k] + _BLOCK, "right")))
        lo, hi = int(starts[k]), int(ends[e - 1])
        part = _FOLD[data[lo:hi]] if fold else data[lo:hi]
        out[k:e] = Blocks(part, starts[k:e] - lo, ends[k:e] - lo).hashes(seed)
        k = e
    return out


_SHINGLE = np.array([0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3, 0x589965CC75374CC3, 0x1D8E4E27C47D124F], U64)


def shingle_hashes(words: np.ndarray, first: np.ndarray, short: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all five-word shingles in order, and each text's first shingle (n + 1 entries).

    With `short`, a text of one to four words has its whole sequence as its only shingle.
    """
    k = len(_SHINGLE)
    counts = np.diff(first)
    n = np.maximum(counts - k + 1, 0)
    tiny = (counts > 0) & (counts < k) if short else np.zeros(len(counts), bool)
    offs = np.concatenate([[0], np.cumsum(np.where(tiny, 1, n))])
    out = np.empty(offs[-1], U64)
    if len(words) >= k:
        size = len(words) - k + 1
        acc = np.zeros(size, U64)
        for j in range(k):
            acc += words[j : size + j] * _SHINGLE[j]
        keep = np.zeros(len(words) + 1, np.int32)
        np.add.at(keep, first[:-1], (n > 0).astype(np.int32))
        np.add.at(keep, first[:-1] + n, -(n > 0).astype(np.int32))
        inside = np.cumsum(keep[:size]) > 0
        target = np.ones(len(out), bool)
        target[offs[:-1][tiny]] = False
        out[target] = mix(acc[inside])
    for d in np.flatnonzero(tiny):
        h = 0x2545F4914F6CDD1D + int(counts[d])
        for x, c in zip(words[first[d] : first[d + 1]].tolist(), _SHINGLE.tolist()):
            h = ((h ^ x * c) * 0x9FB21C651E98DF25) % (1 << 64)
        out[offs[d]] = mix(np.array([h], U64))[0]
    return out, offs


def distinct_sorted(values: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each segment sorted, without repeats."""
    values = values.copy()
    for a, b in zip(offs[:-1].tolist(), offs[1:].tolist()):
        if b - a > 1:
            values[a:b].sort()
    keep = np.ones(len(values), bool)
    keep[1:] = values[1:] != values[:-1]
    keep[offs[:-1][offs[:-1] < len(values)]] = True
    total = np.concatenate([[0], np.cumsum(keep)])
    return values[keep], total[offs]


def multipliers(n: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """n odd multipliers and n offsets, fixed by the seed."""
    x = mix(np.arange(1, 2 * n + 1, dtype=U64) * U64(0x9E3779B97F4A7C15) + U64(seed))
    return x[:n] | U64(1), x[n:]


def ragged(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The indices start, start+1, ... of each of many runs, one after another."""
    total = int(lengths.sum())
    if not total:
        return np.zeros(0, np.int64)
    keep = lengths > 0
    s, n = starts[keep].astype(np.int64), lengths[keep].astype(np.int64)
    step = np.ones(total, np.int64)
    at = np.cumsum(n)[:-1]
    step[0] = s[0]
    step[at] = s[1:] - (s[:-1] + n[:-1] - 1)
    return np.cumsum(step)


def list_array(values: np.ndarray, width: int, kind: pa.DataType) -> pa.Array:
    """Rows of a matrix as an Arrow list column."""
    n = values.size // width if width else 0
    return pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * width), pa.array(values.reshape(-1), kind))


def binary_array(rows: list[bytes]) -> pa.Array:
    return pa.array(rows, pa.binary())

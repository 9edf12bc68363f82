"""Byte-level BPE encoding by speculation and verification, and decoding.

The vocabulary is a tokenizers JSON file of a byte-level BPE model without
normaliser; its text is broadcast (a file of fixed size). Texts are cut into
pieces by the model's split pattern, with vectorised rules on runs of letters,
digits, white space and other characters. Each distinct piece is encoded once
a worker, in batches:

1. speculate: greedy longest match walks all pieces through a trie at once,
2. verify: for every two neighbouring tokens, their merge trees are unwound
   from the join outwards. Byte pair merging would have merged across the join
   if and only if some pair of pieces that lived side by side has a merge that
   comes before the merges that took them up. Tokens whose joins all hold are
   what merging gives,
3. only pieces with a join that fails are merged exactly, pair by pair.

Pieces of up to LONG bytes walk side by side, a token a step. A longer one
would walk alone, so the longest match is found at each of its bytes, all at
once, and its tokens are the matches met in hops from the first byte.
"""

from __future__ import annotations

import heapq
import json
import unicodedata
from collections.abc import Iterator
from functools import lru_cache
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import _text as t
from ._intmap import IntMap, PieceCache
from ._session import ship

#: Bytes up to which pieces walk side by side, and are merged without a heap; results are the same beyond.
LONG = 64
#: Bytes of a longer piece that are matched at once.
_BLOCK = 1 << 16
#: White space of the split pattern.
_SPACES = [*range(9, 14), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
_SPACE, _LETTER, _DIGIT, _OTHER = range(4)


@lru_cache(1)
def _classes() -> np.ndarray:
    """The class of each code point."""
    first = {"L": _LETTER, "N": _DIGIT}
    out = np.fromiter((first.get(unicodedata.category(chr(c))[0], _OTHER) for c in range(0x110000)), np.uint8, 0x110000)
    out[_SPACES] = _SPACE
    return out


def _byte_classes(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The class of the code point that each byte is part of, and which bytes begin one."""
    table = _classes()
    out = table[:256][data]
    lead = (data & 0xC0) != 0x80
    high = np.flatnonzero(data >= 0xC0)
    if len(high):
        b = data[high].astype(np.uint32)
        follow = [data[np.minimum(high + k, len(data) - 1)].astype(np.uint32) & 63 for k in (1, 2, 3)]
        two, three = ((b & 31) << 6) | follow[0], ((b & 15) << 12) | (follow[0] << 6) | follow[1]
        four = ((b & 7) << 18) | (follow[0] << 12) | (follow[1] << 6) | follow[2]
        code = np.where(b < 0xE0, two, np.where(b < 0xF0, three, four))
        kind = table[np.minimum(code, 0x10FFFF)]
        out[high] = kind
        for k in (1, 2, 3):
            at = high + k
            ok = (at < len(data)) & (b >= (0, 0xC0, 0xE0, 0xF0)[k])
            out[at[ok]] = kind[ok]
    return out, lead


def piece_starts(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Where the pieces of texts begin, in bytes: contractions, runs with one space before them, and white space."""
    n = len(data)
    if not n:
        return np.zeros(0, np.int64)
    kind, lead = _byte_classes(data)
    edge = np.zeros(n + 1, bool)
    edge[offsets] = True
    begin = np.empty(n, bool)
    begin[0] = True
    begin[1:] = kind[1:] != kind[:-1]
    begin |= edge[:n]
    after_space = np.zeros(n, bool)
    after_space[1:] = (data[:-1] == 0x20) & ~edge[1:n]
    start = begin & ~((kind != _SPACE) & after_space)
    # The last white space before other characters is a piece of its own or goes with them.
    at = np.flatnonzero(begin & (kind != _SPACE) & ~edge[:n])
    at = at[kind[at - 1] == _SPACE] - 1
    while len(at):
        done = lead[at]
        start[at[done]] = True
        at = at[~done] - 1
    # Contractions: a lone apostrophe that no space precedes, and letters.
    quote = np.flatnonzero((data == 0x27) & begin & ~after_space)
    quote = quote[quote + 1 < n]
    quote = quote[(kind[quote + 1] == _LETTER) & ~edge[quote + 1]]
    if len(quote):
        one = data[quote + 1]
        there = (quote + 2 < n) & ~edge[np.minimum(quote + 2, n)]
        two = np.where(there, data[np.minimum(quote + 2, n - 1)], 0)
        short = np.isin(one, np.frombuffer(b"stmd", np.uint8))
        pair = ((one == ord("r")) | (one == ord("v"))) & (two == ord("e")) | (one == ord("l")) & (two == ord("l"))
        for q, size in ((quote[short], 2), (quote[pair & ~short], 3)):
            start[q + 1] = False
            rest = q + size
            rest = rest[(rest < n)]
            start[rest[(kind[rest] == _LETTER) & ~edge[rest]]] = True
    return np.flatnonzero(start)


def _byte_chars() -> dict[str, int]:
    """The byte that each character of a byte-level vocabulary stands for: printable ones for themselves, the rest from 256 on."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(own)]
    return {chr(b): b for b in own} | {chr(256 + k): b for k, b in enumerate(rest)}


class ByteBpe:
    """A byte-level BPE model from the text of its JSON file."""

    def __init__(self, spec: str):
        spec = json.loads(spec)
        model, back = spec["model"], _byte_chars()
        vocab = model["vocab"]
        self.special = {x["content"].encode(): x["id"] for x in spec["added_tokens"]}
        n = max([*vocab.values(), *self.special.values()]) + 1
        self.bytes = [b""] * n
        for s, i in vocab.items():
            self.bytes[i] = bytes(back[c] for c in s)
        for s, i in self.special.items():
            self.bytes[i] = s
        self.byte_id = np.zeros(256, np.uint32)
        for s, i in vocab.items():
            if len(s) == 1:
                self.byte_id[back[s]] = i
        self.rank = np.full(n, -1, np.int64)
        self.left, self.right = np.zeros(n, np.int64), np.zeros(n, np.int64)
        self.merges: dict[tuple[int, int], tuple[int, int]] = {}
        for r, m in enumerate(model["merges"]):
            a, b = m if isinstance(m, list) else m.split(" ")
            i, j, k = vocab[a], vocab[b], vocab[a + b]
            self.merges.setdefault((i, j), (r, k))
            if self.rank[k] < 0:
                self.rank[k], self.left[k], self.right[k] = r, i, j
        pairs = np.array(list(self.merges), np.uint64)
        self.pairs = IntMap(18)
        self.pairs.put((pairs[:, 0] << np.uint64(32) | pairs[:, 1]) + np.uint64(1), [r for r, _ in self.merges.values()])
        self._trie(set(vocab.values()))
        self.size = np.array([len(b) for b in self.bytes], np.int64)
        self.start = np.concatenate([[0], np.cumsum(self.size)[:-1]])
        self.flat = np.frombuffer(b"".join(self.bytes), np.uint8)
        self.cache = PieceCache()
        self.token_ok = self._alone()

    def _trie(self, usable: set[int]) -> None:
        edges: dict[int, int] = {}
        token = [-1]
        for i in sorted(usable):
            node = 0
            for b in self.bytes[i]:
                key = node * 256 + b
                if key not in edges:
                    edges[key] = len(token)
                    token.append(-1)
                node = edges[key]
            token[node] = i
        self.edges = IntMap(20)
        self.edges.put(np.array(list(edges), np.uint64) + np.uint64(1), list(edges.values()))
        self.token = np.array(token, np.int64)

    def _longest(self, data: np.ndarray, at: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The longest token that begins at each place and lies before the place's end, and where it stops."""
        node, pos = np.zeros(len(at), np.int64), at.copy()
        best, stop = np.full(len(at), -1, np.int64), at.copy()
        walk = np.arange(len(at))
        while len(walk):
            node_at = self.edges.get(node[walk].astype(np.uint64) * np.uint64(256) + data[pos[walk]] + np.uint64(1))
            on = node_at >= 0
            walk, node_at = walk[on], node_at[on]
            node[walk] = node_at
            pos[walk] += 1
            got = self.token[node_at]
            hit = got >= 0
            best[walk[hit]], stop[walk[hit]] = got[hit], pos[walk[hit]]
            walk = walk[pos[walk] < ends[walk]]
        return best, stop

    def _greedy(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Longest matches: flat ids and the number for each span."""
        spans, ids = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        live = np.flatnonzero(ends - starts <= LONG)
        at = starts[live]
        while len(live):
            best, stop = self._longest(data, at, ends[live])
            spans.append(live)
            ids.append(best)
            on = stop < ends[live]
            live, at = live[on], stop[on]
        for k in np.flatnonzero(ends - starts > LONG):
            found: list[np.ndarray] = []
            hop = 0  # where the next token begins, from the start of the block
            for lo in range(int(starts[k]), int(ends[k]), _BLOCK):
                places = np.arange(lo, min(lo + _BLOCK, int(ends[k])))
                best, stop = self._longest(data, places, np.full(len(places), ends[k]))
                to, met = (stop - lo).tolist(), []
                while hop < len(to):
                    met.append(hop)
                    hop = to[hop]
                hop -= len(to)
                found.append(best[met])
            ids += found
            spans.append(np.full(sum(map(len, found)), k))
        owner, flat = np.concatenate(spans), np.concatenate(ids)
        order = np.argsort(owner, kind="stable")
        return flat[order], np.bincount(owner, minlength=len(starts))

    def joins(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """Whether merging the bytes of tokens x and y gives x and y."""
        never = np.int64(1) << 40
        ok = np.ones(len(x), bool)
        rows, a, b = np.arange(len(x)), x.copy(), y.copy()
        above_a = np.full(len(x), never)
        above_b = np.full(len(x), never)
        while len(rows):
            m = self.pairs.get((a.astype(np.uint64) << np.uint64(32) | b.astype(np.uint64)) + np.uint64(1), int(never))
            # Merges of one rank go from left to right: the left side's comes before this one, this one before the right side's.
            broken = (m < above_a) & (m <= above_b) & (m < never)
            ok[rows[broken]] = False
            ra, rb = self.rank[a], self.rank[b]
            on = ~broken & ((ra >= 0) | (rb >= 0))
            rows, a, b, above_a, above_b, ra, rb = (v[on] for v in (rows, a, b, above_a, above_b, ra, rb))
            first = ra > rb
            above_a, above_b = np.where(first, ra, above_a), np.where(first, above_b, rb)
            a, b = np.where(first, self.right[a], a), np.where(first, b, self.left[b])
        return ok

    def merge(self, piece: bytes) -> list[int]:
        """Exact byte pair merging."""
        ids = self.byte_id[np.frombuffer(piece, np.uint8)].tolist()
        merges = self.merges
        if len(ids) <= LONG:
            while len(ids) > 1:
                best = min((merges.get(p, (1 << 40, 0)) + (i,) for i, p in enumerate(zip(ids, ids[1:]))))
                if best[0] == 1 << 40:
                    break
                rank, new, _ = best
                out, i = [], 0
                while i < len(ids):
                    if i + 1 < len(ids) and merges.get((ids[i], ids[i + 1]), (-1,))[0] == rank:
                        out.append(new)
                        i += 2
                    else:
                        out.append(ids[i])
                        i += 1
                ids = out
            return ids
        nxt, prev = list(range(1, len(ids) + 1)), list(range(-1, len(ids) - 1))
        heap = [(merges[p][0], i, *p) for i, p in enumerate(zip(ids, ids[1:])) if p in merges]
        heapq.heapify(heap)
        end = len(ids)
        while heap:
            _, i, a, b = heapq.heappop(heap)
            j = nxt[i] if ids[i] >= 0 else end
            if ids[i] != a or j >= end or ids[j] != b:
                continue
            ids[i], ids[j] = merges[a, b][1], -1
            nxt[i] = nxt[j]
            if nxt[i] < end:
                prev[nxt[i]] = i
                if (p := (ids[i], ids[nxt[i]])) in merges:
                    heapq.heappush(heap, (merges[p][0], i, *p))
            if prev[i] >= 0 and (p := (ids[prev[i]], ids[i])) in merges:
                heapq.heappush(heap, (merges[p][0], prev[i], *p))
        return [i for i in ids if i >= 0]

    def pieces(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Flat ids and their number for each of the pieces."""
        flat, sizes = self._greedy(data, starts, ends)
        owner = np.repeat(np.arange(len(starts)), sizes)
        inner = np.flatnonzero(owner[1:] == owner[:-1])
        pair = flat[inner].astype(np.uint64) << np.uint64(32) | flat[inner + 1].astype(np.uint64)
        pair, back = np.unique(pair, return_inverse=True)
        good = self.joins((pair >> np.uint64(32)).astype(np.int64), (pair & np.uint64(0xFFFFFFFF)).astype(np.int64))[back.reshape(-1)]
        bad = np.zeros(len(starts), bool)
        bad[owner[inner[~good]]] = True
        bad[owner[~self.token_ok[flat]]] = True
        exact = np.flatnonzero(bad)
        if not len(exact):
            return flat.astype(np.uint32), sizes
        found = [self.merge(data[starts[p] : ends[p]].tobytes()) for p in exact.tolist()]
        kept = flat[~bad[owner]]
        sizes[exact] = [len(f) for f in found]
        out = np.empty(int(sizes.sum()), np.uint32)
        begin = np.cumsum(sizes) - sizes
        out[t.ragged(begin[~bad], sizes[~bad])] = kept
        out[t.ragged(begin[exact], sizes[exact])] = np.concatenate([np.array(f, np.uint32) for f in found])
        return out, sizes

    def _alone(self) -> np.ndarray:
        """Whether merging a token's own bytes gives the token."""
        ok = self.rank < 0
        made = np.flatnonzero(~ok)
        ok[made] = [self.merge(self.bytes[k]) == [k] for k in made.tolist()]
        return ok

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Flat ids of texts in one buffer, and each text's first id (n + 1 entries)."""
        cuts, marks = offsets, np.zeros(0, np.int64)
        found = self._specials(data, offsets)
        if found:
            marks = np.array([a for a, _, _ in found], np.int64)
            cuts = np.unique(np.concatenate([offsets, marks, [b for _, b, _ in found]]))
        starts = piece_starts(data, cuts)
        for a, b, _ in found:
            starts = starts[(starts <= a) | (starts >= b)]
        ends = np.append(starts[1:], len(data)) if len(starts) else starts
        is_special = np.isin(starts, marks)
        plain = np.flatnonzero(~is_special)
        begin, size, pool = self.cache.lookup(data, starts[plain], ends[plain], lambda at: self.pieces(data, starts[plain[at]], ends[plain[at]]))
        sizes = np.ones(len(starts), np.int64)
        sizes[plain] = size
        first = np.concatenate([[0], np.cumsum(sizes)])
        if len(plain) == len(starts):
            ids = pool[t.ragged(begin, size)]
        else:
            ids = np.empty(first[-1], np.uint32)
            ids[t.ragged(first[plain], size)] = pool[t.ragged(begin, size)]
            ids[first[np.flatnonzero(is_special)]] = [i for _, _, i in found]
        return ids, first[np.searchsorted(starts, offsets)]

    def _specials(self, data: np.ndarray, offsets: np.ndarray) -> list[tuple[int, int, int]]:
        """(start, end, id) of the special tokens that the texts spell out."""
        raw = data.tobytes()
        found = []
        for s, i in self.special.items():
            at = raw.find(s)
            while at >= 0:
                k = int(np.searchsorted(offsets, at, "right"))
                if at + len(s) <= offsets[k]:
                    found.append((at, at + len(s), i))
                    at = raw.find(s, at + len(s))
                else:
                    at = raw.find(s, at + 1)
        return sorted(found)

    def decode(self, ids: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The bytes of texts of ids, and where each text begins (n + 1 entries)."""
        size = self.size[ids]
        data = self.flat[t.ragged(self.start[ids], size)]
        return data, np.concatenate([[0], np.cumsum(size)])[first]


_models: dict[int, ByteBpe] = {}


def _model(spec: str) -> ByteBpe:
    key = hash(spec)
    if key not in _models:
        _models.clear()
        _models[key] = ByteBpe(spec)
    return _models[key]


def round_trip(docs: DataFrame, path: str) -> DataFrame:
    """(doc_id, ids, decoded) for every row of docs(doc_id, text).

    ids: the token ids of the whole text as little-endian unsigned 32-bit
    integers, as the tokenizers library gives them with
    add_special_tokens=False; a special token that the text spells out becomes
    its id. decoded: the text that the ids stand for, from the ids alone. A
    null or empty text has no ids. Repeated rows give a row each; a null
    doc_id stays null; other columns are not read.
    """
    ship(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(Path(path).read_text())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = _model(shared.value)
        for batch in batches:
            for i, j, data, offsets in t.slices(batch.column(1)):
                ids, first = model.encode(data, offsets)
                text, begin = model.decode(ids, first)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(i, j - i),
                        pa.Array.from_buffers(pa.binary(), j - i, [None, pa.py_buffer((4 * first).astype(np.int32)), pa.py_buffer(ids.astype("<u4"))]),
                        pa.Array.from_buffers(pa.string(), j - i, [None, pa.py_buffer(begin.astype(np.int32)), pa.py_buffer(text)]),
                    ],
                    ["doc_id", "ids", "decoded"],
                )

    docs = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return docs.mapInArrow(run, "doc_id long, ids binary, decoded string")


def digests(docs: DataFrame, path: str) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256, ids) of round_trip's rows."""
    out = round_trip(docs, path)
    return out.select(
        "doc_id",
        F.expr("cast(octet_length(ids) / 4 as bigint)").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
        "ids",
    )

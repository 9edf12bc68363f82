"""Benchmark decontamination: exact lookup of short items, size-partitioned MinHash containment search of others.

Texts and items are lower-cased (A-Z), cut into words at ASCII white space and
into five-word shingles. An item leaks into a document if at least `percent`
of its distinct shingles are shingles of the document.

A short item has next to no Jaccard similarity with a long document, so the
search is partitioned by size. Every shingle of an item of up to EXACT
shingles is looked up in the documents, and a document that holds enough of
them is a candidate: none is missed. Longer items fall into classes by the
power of two that holds their shingles, and for a class of width s a document
is a row of windows of 2s shingles that overlap by half. A verbatim copy lies
within one window whole, where its similarity is 0.19 at least (0.25 when
complete), and one of SKETCH minhashes agrees with a probability above
1 - 2e-6. The minima of a block of MIN_WIDTH shingles are computed once; wider
windows take minima of minima. A document and an item that share a minhash in
a window of the item's class are a candidate pair. The hashes of their shingles,
counted for all pairs of a document at once, leave next to none but the leaks,
and the shingles themselves decide these.

Documents are read once and never shuffled. The items are broadcast, up to
BLOCK_BYTES with their tables; a larger benchmark takes a pass over the
documents for each such block, one block in a worker at a time.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import _text as t
from ._session import Scratch, ship

SKETCH = 64
#: Items of up to EXACT distinct shingles are looked up; the others' classes begin at the next power of two.
EXACT = 16
MIN_WIDTH = 2 * EXACT
#: Pairs of a document and an item of a looked-up shingle that are counted at once (one document's at least).
BLOCK_PAIRS = 1 << 20
#: Bytes of items and tables, as estimated, that are broadcast at once.
BLOCK_BYTES = 128 << 20

_MUL, _ADD = t.multipliers(SKETCH, 11)
_WORD = re.compile(r"[^\x20\x09-\x0D]+")
_LOWER = {c: c + 32 for c in range(65, 91)}


def shingle_strings(text: str | None) -> set[str]:
    w = _WORD.findall((text or "").translate(_LOWER))
    return {" ".join(w[i : i + 5]) for i in range(len(w) - 4)}


def _item_bytes(text: str) -> int:
    """What an item takes in Items at most: its minhashes with their places and bits, its shingles' hashes twice, its text."""
    return SKETCH * (4 + 4 + 8) + 9 * len(text) + 200


class Items:
    """The minhash tables of one block of benchmark items."""

    def __init__(self, rows: list[tuple[int, str]]):
        self.ids = np.array([i for i, _ in rows], np.int64)
        self.texts = [x for _, x in rows]
        size = self.size = np.array([len(shingle_strings(x)) for x in self.texts], np.int64)
        self.flat, self.first = t.distinct_sorted(*_hashed(pa.array(self.texts, pa.string())))
        width = np.where(size > EXACT, np.maximum(MIN_WIDTH, 1 << np.ceil(np.log2(np.maximum(size, 1))).astype(int)), 0)
        some = np.flatnonzero(size)
        self.classes = []
        self._lookup([(i, h) for i in np.flatnonzero((size > 0) & (size <= EXACT)) for h in self.flat[self.first[i] : self.first[i + 1]]])
        mins = np.zeros((len(rows), SKETCH), np.uint32)
        if len(some):
            for k in range(SKETCH):
                mins[some, k] = np.minimum.reduceat(_hash(self.flat, k), self.first[:-1][some])
        for w in sorted({int(x) for x in width[width > 0]}):
            of = np.flatnonzero(width == w).astype(np.int32)
            bits = max(8, int(np.ceil(np.log2(len(of)))) + 5)
            tables = []
            for k in range(SKETCH):
                order = np.argsort(mins[of, k], kind="stable")
                seen = np.zeros(1 << bits, bool)
                seen[mins[of, k] & np.uint32((1 << bits) - 1)] = True
                tables.append((np.packbits(seen, bitorder="little"), mins[of, k][order], of[order]))
            self.classes.append((w, bits, tables))

    def _lookup(self, rows: list[tuple[int, int]]) -> None:
        """A table of the short items' shingles: a bit map, the distinct hashes, and the items of each."""
        item, hashes = np.array([i for i, _ in rows], np.int64), np.array([h for _, h in rows], np.uint64)
        order = np.argsort(hashes, kind="stable")
        self.short, begin = np.unique(hashes[order], return_index=True)
        self.short_items = item[order]
        self.short_begin = np.append(begin, len(order)).astype(np.int64)
        self.short_bits = max(8, int(np.ceil(np.log2(len(order) + 1))) + 4)
        seen = np.zeros(1 << self.short_bits, bool)
        seen[(self.short & np.uint64(len(seen) - 1)).astype(np.int64)] = True
        self.short_seen = np.packbits(seen, bitorder="little")


def _hash(flat: np.ndarray, k: int) -> np.ndarray:
    return ((flat * _MUL[k] + _ADD[k]) >> np.uint64(32)).astype(np.uint32)


def _hashed(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    flats, sizes = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
    for _, _, flat, offs in _shingles(texts):
        flats.append(flat)
        sizes.append(np.diff(offs))
    return np.concatenate(flats), np.concatenate([[0], np.cumsum(np.concatenate(sizes))])


def _shingles(texts: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    for i, j, data, offsets in t.slices(texts, t.SLICE_BYTES // 2):
        starts, ends, first = t.word_bounds(data, offsets)
        yield i, j, *t.shingle_hashes(t.span_hashes(data, starts, ends), first, short=False)


def _windows(offs: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Each text's number of blocks of the width, and its first block (n + 1 entries)."""
    n = -(-np.diff(offs) // width)
    return n, np.concatenate([[0], np.cumsum(n)])


def looked_up(items: Items, flat: np.ndarray, offs: np.ndarray, percent: int) -> np.ndarray:
    """Pairs (text * items + item) of the short items of which a text holds percent of the shingles."""
    none = np.zeros(0, np.int64)
    if not len(items.short) or not len(flat):
        return none
    key = (flat & np.uint64((1 << items.short_bits) - 1)).astype(np.int64)
    at = np.flatnonzero((items.short_seen[key >> 3] >> (key & 7).astype(np.uint8)) & np.uint8(1))
    k = np.searchsorted(items.short, flat[at])
    ok = items.short[np.minimum(k, len(items.short) - 1)] == flat[at]
    doc = np.searchsorted(offs, at[ok], "right") - 1
    held = np.unique(doc * len(items.short) + k[ok])  # a shingle counts once a text
    doc, k = np.divmod(held, len(items.short))
    many = np.diff(items.short_begin)[k]
    total = np.concatenate([[0], np.cumsum(many)])
    cut = np.append(np.flatnonzero(np.diff(doc, prepend=-1)), len(doc))  # where each text's shingles begin
    found, lo = [none], 0
    while lo < len(cut) - 1:
        hi = max(lo + 1, int(np.searchsorted(total[cut], total[cut[lo]] + BLOCK_PAIRS, "right")) - 1)
        part = slice(cut[lo], cut[hi])
        item = items.short_items[t.ragged(items.short_begin[k[part]], many[part])]
        pair, shared = np.unique(np.repeat(doc[part], many[part]) * len(items.ids) + item, return_counts=True)
        found.append(pair[100 * shared >= percent * items.size[pair % len(items.ids)]])
        lo = hi
    return np.concatenate(found)


def candidates(items: Items, flat: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """Pairs (text * items + item) that share a minhash in a window of the item's class."""
    found = np.zeros(0, np.int64)
    n, first = _windows(offs, MIN_WIDTH)
    if not len(flat) or not items.classes:
        return found
    inner = np.arange(first[-1]) - np.repeat(first[:-1], n)
    starts = np.repeat(offs[:-1], n) + inner * MIN_WIDTH
    shape = {}
    for w, _, _ in items.classes:
        m, begin = _windows(offs, w)
        rank = np.arange(begin[-1]) - np.repeat(begin[:-1], m)
        shape[w] = (np.repeat(first[:-1], m) + rank * (w // MIN_WIDTH), np.repeat(np.arange(len(m)), m), rank + 1 < np.repeat(m, m))
    for k in range(SKETCH):
        low = np.minimum.reduceat(_hash(flat, k), starts)
        new = [found]
        for w, bits, tables in items.classes:
            at, doc, more = shape[w]
            block = low if w == MIN_WIDTH else np.minimum.reduceat(low, at)
            window = block.copy()
            window[:-1] = np.where(more[:-1], np.minimum(block[:-1], block[1:]), block[:-1])
            seen, values, of = tables[k]
            key = window & np.uint32((1 << bits) - 1)
            hit = np.flatnonzero((seen[key >> np.uint32(3)] >> (key & np.uint32(7)).astype(np.uint8)) & np.uint8(1))
            if len(hit):
                a, b = np.searchsorted(values, window[hit], "left"), np.searchsorted(values, window[hit], "right")
                new.append(np.repeat(doc[hit], b - a) * len(items.ids) + of[t.ragged(a, b - a)])
        if len(new) > 1:
            found = np.unique(np.concatenate(new))
    return found


def _counted(items: Items, flat: np.ndarray, offs: np.ndarray, pairs: np.ndarray, percent: int) -> np.ndarray:
    """The pairs that hold by the hashes of the shingles."""
    doc, item = np.divmod(pairs, len(items.ids))
    keep = np.zeros(len(pairs), bool)
    cut = np.append(np.flatnonzero(np.diff(doc, prepend=-1)), len(doc))
    for lo, hi in zip(cut[:-1].tolist(), cut[1:].tolist()):
        own = np.unique(flat[offs[doc[lo]] : offs[doc[lo] + 1]])
        at = lo
        while at < hi:  # so many items at once as have BLOCK_PAIRS shingles, one at least
            many = np.diff(items.first)[item[at:hi]]
            e = at + max(1, int(np.searchsorted(np.cumsum(many), BLOCK_PAIRS, "right")))
            many = many[: e - at]
            wanted = items.flat[t.ragged(items.first[item[at:e]], many)]
            held = own[np.minimum(np.searchsorted(own, wanted), len(own) - 1)] == wanted
            both = np.add.reduceat(held.astype(np.int64), np.cumsum(many) - many)
            keep[at:e] = 100 * both >= percent * many
            at = e
    return pairs[keep]


def leaks(items: Items, texts: pa.Array, percent: int) -> list[tuple[int, int, int]]:
    """(text, item, shared shingles) positions, in order, of the pairs that hold."""
    out = []
    for i, j, flat, offs in _shingles(texts):
        pairs = np.unique(np.concatenate([looked_up(items, flat, offs, percent), candidates(items, flat, offs)]))
        own: tuple[int, set[str]] = (-1, set())
        for pair in _counted(items, flat, offs, pairs, percent).tolist():
            d, item = divmod(pair, len(items.ids))
            if own[0] != d:
                own = d, shingle_strings(texts[i + d].as_py())
            both = len(own[1] & shingle_strings(items.texts[item]))
            if 100 * both >= percent * items.size[item]:
                out.append((i + d, item, both))
    return out


def _blocks(benchmark: DataFrame) -> Iterator[list[tuple[int, str]]]:
    """The benchmark's items with an id and a text, in blocks of bounded size."""
    rows: list[tuple[int, str]] = []
    size = 0
    items = benchmark.where("item_id is not null and text is not null").select(F.col("item_id").cast("long"), "text").distinct().orderBy("item_id", "text")
    for r in items.toLocalIterator():
        n = _item_bytes(r[1])
        if rows and size + n > BLOCK_BYTES:
            yield rows
            rows, size = [], 0
        rows.append((r[0], r[1]))
        size += n
    if rows:
        yield rows


def find_leaks(docs: DataFrame, benchmark: DataFrame, percent: int = 80) -> DataFrame:
    """(doc_id, item_id, n_item_shingles, n_shared, containment) for each leaked item of each document.

    Documents(doc_id, text) and benchmark(item_id, text); other columns are not
    read. Items without an id or a text and items of fewer than five words
    leak nowhere; a null or short document holds nothing; a very long one is
    searched whole, a slice of its own. Repeated documents give a row each; an
    item that is repeated with its id gives one. A null doc_id stays null.
    """
    if not 80 <= percent <= 100:
        raise ValueError("percent: 80 to 100")
    spark = docs.sparkSession
    ship(spark)
    schema = "doc_id long, item_id long, n_item_shingles long, n_shared long, containment double"
    out = spark.createDataFrame([], schema)
    docs = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    for rows in _blocks(benchmark):
        shared = spark.sparkContext.broadcast(Items(rows))

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            items = shared.value
            for batch in batches:
                hits = leaks(items, batch.column(1), percent)
                if hits:
                    size = [int(items.size[i]) for _, i, _ in hits]
                    yield pa.RecordBatch.from_arrays(
                        [
                            batch.column(0).take(pa.array([d for d, _, _ in hits])),
                            pa.array(items.ids[[i for _, i, _ in hits]]),
                            pa.array(size, pa.int64()),
                            pa.array([n for _, _, n in hits], pa.int64()),
                            pa.array([n / s for (_, _, n), s in zip(hits, size)], pa.float64()),
                        ],
                        ["doc_id", "item_id", "n_item_shingles", "n_shared", "containment"],
                    )

        out = out.unionByName(docs.mapInArrow(run, schema))
    return out


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, percent: int = 80) -> DataFrame:
    """docs without the rows into which an item leaks (see find_leaks); all columns stay, and nothing is shuffled.

    Beyond one block of items, what each block leaves is written before the
    next block is broadcast.
    """
    ship(docs.sparkSession)
    scratch = Scratch(docs.sparkSession, "decontam")
    for k, rows in enumerate(_blocks(benchmark)):
        if k:
            docs = scratch.table(docs, f"left{k}")
        shared = docs.sparkSession.sparkContext.broadcast(Items(rows))

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                keep = np.ones(batch.num_rows, bool)
                keep[[d for d, _, _ in leaks(shared.value, batch.column("text"), percent)]] = False
                yield batch.filter(pa.array(keep))

        docs = docs.mapInArrow(run, docs.schema)
    return docs

"""Katz backoff language model: training on all documents of a table and scoring all of them.

Tokens are words (A-Z lower-cased, cut at ASCII white space) and one end a
document; an unknown word is the one class of all words that training lacks.

    P1(w)   = d(c) c / N, and the class of unknown words has what is left
    Pk(w|h) = d(c) c / T(h)          if the k-gram h w was seen, c times
            = a(h) P(k-1)(w|h')      if only h was seen; h' is h without its first word
            = P(k-1)(w|h')           else

d(c) is the Good-Turing (Katz) discount up to GT, 1 beyond; where the counts
of counts give no valid one, an absolute discount. T(h) is the number of
k-grams that begin with h, and

    a(h) = (1 - sum of Pk(w|h) over seen w) / (1 - sum of P(k-1)(w|h') over seen w)

so that every Pk(.|h) sums to one over the known words and the unknown class.
Where all followers of h have counts beyond GT, which leaves nothing, T(h) is
taken one larger. A document's first words follow a start mark.

How it runs. The corpus is cut into chunks of about CHUNK_TOKENS tokens, each
one row of a bucketed table: a vocabulary of word hashes, and the tokens as
positions in it. Every chunk adds up its own n-grams, and sends them level by level, sorted, packed and compressed,
to the parts of a table that is partitioned by context; what is empty is not
sent, so there is one row for each chunk and part, and never more than n-grams. A part merges what the
chunks sent, and returns to each chunk the counts of its n-grams and, of each
context, the number of n-grams, their counts of counts up to GT and the
lower-order mass of its followers; the discounts, which need all parts' counts
of counts, are known afterwards, and give the weights from these sums. The
replies are the level's stored table; they meet the chunks by bucket, so that
the chunks themselves are written once and never shuffled. Nothing that grows
with the corpus passes through the driver: it sees a few sums.

Where the level below is the words', its probabilities are functions of counts,
and counts travel in their place: they pack into a byte or two.

A context with a large share of all n-grams is split over several parts by its
next word, by its count in the level below, and its sums are added up again.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import _text as t
from ._session import Scratch, remainder, ship

CHUNK_TOKENS = 1_000_000
#: Bytes of text whose chunks one bucket gets on average.
BUCKET_BYTES = 64 << 20
#: N-grams, as sent, that a part of a table gets on average.
PART_ENTRIES = 1_500_000
#: Counts that are discounted.
GT = 5

END = np.uint64(0x5851F42D4C957F2D)
_START = -1
_SPLIT = np.uint64(0x9E3779B97F4A7C15)


def pack(values: np.ndarray) -> bytes:
    """Numbers of 8 bytes, by byte planes, compressed."""
    raw = np.ascontiguousarray(values).view(np.uint8).reshape(-1, 8)
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(raw.T).tobytes())


def unpack(data: bytes, kind: type = np.int64) -> np.ndarray:
    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8)
    return np.ascontiguousarray(raw.reshape(8, -1).T).view(kind).reshape(-1)


def _batch(columns: dict) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(list(columns.values()), list(columns))


# Chunks

_BODY = ("docs", "lengths", "train", "places", "tokens")
_CHUNK = f"chunk long, n_tokens long, {', '.join(f'{c} binary' for c in _BODY)}, words binary, seen binary"


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    part = TaskContext.get().partitionId()
    held: list[tuple] = []
    size = made = 0

    def chunk() -> dict:
        ids, train, lengths, hashes = (np.concatenate(x) for x in zip(*held))
        words, back, count = np.unique(hashes, return_inverse=True, return_counts=True)
        back = back.reshape(-1)
        order = np.argsort(-count, kind="stable")  # frequent words get small numbers, which pack well
        rank = np.empty(len(order), np.int64)
        rank[order] = np.arange(len(order))
        return {
            "chunk": (part << 32) + made,
            "n_tokens": len(back),
            "docs": ids,
            "lengths": lengths,
            "train": train.astype(np.int64),
            "places": order,
            "tokens": rank[back],
            "words": words.view(np.int64),
            "seen": np.bincount(back[np.repeat(train, lengths)], minlength=len(words)),
        }

    for batch in batches:
        names = np.asarray(batch.column(0).fill_null(-(1 << 63)))
        known = np.asarray(batch.column(1))
        for i, j, data, offsets in t.slices(batch.column(2)):
            starts, ends, first = t.word_bounds(data, offsets)
            lengths = np.diff(first) + 1
            flat = np.full(len(starts) + j - i, END, np.uint64)
            inner = np.ones(len(flat), bool)
            inner[np.cumsum(lengths) - 1] = False
            flat[inner] = t.span_hashes(data, starts, ends)
            held.append((names[i:j], known[i:j], lengths, flat))
            size += len(flat)
            if size >= CHUNK_TOKENS:
                yield chunk()
                held, size, made = [], 0, made + 1
    if held:
        yield chunk()


def _tokenise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for c in _chunks(batches):
        row = {k: pa.array([c[k]], pa.int64()) for k in ("chunk", "n_tokens")}
        yield _batch(row | {k: pa.array([pack(c[k])], pa.binary()) for k in (*_BODY, "words", "seen")})


# Level 1: words

_ASK1 = "part long, chunk long, words binary, seen binary"
_REPLY = "level int, chunk long, part long, counts binary, ids binary, sums binary, lower binary, info array<long>"


def _parts_of(keys: np.ndarray, parts: int) -> np.ndarray:
    return ((t.mix(keys * _SPLIT) >> np.uint64(11)) % np.uint64(parts)).astype(np.int64)


def _ask_words(parts: int):
    """A chunk's words in ascending order of their hash, cut into a stretch for each part."""
    step = (1 << 64) // parts + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                words, seen = unpack(r["words"], np.uint64), unpack(r["seen"])
                cut = np.append(np.searchsorted(words, np.array([p * step for p in range(parts)], np.uint64)), len(words))
                rows = [(p, r["chunk"], pack(words[a:b]), pack(seen[a:b])) for p, (a, b) in enumerate(zip(cut[:-1], cut[1:])) if a < b]
                kinds = (pa.int64(), pa.int64(), pa.binary(), pa.binary())
                yield _batch({k: pa.array(v, kind) for k, v, kind in zip(("part", "chunk", "words", "seen"), zip(*rows), kinds)})

    return run


def _reply_rows(rows: list[dict]) -> pa.Table:
    kinds = {"level": pa.int32(), "chunk": pa.int64(), "part": pa.int64(), "counts": pa.binary(), "ids": pa.binary(), "sums": pa.binary(), "lower": pa.binary(), "info": pa.list_(pa.int64())}
    return pa.table({k: pa.array([r.get(k) for r in rows], v) for k, v in kinds.items()})


def _info(counts: np.ndarray) -> list[int]:
    """The sum of the counts, how many are over 0, and the counts of counts up to GT + 1."""
    of = np.bincount(np.minimum(counts, GT + 2), minlength=GT + 3)
    return [int(counts.sum()), int((counts > 0).sum()), *of[1 : GT + 2].tolist()]


def _numbered(counts: np.ndarray, part: int, parts: int) -> np.ndarray:
    """A global number for each seen entry of a part, small for frequent ones; -2 for the others."""
    ids = np.full(len(counts), -2, np.int64)
    order = np.argsort(-counts, kind="stable")
    order = order[counts[order] > 0]
    ids[order] = np.arange(len(order)) * parts + part
    return ids


def _count_words(parts: int):
    def run(group: pa.Table) -> pa.Table:
        part = group.column("part")[0].as_py()
        chunks = group.column("chunk").to_pylist()
        words = [unpack(x, np.uint64) for x in group.column("words").to_pylist()]
        seen = np.concatenate([unpack(x) for x in group.column("seen").to_pylist()])
        distinct, back = np.unique(np.concatenate(words), return_inverse=True)
        back = back.reshape(-1)
        counts = np.bincount(back, seen, len(distinct)).astype(np.int64)
        ids = _numbered(counts, part, parts)
        rows = [{"level": 1, "chunk": -1, "part": part, "info": _info(counts)}]
        at = 0
        for c, w in zip(chunks, words):
            own = back[at : at + len(w)]
            rows.append({"level": 1, "chunk": c, "part": part, "counts": pack(counts[own]), "ids": pack(ids[own])})
            at += len(w)
        return _reply_rows(rows)

    return run


# Discounts


def discounts(of: list[int]) -> np.ndarray:
    """d(c) for c from 0 to GT: Katz's, if all lie within (0, 1], else absolute."""
    n = np.array([0, *of], float)
    d = np.ones(GT + 1)
    if (n[1 : GT + 2] > 0).all():
        r = np.arange(1, GT + 1)
        cut = (GT + 1) * n[GT + 1] / n[1]
        if cut < 1:
            d[1:] = ((r + 1) * n[2 : GT + 2] / n[1 : GT + 1] / r - cut) / (1 - cut)
            if (d[1:] > 0).all() and (d[1:] < 1).any() and (d[1:] <= 1).all():
                return d
    share = n[1] / (n[1] + 2 * n[2]) if n[1] and n[2] else 0.5
    d[1:] = 1 - share / np.arange(1, GT + 1)
    return d


class Level:
    """The global sums of one level."""

    def __init__(self, info: list[int]):
        self.n, self.v, *self.of = info
        self.d = discounts(self.of)

    def discounted(self, counts: np.ndarray) -> np.ndarray:
        return counts * self.d[np.where(counts <= GT, counts, 0)]

    def unknown(self) -> tuple[float, float]:
        """(P1 of the unknown class, what known words' d(c) c is divided by)."""
        low = np.arange(1, GT + 1)
        m = np.array(self.of[:GT])
        free = float((m * low * (1 - self.d[1:])).sum())
        if free <= 0:  # nothing is discounted
            return 1 / (self.n + 1), self.n + 1.0
        return free / self.n, float(self.n)

    def word(self, counts: np.ndarray) -> np.ndarray:
        """P1 of words of these counts; a count of 0 is the unknown class."""
        rest, total = self.unknown()
        return np.where(counts > 0, self.discounted(counts) / total, rest)


# Levels above: contexts and the words that follow them


class Chunk:
    """A chunk, its n-grams level by level, and what the tables said of them."""

    def __init__(self, row: dict, parts: int, hot: int):
        self.parts, self.hot, self.depth = parts, hot, 1
        self.docs, self.lengths = unpack(row["docs"]), unpack(row["lengths"])
        self.train = unpack(row["train"]).astype(bool)
        self.places, self.tokens = unpack(row["places"]), unpack(row["tokens"])
        self.first = np.cumsum(self.lengths) - self.lengths
        self.learned = np.repeat(self.train, self.lengths)

    def level1(self, replies: list[dict], level: Level) -> None:
        # The parts' stretches, one after another, are the words in the order of their hashes.
        counts = np.concatenate([unpack(r["counts"]) for r in replies])
        if len(counts) != len(self.places):
            raise ValueError("a part's reply is missing")
        self.count = counts[self.places]
        self.id = np.concatenate([unpack(r["ids"]) for r in replies])[self.places]
        self.p = level.word(self.count)
        self.gram, self.gram_id, self.gram_count = self.tokens, self.id, self.count

    def grams(self, starts: int) -> dict:
        """The next level's distinct n-grams of the chunk, and the requests for them in the order of their parts.

        starts: how often the start mark is a context.
        """
        context = np.empty(len(self.gram), np.int64)
        context[1:] = self.gram[:-1]
        context[self.first] = len(self.gram_id)  # the start mark
        width = len(self.places)
        keys, at, back, _ = np.unique(context * width + self.tokens, return_index=True, return_inverse=True, return_counts=True)
        back = back.reshape(-1)
        g = {"context": keys // width, "word": keys % width, "lower": self.p[self.gram[at]], "back": back}
        g["seen"] = np.bincount(back[self.learned], minlength=len(keys))
        # Contexts and how many parts each is spread over.
        ids = np.append(self.gram_id, _START if starts else -2)
        times = np.append(self.gram_count, starts)
        used = np.unique(g["context"])
        used = used[ids[used] != -2]
        spread = 1 + times[used] // self.hot
        asked = np.repeat(np.arange(len(used)), spread)
        salt = t.ragged(np.zeros(len(used), np.int64), spread)
        part = _parts_of(ids[used][asked].astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93) + salt.astype(np.uint64), self.parts)
        order = np.lexsort((salt, ids[used][asked], part))
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        g |= {"used": used, "asked": asked[order], "part": part[order], "ask_id": ids[used][asked][order], "salt": salt[order]}
        # Entries: n-grams of a known context and a known word.
        spot = np.full(len(ids), -1, np.int64)
        spot[used] = np.arange(len(used))
        entry = np.flatnonzero((spot[g["context"]] >= 0) & (self.count[g["word"]] > 0))
        c = spot[g["context"][entry]]
        word = self.id[g["word"][entry]]
        which = (t.mix(word.astype(np.uint64)) % spread[c].astype(np.uint64)).astype(np.int64)
        request = place[(np.cumsum(spread) - spread)[c] + which]
        sort = np.lexsort((word, request))
        g |= {"entry": entry[sort], "request": request[sort], "word_id": word[sort]}
        return g

    def level(self, replies: list[dict], below: Level, level: Level, starts: int) -> None:
        g = self.grams(starts)
        n, m = len(g["context"]), len(g["used"])
        counts, ids = np.zeros(n, np.int64), np.full(n, -2, np.int64)
        sums = np.zeros((m, 1 + GT), np.int64)
        words, lower = np.zeros((m, 1 + GT), np.int64), np.zeros(m)
        for r in replies:
            lo, hi = np.searchsorted(g["part"], [r["part"], r["part"] + 1])
            a, b = np.searchsorted(g["request"], [lo, hi])
            at = g["entry"][a:b]
            counts[at] = unpack(r["counts"])
            if r["ids"] is not None:
                ids[at] = unpack(r["ids"])
            np.add.at(sums, g["asked"][lo:hi], unpack(r["sums"]).reshape(1 + GT, -1).T)
            if self.depth == 1:
                np.add.at(words, g["asked"][lo:hi], unpack(r["lower"]).reshape(1 + GT, -1).T)
            else:
                np.add.at(lower, g["asked"][lo:hi], unpack(r["lower"], np.float64))
        total, low = sums[:, 0], sums[:, 1:]
        if self.depth == 1:
            lower = (words[:, 0] + (words[:, 1:] * np.arange(1, GT + 1) * below.d[1:]).sum(1)) / below.unknown()[1]
        free = (low * np.arange(1, GT + 1) * (1 - level.d[1:])).sum(1)
        over = np.where(free > 0, total, total + 1)  # what d(c) c is divided by
        free = np.where(free > 0, free, 1.0)
        with np.errstate(divide="ignore", invalid="ignore"):
            weight = np.where(total > 0, free / over / np.maximum(1 - lower, 1e-300), 1.0)
        spot = np.full(len(self.gram_id) + 1, -1, np.int64)
        spot[g["used"]] = np.arange(m)
        c = spot[g["context"]]
        p = g["lower"] * np.where(c >= 0, np.append(weight, 1.0)[c], 1.0)
        hit = counts > 0
        p[hit] = level.discounted(counts[hit]) / over[c[hit]]
        self.gram, self.gram_id, self.gram_count, self.p = g["back"], ids, counts, p
        self.depth += 1


_ASK = "part long, chunk long, contexts binary, salts binary, sizes binary, words binary, seen binary, lower binary"


def _state(body: pa.Table, replied: pa.Table, levels: list[Level], parts: int, hot: int, starts: int) -> tuple[int, Chunk]:
    (body,), rows = body.to_pylist(), replied.to_pylist()
    replies = [sorted((r for r in rows if r["level"] == k + 1), key=lambda r: r["part"]) for k in range(len(levels))]
    chunk = Chunk(body, parts, hot)
    chunk.level1(replies[0], levels[0])
    for k in range(1, len(levels)):
        chunk.level(replies[k], levels[k - 1], levels[k], starts)
    return body["chunk"], chunk


def _ask(levels: list[Level], parts: int, hot: int, starts: int):
    def run(body: pa.Table, replied: pa.Table) -> pa.Table:
        number, chunk = _state(body, replied, levels, parts, hot, starts)
        g = chunk.grams(starts)
        size = np.bincount(g["request"], minlength=len(g["part"]))
        seen = g["seen"][g["entry"]]
        lower = chunk.count[g["word"][g["entry"]]] if chunk.depth == 1 else g["lower"][g["entry"]]
        out: dict[str, list] = {k.split()[0]: [] for k in _ASK.split(", ")}
        for p in np.unique(g["part"]).tolist():
            lo, hi = np.searchsorted(g["part"], [p, p + 1])
            a, b = np.searchsorted(g["request"], [lo, hi])
            for k, v in zip(out, (p, number, *map(pack, (g["ask_id"][lo:hi], g["salt"][lo:hi], size[lo:hi], g["word_id"][a:b], seen[a:b], lower[a:b])))):
                out[k].append(v)
        return pa.table({k: pa.array(v, pa.int64() if k in ("part", "chunk") else pa.binary()) for k, v in out.items()})

    return run


def _count(level: int, parts: int, last: bool):
    def run(group: pa.Table) -> pa.Table:
        rows = group.to_pylist()
        part = rows[0]["part"]
        contexts, salts, sizes = ([unpack(r[k]) for r in rows] for k in ("contexts", "salts", "sizes"))
        salt = np.concatenate(salts)
        _, context = np.unique(np.concatenate(contexts), return_inverse=True)  # numbered anew, so that it and the salt fit one number
        asked, request = np.unique(context.reshape(-1) * (int(salt.max(initial=0)) + 1) + salt, return_inverse=True)
        request = request.reshape(-1)
        word = np.concatenate([unpack(r["words"]) for r in rows])
        of = np.repeat(request, np.concatenate(sizes))
        order = np.lexsort((word, of))
        new = np.ones(len(order), bool)
        new[1:] = (word[order][1:] != word[order][:-1]) | (of[order][1:] != of[order][:-1])
        back = np.empty(len(order), np.int64)
        back[order] = np.cumsum(new) - 1
        first = order[new]
        n = len(first)
        counts = np.bincount(back, np.concatenate([unpack(r["seen"]) for r in rows]), n).astype(np.int64)
        lower = np.concatenate([unpack(r["lower"], np.int64 if level == 2 else np.float64) for r in rows])[first]
        context = of[first]
        seen = counts > 0
        m = len(asked)
        sums = np.empty((1 + GT, m), np.int64)
        sums[0] = np.bincount(context, counts, m)
        for k in range(1, GT + 1):
            sums[k] = np.bincount(context[counts == k], minlength=m)
        if level == 2:  # lower is a count: the sum of those over GT, and how many have each count up to GT
            mass = np.empty((1 + GT, m), np.int64)
            mass[0] = np.bincount(context[seen], np.where(lower[seen] > GT, lower[seen], 0), m)
            for k in range(1, GT + 1):
                mass[k] = np.bincount(context[seen & (lower == k)], minlength=m)
        else:
            mass = np.bincount(context[seen], lower[seen], m)[None, :]
        ids = None if last else _numbered(counts, part, parts)
        out = [{"level": level, "chunk": -1, "part": part, "info": _info(counts)}]
        at = ask = 0
        for r, size in zip(rows, sizes):
            k, q = int(size.sum()), len(size)
            own, req = back[at : at + k], request[ask : ask + q]
            reply = {"level": level, "chunk": r["chunk"], "part": part, "counts": pack(counts[own]), "sums": pack(sums[:, req]), "lower": pack(mass[:, req])}
            out.append(reply if last else reply | {"ids": pack(ids[own])})
            at, ask = at + k, ask + q
        return _reply_rows(out)

    return run


_SCORED = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"


def _score(levels: list[Level], parts: int, hot: int, starts: int):
    def run(body: pa.Table, replied: pa.Table) -> pa.Table:
        _, c = _state(body, replied, levels, parts, hot, starts)
        n, v = levels[0].n, levels[0].v
        base = np.log10((c.count + 1) / (n + v + 1))[c.tokens]
        with np.errstate(divide="ignore"):
            score = np.log10(c.p)[c.gram]
        add = lambda x: np.add.reduceat(x, c.first)
        null = c.docs == -(1 << 63)
        return pa.table(
            {
                "doc_id": pa.array(c.docs, mask=null),
                "held_out": pa.array(~c.train),
                "n_tokens": pa.array(c.lengths),
                "n_known": pa.array(add((c.count > 0).astype(np.int64)[c.tokens])),
                "train_tokens": pa.array(np.full(len(c.docs), n)),
                "base_score": pa.array(add(base)),
                "score": pa.array(add(score)),
            }
        )

    return run


def score(docs: DataFrame, order: int = 2) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) for every row of docs(doc_id, text).

    Learns from the documents whose crc32(doc_id as text) mod 7 is not 2 and
    scores all. Scores are log10 probabilities of a whole text and its end;
    base_score is the add-one unigram model's. A null or empty text is its end
    alone. A null doc_id is held out. Repeated rows each count and each get a
    score. With no training document every word is unknown: score is 0 a token
    and base_score log10(1/1). Other columns are not read.
    """
    if order < 1:
        raise ValueError("order: 1 or more")
    spark = docs.sparkSession
    ship(spark)
    scratch = Scratch(spark, "katz")
    train = F.coalesce(remainder("doc_id", 7) != 2, F.lit(False))
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), train.alias("train"), F.col("text").cast("string").alias("text"))
    size, starts = docs.agg(F.sum(F.octet_length("text")), F.count_if("train")).first()
    made = scratch.bucketed(docs.mapInArrow(_tokenise, _CHUNK), "chunks", "chunk", -(-(size or 0) // BUCKET_BYTES))
    tokens = made.agg(F.sum("n_tokens")).first()[0] or 0
    chunks = made.drop("words", "seen")
    parts = max(4, -(-tokens // PART_ENTRIES))
    hot = PART_ENTRIES // 4

    def reply(frame: DataFrame, k: int) -> tuple[DataFrame, Level]:
        table = scratch.table(frame, f"level{k}", "none")
        sums = table.where("chunk = -1").agg(*(F.sum(F.get("info", F.lit(i))) for i in range(GT + 3))).first()
        return table.where("chunk >= 0").drop("info"), Level([x or 0 for x in sums])

    asked = made.select("chunk", "words", "seen").mapInArrow(_ask_words(parts), _ASK1)
    replies, level = reply(asked.groupBy("part").applyInArrow(_count_words(parts), _REPLY), 1)
    levels = [level]

    def meet(run, schema: str) -> DataFrame:
        return chunks.groupBy("chunk").cogroup(replies.groupBy("chunk")).applyInArrow(run, schema)

    for k in range(2, order + 1):
        asked = meet(_ask(list(levels), parts, hot, starts), _ASK)
        more, level = reply(asked.groupBy("part").applyInArrow(_count(k, parts, k == order), _REPLY), k)
        levels.append(level)
        replies = replies.unionByName(more)
    return meet(_score(levels, parts, hot, starts), _SCORED)

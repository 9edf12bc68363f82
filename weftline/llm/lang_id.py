"""Language identification by cross-parsing entropy.

For each language a suffix automaton holds labelled text. A text is parsed
against it: from where the last phrase ended, the longest match is the next
phrase, and a character that the language's text lacks is a phrase of its own.
A phrase is worth log2(N) bits, the place in N characters of labelled text, and
a character that has no place there those of all A letters, log2(A), as well;
bits over the n characters of the text estimate the cross entropy. The language
that needs the fewest wins.

Text is normalised to letters, lower-cased, with one blank for each run of
others. Every language has an alphabet of its own, all letters of its text.
Its automaton is a table of states by letters, or a hash map of the steps there
are where the table would have more than DENSE entries (as with alphabets of
thousands of letters); a step that the automaton lacks begins a phrase.

A text is parsed in lanes of LANE characters that stand side by side in a
matrix, so that one numpy step walks a character of every lane. Every lane is
first parsed as if a phrase began with it. Then the phrase that runs into it
from the lane before is carried on until both parses are in one state, from
where they are the same; so the counts are those of the whole text parsed from
its first character.

The labelled text is a bounded sample of whole texts: of every language up to
SAMPLE_DOCS ids, those with the least hash, of which so many texts are taken
as SAMPLE_CHARS / languages characters hold (MIN_CHARS at least; the shortest
one alone if none fits). Everything else sees every row and every character.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import _text as t
from ._intmap import IntMap
from ._session import Scratch, remainder, ship, small

#: The bounds of the labelled sample.
SAMPLE_DOCS = 200
SAMPLE_CHARS = 100_000
MIN_CHARS = 2_000
#: Entries of a table of states by letters; of 4 bytes.
DENSE = 4_000_000

LANE = 256

UNKNOWN = "und"


def _letters() -> np.ndarray:
    """For each code point its lower-case letter's code point, 0 for what is no letter."""
    out = np.zeros(0x110000, np.uint32)
    for c in range(0x110000):
        if unicodedata.category(chr(c))[0] == "L":
            low = chr(c).lower()
            out[c] = ord(low) if len(low) == 1 else c
    return out


def normalise(text: np.ndarray, ends: np.ndarray, classes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Classes of the texts' characters with runs of blanks as one, and the texts' ends."""
    kind = classes[text]
    keep = np.ones(len(kind), bool)
    keep[1:] = (kind[1:] != 0) | (kind[:-1] != 0)
    starts = ends[:-1][ends[:-1] < len(kind)]
    keep[starts] = True
    total = np.concatenate([[0], np.cumsum(keep)])
    return kind[keep], np.concatenate([[0], total[ends]])


def suffix_automaton(text: list[int]) -> list[dict[int, int]]:
    """The steps of each state of the text's suffix automaton; state 0 is the root."""
    edges: list[dict[int, int]] = [{}]
    link, length = [-1], [0]
    last = 0
    for c in text:
        cur = len(edges)
        edges.append({})
        length.append(length[last] + 1)
        link.append(0)
        p = last
        while p >= 0 and c not in edges[p]:
            edges[p][c] = cur
            p = link[p]
        if p >= 0:
            q = edges[p][c]
            if length[p] + 1 == length[q]:
                link[cur] = q
            else:
                copy = len(edges)
                edges.append(dict(edges[q]))
                length.append(length[p] + 1)
                link.append(link[q])
                while p >= 0 and edges[p].get(c) == q:
                    edges[p][c] = copy
                    p = link[p]
                link[q] = link[cur] = copy
        last = cur
    return edges


class Language:
    """A language's text as an automaton over its own letters."""

    def __init__(self, text: np.ndarray, kinds: int):
        """text: classes of letters, of which there are `kinds`."""
        own, coded = np.unique(text, return_inverse=True)
        self.size = len(text)
        self.width = len(own) + 1
        self.of = np.full(kinds, len(own), np.int32)  # letters that the text lacks share the last class
        self.of[own] = np.arange(len(own))
        edges = suffix_automaton(coded.reshape(-1).tolist())
        # States go by their number times the width. A step: the next state times two, and one more if a phrase begins.
        self.dense = len(edges) * self.width <= DENSE
        self.kind = np.int32 if self.dense else np.int64
        self.root = np.ones(self.width, self.kind)
        for c, q in edges[0].items():
            self.root[c] = q * self.width * 2 + 1
        at = np.array([s * self.width + c for s, e in enumerate(edges) if s for c in e], np.int64)
        to = np.array([q * self.width * 2 for s, e in enumerate(edges) if s for q in e.values()], np.int64)
        if self.dense:
            self.steps = np.tile(self.root, len(edges))
            self.steps[at] = to
        else:
            self.steps = IntMap()
            self.steps.put((at + 1).astype(np.uint64), to)

    def step(self, state: np.ndarray, letter: np.ndarray) -> np.ndarray:
        if self.dense:
            return self.steps.take(state + letter)
        on = self.steps.get((state + letter + 1).astype(np.uint64))
        return np.where(on < 0, self.root[letter], on)

    def phrases(self, letters: np.ndarray, length: np.ndarray, before: np.ndarray) -> np.ndarray:
        """Phrases that begin in each lane. letters: a column a lane, the longest first; before: the lane before in the text, or -1."""
        letters = self.of[letters]
        live = np.searchsorted(-length, -np.arange(LANE), "left")  # lanes longer than the step
        n = len(length)
        steps = np.zeros((LANE, n), self.kind)
        state = np.zeros(n, self.kind)
        for k in range(int(length[0]) if n else 0):
            m = live[k]
            steps[k, :m] = self.step(state[:m], letters[k, :m])
            state[:m] = steps[k, :m] >> 1
        total = (steps & 1).sum(0, dtype=np.int64)
        own, end = total.copy(), state.copy()
        after = np.full(n, -1, np.int64)
        after[before[before >= 0]] = np.flatnonzero(before >= 0)
        lanes = np.flatnonzero(before >= 0)
        lanes = lanes[end[before[lanes]] != 0]
        while len(lanes):
            walk, at = lanes, end[before[lanes]]
            more = np.zeros(len(lanes), np.int64)  # phrases that begin, less those of the lane's own parse
            changed = []
            for k in range(LANE):
                if not len(walk):
                    break
                got, lane = self.step(at, letters[k, walk]), steps[k, walk]
                more = more + (got & 1) - (lane & 1)
                at = got >> 1
                met = at == lane >> 1
                done = met | (length[walk] == k + 1)
                over = walk[done]
                total[over] = own[over] + more[done]
                new = np.where(met, state[walk], at)[done]
                changed.append(over[end[over] != new])
                end[over] = new
                walk, at, more = walk[~done], at[~done], more[~done]
            lanes = after[np.concatenate(changed)]
            lanes = np.sort(lanes[lanes >= 0])
        return total


class Model:
    """The automata of all languages."""

    def __init__(self, samples: dict[str, list[str]]):
        letters = _letters()
        coded = {k: np.frombuffer(" ".join(v).encode("utf-32-le", "surrogatepass"), np.uint32) for k, v in sorted(samples.items())}
        alphabet = np.unique(np.concatenate([np.zeros(1, np.uint32), *(letters[v] for v in coded.values())]))  # 0 is no letter
        index = np.full(0x110000, len(alphabet), np.uint32)
        index[alphabet] = np.arange(len(alphabet))
        self.classes = index[letters]
        self.languages = list(coded)
        texts = [normalise(v, np.array([0, len(v)]), self.classes)[0] for v in coded.values()]
        self.automata = [Language(x, len(alphabet) + 1) for x in texts]
        self.bits = [np.log2(max(2, len(x))) for x in texts]
        self.spelled = np.log2(len(alphabet) + 1)

    def phrases(self, kind: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """The number of phrases of each text in each language."""
        size = np.diff(ends)
        lanes = -(-size // LANE)
        owner = np.repeat(np.arange(len(size)), lanes)
        rank = np.arange(len(owner)) - np.repeat(np.cumsum(lanes) - lanes, lanes)
        start = np.repeat(ends[:-1], lanes) + rank * LANE
        length = np.minimum(LANE, np.repeat(ends[1:], lanes) - start)
        order = np.argsort(-length, kind="stable")
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        before = np.where(rank > 0, place[np.maximum(np.arange(len(order)) - 1, 0)], -1)[order]
        owner, start, length = owner[order], start[order], length[order]
        padded = np.concatenate([kind, np.zeros(LANE, kind.dtype)])
        out = np.zeros((len(self.languages), len(size)), np.int64)
        for lo, hi in self._parts(owner, len(size)):
            mine = np.flatnonzero((owner >= lo) & (owner < hi))
            back = np.full(len(owner) + 1, -1, np.int64)
            back[mine] = np.arange(len(mine))
            matrix = padded[start[mine][None, :] + np.arange(LANE)[:, None]]
            for k, language in enumerate(self.automata):
                found = language.phrases(matrix, length[mine], back[before[mine]])
                out[k] += np.bincount(owner[mine], found, len(size)).astype(np.int64)
        return out

    def strange(self, kind: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """The number of characters of each text that each language's text lacks."""
        out = np.zeros((len(self.languages), len(ends) - 1), np.int64)
        for k, language in enumerate(self.automata):
            total = np.concatenate([[0], np.cumsum(language.of[kind] == language.width - 1)])
            out[k] = np.diff(total[ends])
        return out

    @staticmethod
    def _parts(owner: np.ndarray, texts: int) -> Iterator[tuple[int, int]]:
        """Ranges of texts of a bounded number of lanes, one text at least."""
        total = np.concatenate([[0], np.cumsum(np.bincount(owner, minlength=texts))])
        lo = 0
        while lo < texts:
            hi = max(lo + 1, int(np.searchsorted(total, total[lo] + 8192, "right")) - 1)
            yield lo, hi
            lo = hi

    def predict(self, texts: list[str]) -> tuple[list[str], np.ndarray]:
        """The language of each text and a confidence; UNKNOWN and 0 without letters."""
        code = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
        ends = np.concatenate([[0], np.cumsum([len(x) for x in texts])])
        kind, ends = normalise(code, ends[1:], self.classes)
        letters = np.add.reduceat(np.append(kind > 0, False).astype(np.int64), ends[:-1]) * (np.diff(ends) > 0)
        if not self.languages:
            return [UNKNOWN] * len(texts), np.zeros(len(texts))
        bits = self.phrases(kind, ends) * np.array(self.bits)[:, None] + self.strange(kind, ends) * self.spelled
        best = bits.argmin(0)
        least = bits.min(0)
        others = bits.copy()
        others[best, np.arange(len(texts))] = np.inf
        second = others.min(0)
        score = np.where(np.isinf(second), 1.0, second / np.maximum(second + least, 1e-9))
        known = letters > 0
        return [self.languages[b] if ok else UNKNOWN for b, ok in zip(best, known)], np.where(known, score, 0.0)


def fit(docs: DataFrame, held_out_mod: int = 5) -> Model:
    """A model from docs(doc_id, text, lang): rows with a language whose crc32(doc_id) mod held_out_mod is not 0.

    Rows that share an id and a language are one, that of the least text. Every
    language with a letter in one of its sampled texts is learned.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text"))
    rows = rows.where(F.col("lang").isNotNull() & (remainder("doc_id", held_out_mod) != 0))
    first = F.row_number().over(Window.partitionBy("_lang").orderBy(F.xxhash64("_id"), "_id"))
    ids = rows.select(F.col("lang").alias("_lang"), F.col("doc_id").alias("_id")).withColumn("_rank", first)
    scratch = Scratch(spark, "lang_id")
    ids = scratch.table(ids.where(F.col("_rank") <= SAMPLE_DOCS).select("_lang", "_id").distinct(), "ids")
    found = rows.join(small(ids, ids.count()), (F.col("lang") == F.col("_lang")) & (F.col("doc_id") == F.col("_id"))).where("text is not null")
    found = scratch.table(found.groupBy("lang", "doc_id").agg(F.min("text").alias("text")), "sample")

    sizes: dict[str, list[tuple[int, int]]] = {}
    for lang, doc_id, n in found.select("lang", "doc_id", F.char_length("text")).orderBy("lang", F.xxhash64("doc_id"), "doc_id").collect():
        sizes.setdefault(lang, []).append((doc_id, n))
    budget = max(MIN_CHARS, SAMPLE_CHARS // max(1, len(sizes)))
    chosen = []
    for lang, texts in sizes.items():
        left, own = budget, []
        for doc_id, n in texts:
            if n <= left:
                left -= n
                own.append((lang, doc_id))
        chosen += own or [(lang, min(texts, key=lambda x: (x[1], x[0]))[0])]
    chosen = spark.createDataFrame(chosen, "lang string, doc_id long")
    samples: dict[str, list[str]] = {}
    for lang, _, text in found.join(small(chosen, chosen.count()), ["lang", "doc_id"]).select("lang", "doc_id", "text").orderBy("lang", F.xxhash64("doc_id"), "doc_id").collect():
        samples.setdefault(lang, []).append(text)
    return Model({k: v for k, v in samples.items() if any(unicodedata.category(ch)[0] == "L" for x in v for ch in x)})


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, lang_pred, score) for every row of docs(doc_id, text).

    score is second / (first + second) of the two least entropies, 0.5 for a
    tie (the first language by name wins) and 1 if there is one language.
    A text that is null or has no letter is `und` with score 0, as is every
    text of a model without languages. A null doc_id stays null.
    """
    ship(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)  # bounded by the sample

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1)
            for i, j, data, offsets in t.slices(texts, 1 << 20):
                part = [x or "" for x in texts.slice(i, j - i).to_pylist()]
                languages, score = shared.value.predict(part)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), pa.array(languages, pa.string()), pa.array(score, pa.float64())], ["doc_id", "lang_pred", "score"])

    docs = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return docs.mapInArrow(run, "doc_id long, lang_pred string, score double")


def identify(docs: DataFrame) -> DataFrame:
    """(doc_id, held_out, lang_pred, score) for every row of docs(doc_id, text, lang), learning from the rows that are not held out.

    held_out: crc32(doc_id as text) mod 5 is 0; a null doc_id is held out.
    """
    out = predict(docs, fit(docs))
    held = F.coalesce(remainder("doc_id", 5) == 0, F.lit(True))
    return out.select("doc_id", held.alias("held_out"), "lang_pred", "score")

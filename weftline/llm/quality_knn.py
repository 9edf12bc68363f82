"""Quality by nearest-neighbour voting in a latent semantic space.

A text's terms are its subwords, the runs of GRAM bytes hashed to GRAMS
places, and three more: how often a word stands again one, two or three words
on, which no single subword shows. Logarithms of the counts, weighted by
inverse document frequency (the three by REPEAT as well) and scaled to length
one, are projected on the leading right singular vectors of the labelled
sample. The sample's vectors with their labels are broadcast (SAMPLE_ROWS x
DIMENSIONS numbers). Every text is compared with all of them by exact cosines,
a block of texts at a time; its NEIGHBOURS nearest vote with their similarity
to the power of SHARPNESS as weight. Similarities are rounded to DIGITS
places, and all that tie with the last of the neighbours vote.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from . import _text as t
from ._labels import labelled
from ._session import remainder, ship

#: The bound of the labelled sample.
SAMPLE_ROWS = 4000
DIMENSIONS = 48
NEIGHBOURS = 25
SHARPNESS = 64
DIGITS = 5
#: Bytes of a subword, places that subwords are hashed to, and the weight of the terms of repeated words.
GRAM, GRAMS, REPEAT = 3, 4096, 4
TERMS = GRAMS + 3
#: Scores from here on are accepted.
ACCEPT = 0.3


def term_counts(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """The terms' counts, a row a text."""
    n = len(offsets) - 1
    out = np.zeros((n, TERMS), np.float32)
    doc = np.repeat(np.arange(n), np.diff(offsets))
    size = len(data) - GRAM + 1
    if size > 0:
        gram = np.zeros(size, np.uint32)
        for k in range(GRAM):
            gram = gram << np.uint32(8) | data[k : size + k]
        place = (gram * np.uint32(0x9E3779B1)) >> np.uint32(32 - int(GRAMS - 1).bit_length())
        inside = doc[:size] == doc[GRAM - 1 :]
        out[:, :GRAMS] = np.bincount((doc[:size] * GRAMS + place)[inside], minlength=n * GRAMS).reshape(n, -1)
    starts, ends, first = t.word_bounds(data, offsets)
    words = t.span_hashes(data, starts, ends)
    of = np.repeat(np.arange(n), np.diff(first))
    for k in range(1, TERMS - GRAMS + 1):
        if len(words) > k:
            out[:, GRAMS + k - 1] = np.bincount(of[k:][(words[k:] == words[:-k]) & (of[k:] == of[:-k])], minlength=n)
    return out


class Space:
    """The latent space, and the labelled vectors in it."""

    def __init__(self, counts: np.ndarray, labels: np.ndarray):
        x = np.log1p(counts)
        seen = (x > 0).sum(0)
        self.idf = (np.log((1 + len(x)) / (1 + seen)) + 0.05).astype(np.float32)
        self.idf[GRAMS:] *= REPEAT
        x = self._scaled(x)
        rng = np.random.default_rng(7)
        d = min(DIMENSIONS, *x.shape) if len(x) else 0
        basis = rng.standard_normal((x.shape[1], d + 8 if d else 0)).astype(np.float32)
        for _ in range(4 if d else 0):  # subspace iteration
            basis, _ = np.linalg.qr(x.T @ (x @ basis))
        if d:
            _, _, v = np.linalg.svd(x @ basis, full_matrices=False)
            basis = (basis @ v.T)[:, :d]
        self.basis = np.ascontiguousarray(basis.astype(np.float32))
        self.labels = labels.astype(np.float32)
        self.prior = float(labels.mean()) if len(labels) else 1.0
        self.vectors = self._unit(x @ self.basis)

    def _scaled(self, x: np.ndarray) -> np.ndarray:
        return self._unit(x * self.idf)

    @staticmethod
    def _unit(v: np.ndarray) -> np.ndarray:
        return v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-9)

    def scores(self, counts: np.ndarray, block: int = 256) -> np.ndarray:
        """The neighbours' vote for label 1; the sample's share of it for a text without terms."""
        out = np.full(len(counts), self.prior)
        if not len(self.labels):
            return out
        for lo in range(0, len(counts), block):
            x = np.log1p(counts[lo : lo + block])
            some = x.any(1)
            near = np.round(self._unit(self._scaled(x) @ self.basis) @ self.vectors.T, DIGITS)
            k = min(NEIGHBOURS, near.shape[1])
            last = np.partition(near, near.shape[1] - k, axis=1)[:, near.shape[1] - k]
            row, one = np.nonzero(near >= last[:, None])
            weight = np.maximum(near[row, one], 0).astype(np.float64) ** SHARPNESS
            total = np.bincount(row, weight, len(near))
            vote = np.bincount(row, weight * self.labels[one], len(near))
            ok = some & (total > 0)
            out[lo : lo + block][ok] = vote[ok] / total[ok]
        return np.clip(out, 0.0, 1.0)


def _counts(texts: pa.Array) -> Iterator[tuple[int, int, np.ndarray]]:
    for i, j, data, offsets in t.slices(texts, 1 << 20):
        for a in range(0, j - i, 512):
            b = min(a + 512, j - i)
            yield i + a, i + b, term_counts(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])


def fit(docs: DataFrame, labels: DataFrame) -> Space:
    """The space of a bounded labelled sample; see labelled(). Term counts of the sample come to the driver, about a kB a row."""
    ship(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j, counts in _counts(batch.column(2)):
                rows = [zlib.compress(c.astype("<f4").tobytes(), 1) for c in counts]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), batch.column(1).slice(i, j - i), t.binary_array(rows)], ["doc_id", "quality", "counts"])

    rows = labelled(docs, labels, SAMPLE_ROWS).mapInArrow(run, "doc_id long, quality int, counts binary").toArrow().sort_by("doc_id")
    counts = np.zeros((len(rows), TERMS), np.float32)
    for k, row in enumerate(rows.column("counts")):
        counts[k] = np.frombuffer(zlib.decompress(row.as_py()), "<f4")
    return Space(counts, np.asarray(rows.column("quality")))


def score(docs: DataFrame, space: Space, into: str = "score") -> DataFrame:
    """docs with a column `into` added, from 0 to 1: how likely label 1 is. Replaces a column of that name.

    A null or empty text, and one without a term (of under GRAM bytes), has
    the sample's share of label 1; without labelled rows every text has 1. Of
    neighbours that tie for the last place all vote. Repeated rows get a score
    each. Other columns stay as they are.
    """
    ship(docs.sparkSession)
    docs = docs.drop(into)
    shared = docs.sparkSession.sparkContext.broadcast(space)  # bounded by the sample
    at = docs.columns.index("text")
    schema = StructType([*docs.schema.fields, StructField(into, DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j, counts in _counts(batch.column(at)):
                part = batch.slice(i, j - i)
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(shared.value.scores(counts))], schema.names)

    return docs.mapInArrow(run, schema)


def classify(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, held_out, score, predicted) for every row of docs(doc_id, text).

    Learns from labels(doc_id, quality) of the ids that are not held out, which
    are those with crc32(doc_id as text) mod 5 of 0 and null ids. predicted is
    1 from a score of ACCEPT on.
    """
    space = fit(docs, labels)
    out = score(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")), space)
    held = F.coalesce(remainder("doc_id", 5) == 0, F.lit(True))
    return out.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= ACCEPT).cast("int").alias("predicted"))


def keep_accepted(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """docs, with all columns, without the rows that classify() predicts 0 for; nothing is shuffled."""
    into = "score"
    while into in docs.columns:
        into = f"_{into}"
    return score(docs, fit(docs, labels), into).where(F.col(into) >= ACCEPT).drop(into)

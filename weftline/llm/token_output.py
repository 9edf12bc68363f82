"""Token-id files: flat unsigned integers, 64-bit document offsets, memory-mapped reading.

(In a store that cannot be mapped, such as an object store, ranges are read instead.)

A dataset is a folder of parts, one a task, in ascending order of doc_id:

* part-NNNNN.ids: the ids of its documents one after another, little-endian,
  unsigned 16-bit where the vocabulary has at most 65,536 ids, else 32-bit,
* part-NNNNN.idx: 64-bit document offsets into it, one more than documents,
* part-NNNNN.doc: the 64-bit doc_id of each document (NULL_ID for a null one).

The global position of a part's first id, its base, is the sum of the sizes of
the parts before it: a prefix sum over one number a part, kept in the index
that `write` returns and not in the parts, so parts are written independently
and again alike when a task is repeated (each under a name of its own and then
moved into place).

Texts are encoded with the tokenizers library. Its normaliser and split
pattern never look across white space, so each distinct run of other
characters is encoded once a worker, in batches, and looked up by its bytes
from then on.
"""

from __future__ import annotations

import os
import uuid
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import _text as t
from ._intmap import PieceCache
from ._session import Scratch, ship

NULL_ID = -(1 << 63)
#: Hadoop's names of schemes that pyarrow names otherwise.
_SCHEMES = {"s3a": "s3", "s3n": "s3"}

_tokenizers: dict[int, Encoder] = {}


class Encoder:
    """A tokenizers model without truncation or padding, with a cache of white-space separated runs."""

    def __init__(self, spec: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        from tokenizers import Tokenizer

        self.model = Tokenizer.from_str(spec)
        self.model.no_truncation()
        self.model.no_padding()
        self.cache = PieceCache()

    @staticmethod
    def of(spec: str) -> Encoder:
        key = hash(spec)
        if key not in _tokenizers:
            _tokenizers.clear()
            _tokenizers[key] = Encoder(spec)
        return _tokenizers[key]

    def _encode(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        runs = [data[a:b].tobytes().decode() for a, b in zip(starts.tolist(), ends.tolist())]
        ids = [e.ids for e in self.model.encode_batch_fast(runs, add_special_tokens=False)]
        return np.array([x for one in ids for x in one], np.uint32), np.array([len(x) for x in ids], np.int64)

    def encode(self, data: np.ndarray, offsets: np.ndarray, end_id: int) -> tuple[np.ndarray, np.ndarray]:
        """Flat ids of the texts, each with the end id after it, and each text's first id (n + 1 entries)."""
        starts, ends, first = t.word_bounds(data, offsets)
        begin, size, pool = self.cache.lookup(data, starts, ends, lambda at: self._encode(data, starts[at], ends[at]))
        total = np.concatenate([[0], np.cumsum(size)])[first]
        n = np.arange(len(offsets))
        out = np.full(int(total[-1]) + len(offsets) - 1, end_id, np.uint32)
        inner = np.ones(len(out), bool)
        inner[(total + n)[1:] - 1] = False
        out[inner] = pool[t.ragged(begin, size)]
        return out, total + n


def _open(address: str):
    """The file system and the path in it, as pyarrow names them, of an address with a scheme."""
    import pyarrow.fs as fs

    scheme, _, rest = address.partition(":")
    return fs.FileSystem.from_uri(f"{_SCHEMES.get(scheme, scheme)}:{rest}")


def qualified(spark: SparkSession, out: str) -> str:
    """The address with the scheme that Spark gives it: that of fs.defaultFS, if it has none."""
    path = spark._jvm.org.apache.hadoop.fs.Path(out)
    return openable(path.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(path).toString())


def openable(address: str) -> str:
    """The address; ValueError if Python workers, which write and read id files, cannot open it."""
    try:
        _open(address)
    except Exception as e:
        raise ValueError(f"{address}: Python workers cannot open it ({e})") from e
    return address


def write(docs: DataFrame, path: str, out: str, end_id: int = 2) -> list[tuple[int, int, int]]:
    """Writes docs(doc_id, text) as a dataset into the folder `out`; gives (part, documents, ids) of its parts, in order.

    `path` is the tokenizer's JSON file, `out` a folder that all executors
    reach. Documents are ordered by doc_id (null first), repeated ids by a hash
    of the text. A null or empty text has the end id alone. An empty table
    gives no parts. Rows are range-partitioned by doc_id and that hash before
    encoding, so that rows of one id may lie in several parts.
    """
    spark = docs.sparkSession
    ship(spark)
    out = qualified(spark, out)
    spec = Path(path).read_text()
    shared = spark.sparkContext.broadcast(spec)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    order = [F.col("doc_id"), F.xxhash64("text")]
    docs = docs.repartitionByRange(*order).sortWithinPartitions(*order)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = Encoder.of(shared.value)
        kind = "<u2" if model.model.get_vocab_size() <= 1 << 16 and end_id < 1 << 16 else "<u4"
        part = TaskContext.get().partitionId()
        store, folder = _open(out)
        store.create_dir(folder, recursive=True)
        own = f"{folder}/.part-{part:05d}-{uuid.uuid4().hex}"
        docs = ids = 0
        with store.open_output_stream(f"{own}.ids") as a, store.open_output_stream(f"{own}.idx") as b, store.open_output_stream(f"{own}.doc") as c:
            b.write(np.zeros(1, "<i8").tobytes())
            for batch in batches:
                c.write(np.asarray(batch.column(0).fill_null(NULL_ID)).astype("<i8").tobytes())
                for i, j, data, offsets in t.slices(batch.column(1)):
                    flat, first = model.encode(data, offsets, end_id)
                    a.write(flat.astype(kind).tobytes())
                    b.write((first[1:] + ids).astype("<i8").tobytes())
                    docs, ids = docs + j - i, ids + len(flat)
        for end in ("ids", "idx", "doc"):
            if docs:
                store.move(f"{own}.{end}", f"{folder}/part-{part:05d}.{end}")
            else:
                store.delete_file(f"{own}.{end}")
        yield pa.RecordBatch.from_arrays([pa.array([part]), pa.array([docs]), pa.array([ids])], ["part", "docs", "ids"])

    rows = docs.mapInArrow(run, "part long, docs long, ids long").where("docs > 0").collect()
    return sorted((r[0], r[1], r[2]) for r in rows)


class _Numbers:
    """A file of numbers: memory-mapped on a local disk, else read by ranges."""

    def __init__(self, store, name: str, kind: str):
        import pyarrow.fs as fs

        self.kind, self.width = kind, np.dtype(kind).itemsize
        self.size = store.get_file_info(name).size // self.width
        self.mapped = (np.memmap(name, kind, "r") if self.size else np.zeros(0, kind)) if isinstance(store, fs.LocalFileSystem) else None
        self.file = None if self.mapped is not None else store.open_input_file(name)

    def __getitem__(self, part: slice) -> np.ndarray:
        if self.mapped is not None:
            return np.asarray(self.mapped[part])
        self.file.seek(part.start * self.width)
        return np.frombuffer(self.file.read((part.stop - part.start) * self.width), self.kind)


#: Documents whose offsets, and ids that, are read at once (one document's ids at least).
_DOCS, _IDS = 1 << 16, 1 << 19


def read(spark: SparkSession, out: str, parts: list[tuple[int, int, int]]) -> DataFrame:
    """(doc_id, start, n_tokens, ids) of the documents of a dataset, from its files; ids as little-endian unsigned 32-bit integers.

    start is the number of ids before the document's in the whole dataset: the
    part's base plus the document's offset.
    """
    ship(spark)
    out = qualified(spark, out)
    base, rows = 0, []
    for part, docs, ids in parts:
        rows.append((part, docs, ids, base))
        base += ids
    schema = "doc_id long, start long, n_tokens long, ids binary"
    if not rows:
        return spark.createDataFrame([], schema)
    index = spark.createDataFrame(rows, "part long, docs long, ids long, base long").repartition(len(rows), "part")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, folder = _open(out)
        for batch in batches:
            for r in batch.to_pylist():
                name = f"{folder}/part-{r['part']:05d}"
                offsets, names = _Numbers(store, f"{name}.idx", "<i8"), _Numbers(store, f"{name}.doc", "<i8")
                if offsets.size != r["docs"] + 1 or offsets[r["docs"] : r["docs"] + 1][0] != r["ids"]:
                    raise ValueError(f"{name}: not the part that was written")
                info = store.get_file_info(f"{name}.ids")
                flat = _Numbers(store, f"{name}.ids", f"<u{info.size // max(1, r['ids'])}")
                for lo in range(0, r["docs"], _DOCS):
                    hi = min(lo + _DOCS, r["docs"])
                    block, docs = offsets[lo : hi + 1], names[lo:hi]
                    k = 0
                    while k < len(docs):
                        e = max(k + 1, int(np.searchsorted(block, block[k] + _IDS, "right")) - 1)
                        at, doc = block[k : e + 1], docs[k:e]
                        ids = flat[int(at[0]) : int(at[-1])].astype("<u4")
                        yield pa.RecordBatch.from_arrays(
                            [
                                pa.array(doc, mask=doc == NULL_ID),
                                pa.array(at[:-1] + r["base"]),
                                pa.array(np.diff(at)),
                                pa.Array.from_buffers(pa.binary(), e - k, [None, pa.py_buffer((4 * (at - at[0])).astype(np.int32)), pa.py_buffer(ids)]),
                            ],
                            ["doc_id", "start", "n_tokens", "ids"],
                        )
                        k = e

    return index.mapInArrow(run, schema)


def round_trip(docs: DataFrame, path: str, end_id: int = 2) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of docs, written as a dataset into the shared folder and read back."""
    out = Scratch(docs.sparkSession, "tokens").path("ids")
    back = read(docs.sparkSession, out, write(docs, path, out, end_id))
    return back.select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))

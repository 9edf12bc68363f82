"""Line dedup over the whole corpus, with DataFrame functions only.

A line's key is the line stripped of ASCII white space at both ends and
lower-cased (A-Z). Keys of at least `min_chars` code points found in at least
`min_docs` documents lose all their lines except in the largest doc_id that
holds them.

Only hashes travel: each document sends every key once as two 64-bit hashes.
They are range-partitioned and sorted by hash, then document (last first) and
position, and streamed: a window over the sorted rows passes on a key's first
occurrence in each document, counted and summed up on the way.
The range includes the document, so a line that a third of all documents hold
spreads over many partitions; every partition sums up its stretch of a key
and the few sums are merged.
What comes back to a document is a bitmap of its lines to keep, one bit a
line, run-length coded as alternating numbers of kept and dropped lines.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import _session
from ._place import file_of, in_place
from ._session import Scratch

#: Columns that apply_bitmaps adds.
ADDED = ("n_lines", "n_dropped", "kept_text")
#: Lines of a key from which on, where keys are too many to be broadcast, the key is broadcast and the others are shuffled.
HOT_ROWS = 100_000

_BLANK = " \t\n\x0b\x0c\r"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def _identified(docs: DataFrame) -> DataFrame:
    """docs with the columns that tell rows apart: doc_id and a hash of the text."""
    return docs.withColumn("_text", F.xxhash64(F.coalesce("text", F.lit(""))))


def keep_bitmaps(docs: DataFrame, min_chars: int = 40, min_docs: int = 5, scratch: Scratch | None = None) -> DataFrame:
    """(doc_id, text_hash, n_dropped, dropped) of each document that loses lines.

    `dropped` is the bitmap of the lines, run-length coded: an array of
    (start, n) for each run of lines to drop, ascending, from line 0.
    text_hash tells texts under one doc_id apart; they count as one document.
    A null doc_id counts as one document, smaller than all others. A null text
    is empty. Documents that keep all lines have no row.
    """
    scratch = scratch or Scratch(docs.sparkSession, "line_dedup")
    docs = _identified(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")))
    lines = docs.select("doc_id", "_text", F.posexplode(_lines(F.col("text"))).alias("pos", "line"))
    lines = lines.where(F.char_length("line") >= min_chars).withColumn("key", F.translate(F.btrim("line", F.lit(_BLANK)), _UPPER, _LOWER))
    lines = lines.where(F.char_length("key") >= min_chars)
    # Both hashes run over the whole key; the second starts from another state.
    hashes = [F.xxhash64("key").alias("h1"), F.xxhash64(F.lit("line"), F.col("key")).alias("h2")]
    lines = scratch.table(lines.select(*hashes, "doc_id", "_text", "pos"), "lines")

    ranged = lines.select("h1", "h2", "doc_id", "pos").repartitionByRange("h1", "h2", "doc_id")
    ranged = ranged.sortWithinPartitions("h1", "h2", F.desc("doc_id"), "pos")
    first = F.row_number().over(Window.partitionBy("h1", "h2", "doc_id").orderBy("pos")) == 1
    keys = ranged.withColumn("first", first.cast("int")).groupBy("h1", "h2").agg(F.sum("first").alias("n"), F.count("*").alias("rows"), F.max("doc_id").alias("last"))
    keys = scratch.table(keys.where(F.col("n") >= min_docs).select("h1", "h2", "rows", "last"), "keys")

    drop = _of_keys(lines, keys).where("doc_id is null or doc_id < last")
    drop = drop.select("doc_id", "_text", "pos").distinct()
    drop = drop.withColumn("run", F.col("pos") - F.row_number().over(Window.partitionBy("doc_id", "_text").orderBy("pos")))
    runs = drop.groupBy("doc_id", "_text", "run").agg(F.min("pos").alias("start"), F.count("*").cast("int").alias("n"))
    return runs.groupBy("doc_id", F.col("_text").alias("text_hash")).agg(
        F.sum("n").alias("n_dropped"), F.sort_array(F.collect_list(F.struct("start", "n"))).alias("dropped")
    )


def _of_keys(lines: DataFrame, keys: DataFrame) -> DataFrame:
    """The lines of the keys, with the key's largest document.

    Keys that are too many to be broadcast meet the lines in a shuffle, but
    for the hot ones: those are broadcast, so that no task gets all lines of a
    key that stands everywhere. The bound of hot rises until they are few.
    """
    by = ["h1", "h2"]
    if keys.count() <= _session.BROADCAST_ROWS:
        return lines.join(F.broadcast(keys), by)
    hot = HOT_ROWS
    while keys.where(F.col("rows") >= hot).count() > _session.BROADCAST_ROWS:
        hot *= 8
    often = F.broadcast(keys.where(F.col("rows") >= hot))
    return lines.join(often, by).unionByName(lines.join(often, by, "left_anti").join(keys.where(F.col("rows") < hot), by))


def _kept(text: Column, runs: Column) -> Column:
    """The lines outside the runs, joined by newlines; slices the lines once for each run kept."""

    def slices(lines: Column) -> Column:
        def one(i: Column) -> Column:
            start = F.when(i == 0, 0).otherwise(F.get(runs, i - 1)["start"] + F.get(runs, i - 1)["n"])
            stop = F.when(i == F.size(runs), F.size(lines)).otherwise(F.get(runs, i)["start"])
            return F.slice(lines, start + 1, stop - start)

        return F.flatten(F.transform(F.sequence(F.lit(0), F.size(runs)), one))

    # The outer array binds the split lines to a lambda variable, so that they are split once.
    return F.array_join(F.get(F.transform(F.array(_lines(text)), slices), F.lit(0)), "\n")


def apply_bitmaps(docs: DataFrame, min_chars: int = 40, min_docs: int = 5, then: Callable[[DataFrame], DataFrame] = lambda out: out) -> DataFrame:
    """docs with all columns, and n_lines (before dropping), n_dropped and kept_text added; `then` finishes the rows, one by one.

    The bitmaps go to the texts: see in_place(). Columns of docs that bear the
    added names are replaced.
    """
    scratch = Scratch(docs.sparkSession, "line_dedup")
    maps = scratch.table(keep_bitmaps(docs, min_chars, min_docs, scratch), "maps")
    scratch.drop("lines")
    weight = "1 + size(dropped)"
    side, at = maps.withColumn("_file", F.lit(None).cast("string")), file_of(docs)
    if at is not None and (maps.agg(F.expr(f"sum({weight})")).first()[0] or 0) > _session.BROADCAST_ROWS:
        where = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(F.coalesce(F.col("text").cast("string"), F.lit(""))).alias("text_hash"), at.alias("_file")).distinct()
        same = where["doc_id"].eqNullSafe(maps["doc_id"]) & (where["text_hash"] == maps["text_hash"])
        side = scratch.table(maps.join(where, same).select(maps["*"], "_file"), "placed")

    def meet(part: DataFrame, side: DataFrame) -> DataFrame:
        # The row travels as one column, so that its names meet no others.
        row = F.struct(*(c for c in part.columns if c not in ADDED)).alias("row")
        part = part.select(row, F.col("doc_id").cast("long").alias("id"), F.xxhash64(F.coalesce(F.col("text").cast("string"), F.lit(""))).alias("hash"))
        out = part.join(side, F.col("id").eqNullSafe(F.col("doc_id")) & (F.col("hash") == F.col("text_hash")), "left")
        text = F.coalesce(F.col("row")["text"].cast("string"), F.lit(""))
        return then(
            out.select(
                "row.*",
                F.size(_lines(text)).cast("long").alias("n_lines"),
                F.coalesce("n_dropped", F.lit(0)).cast("long").alias("n_dropped"),
                F.when(F.col("n_dropped").isNull(), text).otherwise(_kept(text, F.col("dropped"))).alias("kept_text"),
            )
        )

    return in_place(docs, side, meet, scratch, "kept", weight)


def dedup_lines(docs: DataFrame, min_chars: int = 40, min_docs: int = 5) -> DataFrame:
    """docs with the kept text in place of text, and n_chars set to its code points; a null text stays null."""
    # Columns of docs with the names that apply_bitmaps adds would be lost: they go by other names meanwhile.
    aside = {}
    for c in docs.columns:
        if c in ADDED:
            name = f"_own_{c}"
            while name in docs.columns:
                name = f"_{name}"
            aside[c] = name

    def finish(out: DataFrame) -> DataFrame:
        out = out.withColumn("text", F.when(F.col("text").isNotNull(), F.col("kept_text"))).drop(*ADDED)
        out = out.withColumnsRenamed({v: k for k, v in aside.items()})
        if "n_chars" in docs.columns:
            out = out.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType))
        return out.select(*docs.columns)

    return apply_bitmaps(docs.withColumnsRenamed(aside), min_chars, min_docs, finish)

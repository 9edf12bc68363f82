"""The bounded sample of labelled documents that classifiers learn from."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._session import remainder


def labelled(docs: DataFrame, labels: DataFrame, rows: int, held_out_mod: int = 5) -> DataFrame:
    """(doc_id, quality, text) of the documents with a quality label whose crc32(doc_id) mod held_out_mod is not 0.

    Of more than `rows` labelled ids those with the least hash are taken. An
    id with several labels has the least of them; null labels are none.
    """
    ids = labels.where(F.col("quality").isNotNull() & (remainder("doc_id", held_out_mod) != 0))
    ids = ids.select(F.col("doc_id").cast("long").alias("_id"), F.col("quality").cast("int").alias("quality"))
    ids = ids.groupBy("_id").agg(F.min("quality").alias("quality")).orderBy(F.xxhash64("_id"), "_id").limit(rows)
    found = docs.select("doc_id", "text").join(F.broadcast(ids), F.col("doc_id").cast("long") == F.col("_id"))  # bounded by rows
    return found.select(F.col("_id").alias("doc_id"), "quality", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).dropDuplicates(["doc_id"])

"""Session helpers of the operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.plans.workspace import Scratch, shared_dir, ship

__all__ = ["BROADCAST_ROWS", "Scratch", "documents", "remainder", "shared_dir", "ship", "small"]

#: Rows up to which a two-column side (about 16 bytes a row) is broadcast; larger sides are shuffled.
BROADCAST_ROWS = 1_000_000


def small(df: DataFrame, rows: int) -> DataFrame:
    """df marked for broadcast if its counted rows stay under the bound, else unchanged."""
    return F.broadcast(df) if rows <= BROADCAST_ROWS else df


def remainder(doc_id: Column | str, mod: int) -> Column:
    """crc32 of the id as text, modulo mod; null for a null id."""
    c = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.crc32(c.cast("string").cast("binary")) % mod


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")

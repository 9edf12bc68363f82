"""Meeting the rows of a large table where they lie: the small side goes to the texts, never the texts to it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import _session
from ._session import Scratch

#: Rows of the small side of one input file that are still broadcast.
FILE_ROWS = 8_000_000


def file_of(docs: DataFrame) -> Column | None:
    """The input file of each row of docs, if docs is a table of files as it was read."""
    hidden = docs._jdf.queryExecution().analyzed().metadataOutput()
    return F.col("_metadata.file_path") if any(hidden.apply(k).name() == "_metadata" for k in range(hidden.size())) else None


def in_place(docs: DataFrame, side: DataFrame, meet: Callable[[DataFrame, DataFrame], DataFrame], scratch: Scratch, name: str, weight: str = "1") -> DataFrame:
    """meet(docs, side) for a side that has, in the column `_file`, the input file of the row of docs that it is meant for.

    A side of up to BROADCAST_ROWS rows is broadcast. For a larger one the
    input files are taken in blocks, each with so many rows of the side at
    most, which are broadcast to the block's texts; the results are written
    one after another into one table of the shared folder. Every text is read
    once and none is shuffled. The driver sees one row a file. Only where docs
    is no table of files (`_file` is null), or a file alone has more than
    FILE_ROWS rows of the side, the texts in question are shuffled. `meet`
    must work row by row on docs. A row of the side counts as `weight` rows.
    """
    bound = _session.BROADCAST_ROWS
    if (side.agg(F.expr(f"sum({weight})")).first()[0] or 0) <= bound:
        return meet(docs, F.broadcast(side.drop("_file")))
    at = file_of(docs)
    if at is None:
        return meet(docs, side.drop("_file"))
    rows = dict(side.groupBy("_file").agg(F.expr(f"sum({weight})")).collect())
    blocks: list[tuple[list[str], int]] = []
    for file in sorted(r[0] for r in docs.select(at).distinct().collect()):
        n = rows.get(file, 0)
        if not blocks or blocks[-1][1] + n > bound:
            blocks.append(([], 0))
        blocks[-1] = ([*blocks[-1][0], file], blocks[-1][1] + n)
    for files, n in blocks:
        part = side.where(F.col("_file").isin(files)).drop("_file")
        out = meet(docs.where(at.isin(files)), F.broadcast(part) if n <= max(bound, FILE_ROWS) else part)
        scratch.append(out, name)
    return docs.sparkSession.read.schema(out.schema).parquet(scratch.path(name))

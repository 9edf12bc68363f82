"""Line ranges: containment, own lines, coverage, merging.

Ranges are closed, in lines from 1. Ranges of a file meet by blocks of BLOCK
lines: joins carry the file and the block as their equi-key, with the range as
a residual predicate, so the work follows how many ranges lie over each other
and not how many a file has.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weftline.functions.constants import MERGE_GAP


#: Lines of a block in which ranges meet.
BLOCK = 64


def _block(line: str) -> Column:
    return F.floor(F.col(line) / BLOCK)


def _blocks(start: str, stop: str) -> Column:
    """A row for each block that a range touches."""
    return F.explode(F.sequence(_block(start), F.greatest(_block(start), _block(stop))))


def contained(spans: DataFrame) -> DataFrame:
    """(outer, inner): pairs of spans(node, file, start, stop) of one file, the inner within the outer and not the same row."""
    a = spans.select(F.col("node").alias("outer"), "file", F.col("start").alias("s1"), F.col("stop").alias("e1"), _blocks("start", "stop").alias("block"))
    b = spans.select(F.col("node").alias("inner"), "file", F.col("start").alias("s2"), F.col("stop").alias("e2"), _block("start").alias("block"))
    return a.join(b, ["file", "block"]).where("s2 >= s1 and e2 <= e1 and outer <> inner").select("outer", "inner")


def span_lines(spans: DataFrame) -> DataFrame:
    """spans(file, start, stop) with a row for each lineno that they cover: what is to be looked up then joins by (file, lineno)."""
    return spans.where("start <= stop").withColumn("lineno", F.explode(F.sequence("start", "stop")))


def own_lines(lines: DataFrame, spans: DataFrame) -> DataFrame:
    """(node, file, lineno, text): a span's lines without those of spans that lie within it, for spans(node, file, start, stop).

    Spans are compared where they share a line, so the work follows the depth
    of nesting and not the number of spans of a file.
    """
    rows = span_lines(spans.select("node", "file", "start", "stop"))
    a, b = rows.alias("a"), rows.alias("b")
    same = (F.col("a.file") == F.col("b.file")) & (F.col("a.lineno") == F.col("b.lineno"))
    within = (F.col("b.start") >= F.col("a.start")) & (F.col("b.stop") <= F.col("a.stop")) & (F.col("a.node") != F.col("b.node"))
    own = a.join(b, same & within, "left_anti").select("node", "file", "lineno")
    return own.join(lines.select("file", "lineno", "text"), ["file", "lineno"]).select("node", "file", "lineno", "text")


def covered(ranges: DataFrame, slices: DataFrame) -> DataFrame:
    """The ranges(file, start, stop) that lie within one of slices(file, start, stop)."""
    s = slices.select("file", F.col("start").alias("s"), F.col("stop").alias("e"), _blocks("start", "stop").alias("block"))
    same = (ranges.file == s.file) & (_block("start") == s.block)
    return ranges.join(s, same & (s.s <= ranges.start) & (s.e >= ranges.stop), "left_semi")


def overlapping(ranges: DataFrame, slices: DataFrame) -> DataFrame:
    """(node, file, target): the slices(target, file, start, stop) that share a line with each of ranges(node, file, start, stop)."""
    r = ranges.select("node", "file", "start", "stop", _blocks("start", "stop").alias("block"))
    s = slices.select("target", "file", F.col("start").alias("s"), F.col("stop").alias("e"), _blocks("start", "stop").alias("block"))
    both = r.join(s, ["file", "block"]).where("s <= stop and e >= start")
    # Two ranges meet in every block that both touch; the first of these counts.
    return both.where(F.col("block") == F.greatest(_block("start"), _block("s"))).select("node", "file", "target")


def padded(slices: DataFrame, pad: int = 3) -> DataFrame:
    """slices(start, stop, last) widened by pad lines within 1..last."""
    return slices.withColumn("start", F.greatest(F.lit(1), F.col("start") - pad)).withColumn("stop", F.least(F.col("last"), F.col("stop") + pad))


def merge_slices(slices: DataFrame, gap: int = MERGE_GAP) -> DataFrame:
    """(file, start, stop, n, names, score) of slices(file, start, stop, name, score) merged where the next begins at most gap lines after the end.

    names: distinct, sorted, comma-joined; score: the greatest. Sorted by start
    and end, a slice opens a new one if it begins beyond all earlier ends.
    """
    order = Window.partitionBy("file").orderBy("start", "stop", "name")
    before = F.max("stop").over(order.rowsBetween(Window.unboundedPreceding, -1))
    marked = slices.withColumn("opens", F.when(before.isNull() | (F.col("start") > before + gap), 1).otherwise(0))
    island = F.sum("opens").over(order.rowsBetween(Window.unboundedPreceding, 0))
    out = marked.withColumn("island", island).groupBy("file", "island")
    out = out.agg(
        F.min("start").alias("start"), F.max("stop").alias("stop"), F.count("*").alias("n"), F.array_join(F.array_sort(F.collect_set("name")), ",").alias("names"), F.max("score").alias("score")
    )
    return out.drop("island")


def not_shadowed(nodes: DataFrame) -> DataFrame:
    """The rows of nodes(node, file, signals array, fineness, span) without a better one in their file.

    A node is shadowed by another of the same file with all its signals that is
    finer, or as fine and of a shorter span. Pairs meet by (file, signal): a
    node with a signal in common is the only one that can hold all of them.
    """
    a = nodes.select(F.col("node").alias("a"), "file", "signals", F.col("fineness").alias("fa"), F.col("span").alias("sa"))
    b = nodes.select(F.col("node").alias("b"), "file", F.col("signals").alias("theirs"), F.col("fineness").alias("fb"), F.col("span").alias("sb"))
    # The least of a node's signals is among any superset.
    a = a.withColumn("key", F.array_min("signals"))
    b = b.withColumn("key", F.explode("theirs"))
    better = (F.col("fb") > F.col("fa")) | ((F.col("fb") == F.col("fa")) & (F.col("sb") < F.col("sa")))
    hidden = a.join(b, ["file", "key"]).where((F.col("a") != F.col("b")) & better & (F.size(F.array_except("signals", "theirs")) == 0)).select(F.col("a").alias("node")).distinct()
    return nodes.join(hidden, "node", "left_anti")

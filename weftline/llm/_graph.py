"""Connected components of an edge table, and bounded groups."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._session import Scratch


def connected_components(edges: DataFrame, scratch: Scratch, name: str = "cc") -> DataFrame:
    """(node, component): the smallest node reachable, for every node of edges(u, v).

    Alternates large-star and small-star steps until the edges stop changing,
    about log2 of the longest chain times. A step aggregates minima per node
    (combined before the shuffle) and joins them back, so no task holds the
    neighbours of a node. Every step's edges are written to the shared folder.
    Self loops and nulls are ignored; an empty table gives an empty result.
    """
    kind = edges.schema["u"].dataType
    edges = edges.select(F.col("u").cast(kind), F.col("v").cast(kind)).where("u <> v")
    edges = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    step, state = 0, None
    edges = scratch.table(edges, f"{name}{step}")
    while True:
        now = edges.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v")), F.bit_xor(F.xxhash64("v", "u"))).first()
        if tuple(now) == state or not now[0]:
            break
        state = tuple(now)
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = scratch.table(large.distinct(), f"{name}{step}l")
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        joined = large.join(low, "u")
        small = joined.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        small = small.unionByName(low.select("u", F.col("m").alias("v"))).distinct()
        step += 1
        edges = scratch.table(small, f"{name}{step}")
        scratch.drop(f"{name}{step - 1}")
        scratch.drop(f"{name}{step - 1}l")
    out = edges.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return out.unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())


def block_pairs(members: DataFrame, total: str, cap: int, by: str) -> DataFrame:
    """members with columns bi <= bj added: the blocks whose pairing a row takes part in.

    A group of a size over cap is cut into ceil(total / cap) blocks by a hash
    of `by`; every two blocks, and each block with itself, form a group of
    their own, so each pair of rows meets and no group exceeds about two caps.
    """
    n = F.ceil(F.col(total) / F.lit(cap)).cast("int")
    members = members.withColumn("_n", n).withColumn("_b", F.pmod(F.xxhash64(by), F.col("_n")).cast("int"))
    others = F.when(F.col("_n") <= 1, F.array(F.lit(0))).otherwise(F.sequence(F.lit(0), F.col("_n") - 1))
    members = members.withColumn("_o", F.explode(others))
    return members.withColumn("bi", F.least("_b", "_o")).withColumn("bj", F.greatest("_b", "_o")).drop("_n", "_b", "_o")

"""Connected components of an edge table, wholly in Spark."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallywright.llm.common import stored


def _state(edges: DataFrame) -> tuple:
    """Equal for equal edge sets; one row to the driver."""
    h = F.xxhash64("u", "v")
    return tuple(edges.agg(F.count("*"), F.bit_xor(h), F.sum(h.cast("decimal(38,0)"))).first())


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("k"), F.least("u", "m").alias("m"))
    return both.filter("v > u").join(least, F.col("u") == F.col("k")).select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    least = edges.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("k"), "m")
    moved = edges.join(least, F.col("u") == F.col("k")).filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.union(least.select(F.col("k").alias("u"), F.col("m").alias("v"))).distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, component) for every node with an edge; component is the least node reachable.

    ``edges`` has two columns of node ids; nulls and loops are dropped. Large-star and small-star
    steps alternate until the edges are stars around their least node. Each round is written to the
    shared folder, so a lost executor costs one round at most. No edges give no rows.
    """
    a, b = edges.columns[:2]
    e = (
        edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v"), F.col(a).alias("a"), F.col(b).alias("b"))
        .filter("a is not null and b is not null and u <> v").select("u", "v").distinct()
    )
    e = stored(e, "edges")
    before = None
    while (now := _state(e)) != before:
        before = now
        if not now[0]:
            break
        e = stored(_small_star(_large_star(e)), "edges", rows=2 * now[0])
    return e.select(F.col("u").alias("node"), F.col("v").alias("component")).union(
        e.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    )

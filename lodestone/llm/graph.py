"""Connected components of an edge table, by alternating star contractions."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from lodestone.plans.scratch import Scratch


def _large_star(edges: DataFrame) -> DataFrame:
    """Link every larger neighbour of a node to the node's smallest neighbour."""
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    low = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("low"))
    return (both.filter("b > a").join(low.hint("merge"), "a").select(F.col("b").alias("a"), F.col("low").alias("b"))
            .filter("a <> b").distinct())


def _small_star(edges: DataFrame) -> DataFrame:
    """Link every smaller neighbour of a node, and the node itself, to the smallest of them."""
    down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    low = down.groupBy("a").agg(F.min("b").alias("low"))
    moved = down.join(low.hint("merge"), "a").select(F.col("b").alias("a"), F.col("low").alias("b"))
    return moved.unionByName(low.select("a", F.col("low").alias("b"))).filter("a <> b").distinct()


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b"))).first())


def components(edges: DataFrame, scratch: Scratch, name: str = "components") -> DataFrame:
    """``node, root`` for every end of an edge ``a, b`` (longs, not null): root is the smallest node it can reach.

    Rounds grow with the logarithm of the longest path. Each round is a written table, so a lost executor costs one
    re-read; a node of many neighbours is reduced by a partial minimum, and the joins may be split by the engine.
    Self-edges are ignored; an empty table gives an empty result. No join broadcasts: how many rows a written table has, its
    bytes don't tell.
    """
    # written first, or each of the many references below would compute the edges anew
    table, before, turn = scratch.write(edges.select("a", "b").filter("a <> b").distinct(), f"{name}-edges"), None, 0
    while True:
        table = scratch.write(_small_star(_large_star(table)), f"{name}-{turn}")
        after = _state(table)
        if after == before:
            return table.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(
                table.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
        before, turn = after, turn + 1

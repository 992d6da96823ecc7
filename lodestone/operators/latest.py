"""Last write wins."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F


def latest_by_key(rows: DataFrame, key: str = "doc_key", order: str = "ts", ties=()) -> DataFrame:
    """Newest row per key; ``ties`` (descending) settle equal ``order`` values.

    ``row_number() = 1`` lets Spark plan a group limit on both sides of the shuffle: every map task sends
    at most one row per key, however many rows a hot key holds.
    """
    newest = Window.partitionBy(key).orderBy(F.desc(order), *[F.desc(t) for t in ties])
    return rows.withColumn("_rank", F.row_number().over(newest)).where("_rank = 1").drop("_rank")

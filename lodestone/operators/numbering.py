"""Positions within large groups."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from lodestone.plans.scratch import Scratch


def number_within(rows: DataFrame, key: str, order: str, scratch: Scratch, name: str, out_col: str) -> DataFrame:
    """1-based position of each row within its ``key`` by ``order`` (distinct per key), for keys of any size.

    Rows are range-partitioned by key and order, counted per key and partition, and numbered inside each
    partition; a key's offsets are one row per partition. No task ever holds more of a key than a partition.
    """
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = rows.repartitionByRange(parts, key, order).withColumn("_part", F.spark_partition_id())
    stored = scratch.write(ranged, name)
    earlier = Window.partitionBy(key).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = stored.groupBy(key, "_part").agg(F.count("*").alias("_size")).select(
        key, "_part", F.coalesce(F.sum("_size").over(earlier), F.lit(0)).alias("_before"))
    inside = F.row_number().over(Window.partitionBy(key, "_part").orderBy(order))
    return (stored.withColumn(out_col, inside).join(offsets, [key, "_part"])
            .withColumn(out_col, F.col(out_col) + F.col("_before")).drop("_part", "_before"))

"""Column helpers shared by the operators: word lists, text keys, readers of the given tables."""

from __future__ import annotations

from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

BLANKS = r"[ \t-\r]+"  # U+0020 and U+0009 to U+000D


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@contextmanager
def small_batches(spark: SparkSession, rows: int = 1000):
    """While it is open, jobs pass texts to Python in small batches, which bounds what workers and the engine hold of them."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, rows)
    try:
        yield
    finally:
        spark.conf.set(name, before)


def unused(df: DataFrame, *names: str) -> list[str]:
    """The names, each lengthened until no column of the table has it."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def text_of(column: Column | str) -> Column:
    """The text itself; null counts as empty."""
    return F.coalesce(F.col(column) if isinstance(column, str) else column, F.lit(""))


def words_of(text: Column, separators: str = BLANKS) -> Column:
    """Words between runs of separators."""
    return F.array_remove(F.split(text, separators), "")


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z only. Pure ASCII texts take the engine's own fast path."""
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return F.when(F.length(text) == F.octet_length(text), F.lower(text)).otherwise(
        F.translate(text, upper, upper.lower()))


def text_key(text: Column) -> Column:
    """128 bits that stand for a text, as a struct of two independent hashes; equal texts share it."""
    return F.struct(F.xxhash64(text).alias("a"), F.xxhash64(F.lit("second"), text, F.octet_length(text)).alias("b"))

"""Page and question tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from lodestone import schemas


def read_pages(spark: SparkSession, path: str) -> DataFrame:
    """Fetched pages: ``page_id, url, html``."""
    return spark.read.schema(schemas.PAGE).parquet(path)


def as_questions(df: DataFrame, q_id: str, question: str, top_k: int | None = None) -> DataFrame:
    """Any table as ``q_id, question``, with ``top_k`` when one is given."""
    out = df.select(F.col(q_id).alias("q_id"), F.col(question).alias("question"))
    return out if top_k is None else out.withColumn("top_k", F.lit(top_k))


def spread(df: DataFrame) -> DataFrame:
    """Give a scan at least one partition per core before costly per-row work.

    Only for plain scans: a table of few files gets repartitioned, one of many files is returned as it is.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= cores else df.repartition(cores)


TASKS_PER_CORE = 8


def few_tasks(files: DataFrame) -> DataFrame:
    """A scan of many small files in a bounded number of tasks: Spark deals some 32 small files to a task, so that millions
    of files would make a hundred thousand tasks. What a task reads streams through it."""
    return files.coalesce(TASKS_PER_CORE * files.sparkSession.sparkContext.defaultParallelism)

"""Documents -> searchable chunks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation, SparkSession, functions as F

from lodestone import settings
from lodestone.functions.text import strip_ws
from lodestone.operators.chunking import chunk_docs, chunk_id
from lodestone.operators.embed import embed


def long_enough(min_chars: int = settings.MIN_DOC_CHARS) -> Column:
    return F.length(strip_ws(F.coalesce("content", F.lit("")))) >= min_chars


def split_docs(docs: DataFrame, min_chars: int = settings.MIN_DOC_CHARS) -> tuple[DataFrame, DataFrame]:
    """``(long enough, errors)``."""
    enough = long_enough(min_chars)
    errors = docs.where(~enough).select(
        F.lit("index").alias("stage"), F.col("url").alias("key"),
        F.concat(F.lit("Skipping document with no content: "), "url").alias("message"))
    return docs.where(enough), errors


def by_key(docs: DataFrame) -> DataFrame:
    """``docs`` dealt by ranges of ``doc_key``, sorted within each: one partition per core and per split of their scan at
    least. Chunks made of them come in that order."""
    parts = max(docs.sparkSession.sparkContext.defaultParallelism, docs.rdd.getNumPartitions())
    return docs.repartitionByRange(parts, "doc_key").sortWithinPartitions("doc_key")


def build_index(docs: DataFrame, size: int = settings.CHUNK_SIZE, overlap: int = settings.CHUNK_OVERLAP,
                embed_fn=None, dim: int = settings.EMBED_DIM) -> tuple[DataFrame, DataFrame]:
    """``docs`` (doc_key unique, url, title, content) -> ``(chunks with embedding, errors)``.

    A narrow pipeline: no shuffle between the document scan and the chunk sink.
    """
    good, errors = split_docs(docs)
    chunks = chunk_docs(
        good.select("doc_key", "url", F.coalesce("title", F.lit("")).alias("title"), "content"), size, overlap)
    chunks = chunks.withColumn("chunk_id", chunk_id(F.col("url"), F.col("chunk_index")))
    return embed(chunks, "content", embed_fn, dim), errors


def index_config(spark: SparkSession, chunks: DataFrame, model: str = settings.HASH_MODEL,
                 size: int = settings.CHUNK_SIZE, overlap: int = settings.CHUNK_OVERLAP,
                 dim: int = settings.EMBED_DIM) -> DataFrame:
    """One row of metadata about a (written) chunk table."""
    return chunks.agg(F.count("*").alias("total_chunks")).select(
        F.lit(model).alias("embedding_model"), F.lit(size).alias("chunk_size"),
        F.lit(overlap).alias("chunk_overlap"), F.lit(dim).alias("embedding_dim"), "total_chunks",
        F.unix_timestamp().cast("double").alias("timestamp"))


def index_result(chunks: DataFrame, errors: DataFrame) -> DataFrame:
    """One row: number of vectors and of errors; the errors themselves stay a table. Counts in one pass over both; a
    published index has been counted while it was written (``upkeep.index_totals``)."""
    kinds = chunks.select(F.lit(0).alias("kind")).unionByName(errors.select(F.lit(1).alias("kind")))
    return kinds.agg(F.count_if(F.col("kind") == 0).alias("vector_count"), F.count_if(F.col("kind") == 1).alias("error_count"))


def index_status(config: DataFrame) -> DataFrame:
    return config.select(F.col("total_chunks").alias("vector_count"), "embedding_model", "chunk_size",
                         "chunk_overlap")


def error_counts(errors: DataFrame) -> DataFrame:
    return errors.groupBy("stage").agg(F.count("*").alias("errors"))


def error_digest(errors: DataFrame, n: int = 5) -> DataFrame:
    """First ``n`` messages (by stage and key) and how many more there are, from one pass that also counts."""
    seen = Observation()
    shown = errors.select("stage", "key", "message").observe(seen, F.count("*").alias("n")).orderBy("stage", "key", "message").limit(n)
    rows = shown.collect()  # n rows
    more = seen.get["n"] - n if len(rows) == n else 0
    return errors.sparkSession.createDataFrame(
        [(*r, more) for r in rows], "stage string, key string, message string, more long")



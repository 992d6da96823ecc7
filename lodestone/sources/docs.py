"""Document tables: scans of JSON files and parquet, append-only batches with last-write-wins reads."""

from __future__ import annotations

import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from lodestone import schemas, settings
from lodestone.functions.urls import doc_key
from lodestone.operators.latest import latest_by_key
from lodestone.sources.pages import few_tasks


def _or_empty(spark: SparkSession, schema, read) -> DataFrame:
    """``read()``, or an empty table when the path does not exist."""
    try:
        return read()
    except AnalysisException as problem:
        if problem.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


def read_docs(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Document JSON files of a folder (one object per file, crawl summary left out) -> ``(docs, errors)``.

    An unreadable file or one without a URL becomes an error row; the others proceed. A missing folder is an
    empty corpus. Title and content default to the empty string.
    """
    schema = T.StructType([*schemas.DOC_FILE, T.StructField("_bad", T.StringType())])
    empty = T.StructType([*schema, T.StructField("_file", T.StringType())])

    def scan():
        files = (spark.read.schema(schema).option("multiLine", True).option("pathGlobFilter", "*.json")
                 .option("columnNameOfCorruptRecord", "_bad").json(path))
        return few_tasks(files.select("*", F.col("_metadata.file_name").alias("_file")))

    raw = _or_empty(spark, empty, scan).where(F.col("_file") != settings.SUMMARY_FILE)
    broken = F.col("_bad").isNotNull() | F.col("url").isNull()
    reason = F.when(F.col("_bad").isNotNull(), F.lit("not a document")).otherwise(F.lit("url missing"))
    errors = raw.where(broken).select(
        F.lit("load").alias("stage"), F.col("_file").alias("key"),
        F.concat(F.lit("Error loading "), "_file", F.lit(": "), reason).alias("message"))
    docs = raw.where(~broken).select(
        F.col("_file").alias("doc_key"), "url", F.coalesce("title", F.lit("")).alias("title"),
        F.coalesce("content", F.lit("")).alias("content"), F.col("timestamp").alias("ts"),
        F.coalesce("content_length", F.length(F.coalesce("content", F.lit("")))).alias("content_length"))
    return docs, errors


def page_docs(extracted: DataFrame, ts: Column | None = None) -> DataFrame:
    """Extracted pages -> document rows, keyed by URL."""
    return extracted.where(F.col("error").isNull()).select(
        doc_key(F.col("url")).alias("doc_key"), "url", "title", "content",
        (F.unix_timestamp().cast("double") if ts is None else ts).alias("ts"),
        F.length("content").alias("content_length"))


def write_docs(docs: DataFrame, path: str, batch: str | None = None) -> str:
    """Add a batch of document versions; cost is that of the batch, not of the table.

    ``read_current_docs`` makes it an upsert. A named ``batch`` is overwritten when written again, so a retried
    job leaves one copy.
    """
    target = f"{path}/batch={batch or uuid.uuid4().hex}"
    docs.select(*schemas.DOC.fieldNames()).write.mode("overwrite").parquet(target)
    return target


def append_uploads(docs: DataFrame, path: str) -> str:
    """Uploads are appended under their own keys, beside crawled documents."""
    return write_docs(docs, path)


def read_doc_versions(spark: SparkSession, path: str) -> DataFrame:
    return _or_empty(spark, schemas.DOC, lambda: spark.read.schema(schemas.DOC).parquet(path))


def read_current_docs(spark: SparkSession, path: str) -> DataFrame:
    """Newest version per document key over all batches."""
    return latest_by_key(read_doc_versions(spark, path), "doc_key", "ts", ties=("content",))


def compact_docs(spark: SparkSession, path: str, new_path: str) -> None:
    """Write the current versions to a new table; the one being read is left alone."""
    write_docs(read_current_docs(spark, path), new_path, batch="compacted")


def write_report(summary: DataFrame, errors: DataFrame, path: str) -> None:
    """Crawl report: one JSON row per site in ``summary``, one per error in ``errors``."""
    summary.write.mode("overwrite").json(f"{path}/summary")
    errors.write.mode("overwrite").json(f"{path}/errors")

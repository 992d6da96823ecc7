"""Arriving documents -> document table and index, without a rebuild."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T
from pyspark.sql.streaming import StreamingQuery

from lodestone import schemas, settings
from lodestone.operators.chunking import chunk_docs, chunk_id
from lodestone.operators.embed import embed
from lodestone.operators.latest import latest_by_key
from lodestone.plans.index import split_docs
from lodestone.plans.scratch import Scratch
from lodestone.sources.docs import write_docs


def ingest_stream(docs: DataFrame, out_dir: str, checkpoint: str, size: int = settings.CHUNK_SIZE,
                  overlap: int = settings.CHUNK_OVERLAP, embed_fn=None, dim: int = settings.EMBED_DIM,
                  trigger: dict | None = None) -> StreamingQuery:
    """Index a stream of documents (schema ``DOC``).

    Each micro-batch writes its documents, chunks and errors to folders named after the batch, overwriting them
    when Spark replays the batch, so a restart leaves nothing twice. Newer versions of a document win on read
    (``read_ingested``).
    """

    def store(batch: DataFrame, batch_id: int):
        ingest_batch(batch, out_dir, str(batch_id), size, overlap, embed_fn, dim)

    writer = docs.select(*schemas.DOC.fieldNames()).writeStream.foreachBatch(store)
    return writer.option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def ingest_batch(docs: DataFrame, out_dir: str, batch: str, size: int = settings.CHUNK_SIZE,
                 overlap: int = settings.CHUNK_OVERLAP, embed_fn=None, dim: int = settings.EMBED_DIM) -> None:
    """Write the documents, chunks and errors of one batch, a micro-batch or uploads, over those of an earlier try."""
    stored = write_docs(latest_by_key(docs, ties=("content",)), f"{out_dir}/docs", batch=batch)
    good, errors = split_docs(docs.sparkSession.read.schema(schemas.DOC).parquet(stored))
    chunks = chunk_docs(good.select("doc_key", "url", "title", "content", "ts"), size, overlap)
    chunks = chunks.withColumn("chunk_id", chunk_id(F.col("url"), F.col("chunk_index")))
    embed(chunks, "content", embed_fn, dim).write.mode("overwrite").parquet(f"{out_dir}/chunks/batch={batch}")
    errors.write.mode("overwrite").parquet(f"{out_dir}/errors/batch={batch}")


def append_ingested_uploads(docs: DataFrame, out_dir: str, **ways) -> None:
    """Uploads beside the streamed documents, chunked as these are; ``ways`` as in ``ingest_batch``."""
    ingest_batch(docs, out_dir, f"upload-{uuid.uuid4().hex}", **ways)


def table_path(path: str) -> str:
    """A path under which a stream finds a table, be it one file or a folder of part files: a pattern that only it matches,
    since a stream takes a plain path for a folder."""
    path = path.rstrip("/")
    return f"{path[:-1]}[{path[-1]}]"


def doc_stream(spark: SparkSession, path: str, max_files: int = 1000) -> DataFrame:
    """Stream of document parquet files appearing below ``path``."""
    return (spark.readStream.schema(schemas.DOC).option("recursiveFileLookup", True)
            .option("maxFilesPerTrigger", max_files).parquet(path))


def read_ingested(spark: SparkSession, out_dir: str) -> DataFrame:
    """The chunks of every document's newest version.

    Newest is decided on the narrow columns of the documents, so that a newer version too short to be indexed
    also removes the older one. Only the superseded versions are joined away: few beside the chunks, which
    are not shuffled while that holds.
    """
    batch = T.StructField("batch", T.StringType())  # stated, or folder names would settle its type
    versions = spark.read.schema(T.StructType([*schemas.DOC, batch])).parquet(f"{out_dir}/docs").select("doc_key", "ts", "batch")
    # micro-batches by number; a batch with another name is older than those of its time
    version = F.struct("ts", F.expr("try_cast(batch as bigint)").alias("number"), "batch")
    newest = versions.groupBy("doc_key").agg(F.max(version).alias("_newest"))
    old = versions.join(newest, "doc_key").where(~version.eqNullSafe(F.col("_newest")))
    old = Scratch(spark, "superseded").write_small(old.select("doc_key", "batch"), "versions")
    chunks = spark.read.parquet(f"{out_dir}/chunks").schema
    chunks = T.StructType([*[f for f in chunks if f.name != "batch"], batch])
    return spark.read.schema(chunks).parquet(f"{out_dir}/chunks").join(old, ["doc_key", "batch"], "left_anti")

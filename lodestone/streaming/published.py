"""Streams that write and read a published index."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from lodestone import schemas, settings
from lodestone.plans.ask import ask_batch
from lodestone.plans.upkeep import upsert_published
from lodestone.sources.index import open_index


def _source(spark: SparkSession, checkpoint: str) -> str:
    """The name of the stream that owns a checkpoint, from the checkpoint itself: a new one is another stream."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{checkpoint.rstrip('/')}/metadata")
    stream = path.getFileSystem(spark._jsc.hadoopConfiguration()).open(path)
    try:
        return json.loads(spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))["id"]
    finally:
        stream.close()


def index_stream(docs: DataFrame, path: str, checkpoint: str, trigger: dict | None = None, **ways) -> StreamingQuery:
    """Add a stream of documents (``schemas.DOC``) to the index at ``path``, a version per micro-batch.

    The manifest carries the stream's progress: a micro-batch that is replayed after its version was published changes
    nothing. ``ways`` as in ``upsert_published``.
    """
    spark = docs.sparkSession

    def store(batch: DataFrame, batch_id: int):
        upsert_published(batch, path, applied={_source(spark, checkpoint): batch_id}, **ways)

    writer = docs.select(*schemas.DOC.fieldNames()).writeStream.foreachBatch(store)
    return writer.option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def ask_published(questions: DataFrame, path: str, out_dir: str, checkpoint: str, k: int = settings.TOP_K,
                  threshold: float | None = settings.SIMILARITY_THRESHOLD, generate_fn=None, embed_fn=None,
                  dim: int = settings.EMBED_DIM, trigger: dict | None = None) -> StreamingQuery:
    """Answer a stream of questions (q_id, question), each micro-batch against the newest version of the index then.

    Answers carry ``index_version``. A replayed micro-batch overwrites its own folder. Raises when there is no index.
    """

    def answer(batch: DataFrame, batch_id: int):
        index = open_index(batch.sparkSession, path, expect_dim=dim)
        if index is None:
            raise FileNotFoundError(f"no index at {path}")
        answers = ask_batch(batch, index, k, threshold, generate_fn, embed_fn, dim)
        answers.withColumn("index_version", F.lit(index.number)).write.mode("overwrite").parquet(f"{out_dir}/batch={batch_id}")

    return (questions.writeStream.foreachBatch(answer).option("checkpointLocation", checkpoint)
            .trigger(**(trigger or {"availableNow": True})).start())

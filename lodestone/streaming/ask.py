"""Questions as a stream, answered against a static index."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from lodestone import settings
from lodestone.plans.ask import ask_batch


def ask_stream(questions: DataFrame, index: DataFrame, out_dir: str, checkpoint: str,
               k: int = settings.TOP_K, threshold: float | None = settings.SIMILARITY_THRESHOLD,
               generate_fn=None, embed_fn=None, trigger: dict | None = None) -> StreamingQuery:
    """Answer each micro-batch of ``questions`` (q_id, question) into its own folder, replays overwriting it."""

    def answer(batch: DataFrame, batch_id: int):
        ask_batch(batch, index, k, threshold, generate_fn, embed_fn).write.mode("overwrite").parquet(
            f"{out_dir}/batch={batch_id}")

    return (questions.writeStream.foreachBatch(answer).option("checkpointLocation", checkpoint)
            .trigger(**(trigger or {"availableNow": True})).start())

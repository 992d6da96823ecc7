"""Tables written to the shared checkpoint folder to cut lineage."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F


def checkpoint_root(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir`` (or set on the context).

    Only a local session without one gets a temporary folder of its own: on a cluster such a folder would
    not be shared, so there the setting is required.
    """
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if root:
        return root.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    root = tempfile.mkdtemp(prefix="lodestone-")
    spark.sparkContext.setCheckpointDir(root)
    return root


class Scratch:
    """One run's private folder of written tables. Lost executors re-read files instead of recomputing.

    Results are lazy, so the folder outlives the call that made it; ``drop`` it once the result is consumed, or use the
    object in a ``with`` block around the action. What is left goes when the session's driver ends.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.path = f"{checkpoint_root(spark)}/{name}-{uuid.uuid4().hex}"
        folder, files = self._folder()
        files.mkdirs(folder)
        files.deleteOnExit(folder)

    def __enter__(self):
        return self

    def __exit__(self, *_):
        self.drop()

    def drop(self) -> None:
        """Delete the folder, on whatever storage it lies."""
        folder, files = self._folder()
        files.delete(folder, True)

    def _folder(self, name: str = ""):
        """A folder below, and the storage it lies on."""
        folder = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}" if name else self.path)
        return folder, folder.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def write(self, df: DataFrame, name: str, partition_by: str | None = None) -> DataFrame:
        target = f"{self.path}/{name}"
        writer = df.write.mode("overwrite")
        (writer.partitionBy(partition_by) if partition_by else writer).parquet(target)
        return self.spark.read.schema(df.schema).parquet(target)

    def read(self, schema, *names: str) -> DataFrame:
        return self.spark.read.schema(schema).parquet(*[f"{self.path}/{n}" for n in names])

    def bytes(self, name: str) -> int:
        """Bytes of the files of a written table."""
        folder, files = self._folder(name)
        return files.getContentSummary(folder).getLength()

    def write_small(self, df: DataFrame, name: str, max_rows: int = 1_000_000, max_bytes: int = 64 << 20) -> DataFrame:
        """Written table, marked for broadcast only when its files and counted rows are within the bounds."""
        stored = self.write(df, name)
        return F.broadcast(stored) if self.bytes(name) <= max_bytes and stored.count() <= max_rows else stored

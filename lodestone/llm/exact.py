"""Exact duplicates, found by a stream whose state stays on disk.

The table's files arrive in micro-batches. For every digest the stream's state holds, without expiry, how many rows had it,
the row that stays (the one with the largest id) and where its content lies (file and row). State lives in the engine's
disk-backed store and is saved to the shared folder with every micro-batch, so a run can go on after a lost executor or a
stop, and rows that arrive later meet all earlier ones. Each micro-batch hands on the groups that it has touched.

Equal digests are only hits. The bytes of every hit are compared with those of the row that stays, which is read again
through its locator; rows of a digest with unlike bytes are grouped by the text itself. Hits of large groups are spread over
several keys, and the row that stays is sent to each of them.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T
from pyspark.sql.streaming import StreamingQuery

from lodestone.llm.columns import text_of
from lodestone.plans.scratch import Scratch
from lodestone.streaming.ingest import table_path

FILES = 1000           # files of a micro-batch
SPREAD = 2_000         # rows of one digest that meet under one key
SMALL = 100_000        # groups of more than one row that are broadcast; more are joined by a shuffle
_STORE = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
    "spark.sql.streaming.stateStore.rocksdb.boundedMemoryUsage": "true",
    "spark.sql.streaming.stateStore.rocksdb.allowFAllocate": "false",  # else every partition's store reserves 4 MB of disk
}


def sha256(text: Column) -> Column:
    return F.unhex(F.sha2(text, 256))


def _schema(spark: SparkSession, path: str, key: str, text: str) -> T.StructType:
    whole = spark.read.parquet(path).schema
    return T.StructType([whole[key], whole[text]])


def _rows(files: DataFrame, key: str, text: str, digest: Callable[[Column], Column]) -> DataFrame:
    """``id, text, digest, file, row``."""
    return files.select(F.col(key).alias("id"), text_of(text).alias("text"), F.col("_metadata.file_path").alias("file"),
                        F.col("_metadata.row_index").alias("row")).withColumn("digest", digest(F.col("text")))


def dedup_stream(spark: SparkSession, path: str, out_dir: str, checkpoint: str, key: str = "doc_id", text: str = "text",
                 digest: Callable[[Column], Column] = sha256, max_files: int = FILES, trigger: dict | None = None) -> StreamingQuery:
    """Stream the Parquet table at ``path``; ``out_dir`` gets the groups that each micro-batch has touched (``read_groups``).

    Started again with the same ``checkpoint`` it goes on where it stopped; a replayed micro-batch overwrites its own folder.
    """
    files = spark.readStream.schema(_schema(spark, path, key, text)).option("maxFilesPerTrigger", max_files).parquet(table_path(path))
    rows = _rows(files, key, text, digest)
    groups = rows.groupBy("digest").agg(F.count("*").alias("n"), F.max(F.struct("id", "file", "row")).alias("keep"))

    def store(batch: DataFrame, batch_id: int):
        batch.write.mode("overwrite").parquet(f"{out_dir}/batch={batch_id}")

    before = {k: spark.conf.get(k, None) for k in _STORE}
    for k, v in _STORE.items():
        spark.conf.set(k, v)
    try:  # a query keeps the settings that it was started with
        return (groups.writeStream.outputMode("update").foreachBatch(store).option("checkpointLocation", checkpoint)
                .trigger(**(trigger or {"availableNow": True})).start())
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def read_groups(spark: SparkSession, out_dir: str, key_type: T.DataType) -> DataFrame:
    """``digest, n, keep`` of all groups as the newest micro-batch left them; none if no batch was written."""
    keep = T.StructType([T.StructField("id", key_type), T.StructField("file", T.StringType()), T.StructField("row", T.LongType())])
    schema = T.StructType([T.StructField("digest", T.BinaryType()), T.StructField("n", T.LongType()), T.StructField("keep", keep)])
    folder = spark._jvm.org.apache.hadoop.fs.Path(out_dir)
    if not folder.getFileSystem(spark._jsc.hadoopConfiguration()).exists(folder):
        return spark.createDataFrame([], schema)
    touched = spark.read.schema(schema).parquet(out_dir)
    newest = touched.groupBy("digest").agg(F.max(F.struct("n", "keep")).alias("newest"))  # n grows whenever a group is touched
    return newest.select("digest", "newest.n", "newest.keep")


def unlike(rows: DataFrame, hits: DataFrame, spread: int = SPREAD) -> DataFrame:
    """``digest`` of the hits whose bytes differ from those of the row that stays."""
    keys = F.ceil(F.col("n") / spread).cast("int")
    found = rows.join(hits, "digest")
    stays = F.struct("file", "row") == F.struct("keep.file", "keep.row")
    kept = found.filter(stays).select("digest", F.explode(F.sequence(F.lit(0), keys - 1)).alias("part"), F.col("text").alias("stays"))
    others = found.filter(~stays).select("digest", F.pmod(F.xxhash64("file", "row"), keys).cast("int").alias("part"), "text")
    return others.join(kept, ["digest", "part"], "left").filter(~F.col("text").eqNullSafe(F.col("stays"))).select("digest").distinct()


def exact_duplicates(spark: SparkSession, path: str, key: str = "doc_id", text: str = "text", digest: Callable[[Column], Column] = sha256,
                     max_files: int = FILES, spread: int = SPREAD, small: int = SMALL) -> DataFrame:
    """``key, keep_id, group_size, kept, text_sha256`` of every row of the Parquet table (a file or a folder) at ``path``.

    Texts are equal if all their bytes are; null counts as empty, and is hashed as such. ``keep_id`` is the largest key of
    the group, ``kept`` marks the one row that stays: of repeated rows with that key the last by file and place; a null key
    is smaller than any. Other columns are not read, whatever their names. An empty table gives an empty result.
    """
    scratch = Scratch(spark, "exact")
    schema = _schema(spark, path, key, text)
    dedup_stream(spark, path, f"{scratch.path}/groups", f"{scratch.path}/state", key, text, digest, max_files).awaitTermination()
    groups = read_groups(spark, f"{scratch.path}/groups", schema[key].dataType)
    hits = scratch.write_small(groups.filter("n > 1"), "hits", small)
    rows = _rows(spark.read.schema(schema).parquet(path), key, text, digest)
    wrong = scratch.write_small(unlike(rows, hits, spread), "unlike", small)
    out = rows.join(hits, "digest", "left")
    if not wrong.isEmpty():
        exact = rows.join(wrong, "digest").groupBy("digest", "text").agg(
            F.count("*").alias("n"), F.max(F.struct("id", "file", "row")).alias("keep"))
        exact = scratch.write(exact, "exact")
        out = out.join(wrong, "digest", "left_anti").unionByName(
            rows.join(wrong, "digest", "left_semi").join(exact, ["digest", "text"]).select(*out.columns))
    single = F.col("n").isNull()
    return out.select(
        F.col("id").alias(key), F.when(single, F.col("id")).otherwise(F.col("keep.id")).alias("keep_id"),
        F.coalesce("n", F.lit(1)).cast("long").alias("group_size"),
        (single | (F.struct("file", "row") == F.struct("keep.file", "keep.row"))).alias("kept"), F.sha2("text", 256).alias("text_sha256"))

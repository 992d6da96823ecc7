"""The stored index: published versions of a chunk table with its vectors, made of segments.

A version names its segments: one base, sorted by document, and what was added since (``lodestone.plans.upkeep``). Each
segment holds chunks and, where upkeep wrote it, one narrow row per document: key, fingerprint, time, deleted or not. Of a
document in several segments the newest row counts; only documents outside the base are ever compared for that.

Beside a sorted segment lies its directory: the first and last key of every file. Texts of hits are read from the files
that can hold them, by their keys; scoring reads keys and vectors only.
"""

from __future__ import annotations

import json
from bisect import bisect_left
from functools import cached_property, reduce

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from lodestone import schemas, settings
from lodestone.plans.scratch import Scratch
from lodestone.sources.published import Published, Version

LOOKUP_KEYS = 10_000     # documents whose files are looked up one by one; more are joined with all of the index
LOOKUP_FILES = 200_000   # directory rows that the driver reads for that
EXACT_KEYS = 256         # keys that the scan tests one by one in its statistics and bloom filters
BLOCK_BYTES = 16 << 20   # of a sorted file's row groups

DOC_ROW = T.StructType([
    T.StructField("doc_key", T.StringType()), T.StructField("fingerprint", T.BinaryType()), T.StructField("ts", T.DoubleType()),
    T.StructField("deleted", T.BooleanType())])


def _any_of(column: Column, keys: list) -> Column:
    """``isin`` that row groups can be tested for: equalities as a balanced tree while there are few keys."""
    if len(keys) > EXACT_KEYS:
        return column.isin(keys)
    tests = [column == k for k in keys]
    while len(tests) > 1:
        tests = [reduce(lambda a, b: a | b, tests[i:i + 2]) for i in range(0, len(tests), 2)]
    return tests[0]


class StoredIndex:
    """One version of an index, as it was published: what later versions change isn't seen here."""

    def __init__(self, table: Published, version: Version):
        self.table, self.version, self.spark = table, version, table.spark
        self.number, self.settings = version.number, version.content["config"]
        self.segments = version.content["segments"]
        self.chunk_schema = T.StructType.fromJson(json.loads(version.content["schema"]))

    def docs_of(self, segments: list[dict]) -> DataFrame:
        """``DOC_ROW`` and ``segment`` of all document rows, newest or not."""
        schema = T.StructType([T.StructField("doc_key", self.chunk_schema["doc_key"].dataType), *DOC_ROW.fields[1:]])
        parts = [self.spark.read.schema(schema).parquet(self.table.full(s["docs"])).withColumn("segment", F.lit(s["segment"]))
                 for s in segments if s["docs"]]
        return reduce(DataFrame.unionByName, parts) if parts else self.spark.createDataFrame(
            [], T.StructType([*schema, T.StructField("segment", T.IntegerType())]))

    def superseded(self, segments: list[dict], scratch: Scratch) -> DataFrame | None:
        """``doc_key, segment`` of the document rows that a newer one replaces or deletes; None if there are none.

        Compared are the documents of the later segments only; their keys are broadcast while they are few.
        """
        later = [s for s in segments[1:] if s["docs"]]
        if not later:
            return None
        keys = scratch.write_small(self.docs_of(later).select("doc_key").distinct(), "later-keys")
        rows = scratch.write(self.docs_of(segments).join(keys, "doc_key").select("doc_key", "ts", "deleted", "segment"), "contested")
        newest = rows.groupBy("doc_key").agg(F.max(F.struct("ts", "segment")).alias("newest"))
        old = rows.join(newest, "doc_key").filter(F.col("deleted") | (F.struct("ts", "segment") != F.col("newest")))
        return scratch.write_small(old.select("doc_key", "segment"), "superseded")

    @cached_property
    def _gone(self) -> DataFrame | None:
        return self.superseded(self.segments, Scratch(self.spark, "index"))

    def live(self, rows: DataFrame, gone: DataFrame | None = None) -> DataFrame:
        """``rows`` (with ``doc_key, segment``) of documents that are current."""
        gone = self._gone if gone is None else gone
        return rows.drop("segment") if gone is None else rows.join(gone, ["doc_key", "segment"], "left_anti").drop("segment")

    def chunks_of(self, segments: list[dict]) -> DataFrame:
        parts = [self.spark.read.schema(self.chunk_schema).parquet(self.table.full(s["chunks"])).withColumn("segment", F.lit(s["segment"]))
                 for s in segments]
        return reduce(DataFrame.unionByName, parts)

    @property
    def chunks(self) -> DataFrame:
        """All current chunks with their vectors."""
        return self.live(self.chunks_of(self.segments))

    @property
    def docs(self) -> DataFrame:
        """The current document rows."""
        return self.live(self.docs_of(self.segments)).filter(~F.col("deleted"))

    @property
    def config(self) -> DataFrame:
        """One row of configuration (``schemas.INDEX_CONFIG``)."""
        total = sum(s["rows"] for s in self.segments)
        if len(self.segments) > 1:
            total = self.chunks.count()
        row = {**self.settings, "total_chunks": total}
        return self.spark.createDataFrame([tuple(row[f] for f in schemas.INDEX_CONFIG.fieldNames())], schemas.INDEX_CONFIG)

    def files_for(self, segment: dict, keys: list) -> list[str] | None:
        """The files of a sorted segment that can hold one of the sorted ``keys``; None where no directory tells."""
        if not segment["files"] or segment["file_count"] > LOOKUP_FILES:
            return None
        listed = self.spark.read.parquet(self.table.full(segment["files"])).collect()

        def holds(r):
            at = bisect_left(keys, r["first"])
            return at < len(keys) and keys[at] <= r["last"]

        return [self.table.full(f"{segment['chunks']}/{r['file']}") for r in listed if holds(r)]

    def lookup(self, hits: DataFrame) -> DataFrame:
        """The current chunks of the documents in ``hits`` (a stored table with ``doc_key``): at most ``LOOKUP_KEYS``
        documents are read from the files and row groups that can hold them, more by a scan of all chunks."""
        found = hits.select("doc_key").filter("doc_key is not null").distinct().limit(LOOKUP_KEYS + 1).collect()
        if len(found) > LOOKUP_KEYS:
            return self.chunks
        keys = sorted(r[0] for r in found)
        parts = []
        for s in self.segments:
            files = self.files_for(s, keys) if keys else []
            if files is None:
                files = [self.table.full(s["chunks"])]
            if files:
                scan = self.spark.read.schema(self.chunk_schema).parquet(*files)
                parts.append(scan.filter(_any_of(F.col("doc_key"), keys)).withColumn("segment", F.lit(s["segment"])))
        if not parts:
            return self.spark.createDataFrame([], self.chunk_schema)
        return self.live(reduce(DataFrame.unionByName, parts))


def sorted_segment(table: Published, chunks: DataFrame, number: int, ordered: bool = False) -> dict:
    """Write ``chunks`` once as they come, then sorted by document, with a directory of the files. Chunks that come
    ``ordered`` (``plans.index.by_key``) are written where they are made, so that no vector is written twice or shuffled."""
    spark = table.spark
    raw, folder, files = (table.folder(k) for k in ("raw", "chunks", "files"))
    rows = chunks
    if not ordered:
        chunks.write.parquet(table.full(raw))
        stored = spark.read.schema(chunks.schema).parquet(table.full(raw))
        order = [c for c in ("doc_key", "chunk_index") if c in chunks.columns]
        rows = stored.repartitionByRange(*order).sortWithinPartitions(*order)
    (rows.write.option("parquet.bloom.filter.enabled#doc_key", "true")
     .option("parquet.block.size", BLOCK_BYTES).parquet(table.full(folder)))
    if not ordered:
        table.drop(raw)
    listed = spark.read.schema(chunks.schema).parquet(table.full(folder)).groupBy(F.col("_metadata.file_name").alias("file")).agg(
        F.min("doc_key").alias("first"), F.max("doc_key").alias("last"), F.count("*").alias("rows"))
    listed.coalesce(1).write.parquet(table.full(files))  # one row per file
    rows, count = spark.read.parquet(table.full(files)).agg(F.coalesce(F.sum("rows"), F.lit(0)), F.count("*")).first()
    return {"segment": number, "chunks": folder, "files": files, "file_count": count, "docs": None, "rows": rows, "doc_rows": 0}


def index_content(chunks: DataFrame, segments: list[dict], model: str, size: int, overlap: int, dim: int, **more) -> dict:
    config = {"embedding_model": model, "chunk_size": size, "chunk_overlap": overlap, "embedding_dim": dim,
              "timestamp": chunks.sparkSession.range(1).select(F.unix_timestamp().cast("double")).first()[0]}
    return {"config": config, "schema": chunks.schema.json(), "segments": segments, **more}


def write_index(chunks: DataFrame, path: str, model: str = settings.HASH_MODEL,
                size: int = settings.CHUNK_SIZE, overlap: int = settings.CHUNK_OVERLAP,
                dim: int = settings.EMBED_DIM, ordered: bool = False) -> StoredIndex:
    """Publish ``chunks`` as the next version of the index at ``path``; they are computed once. ``ordered`` if they are
    made of documents that ``plans.index.by_key`` dealt, which spares sorting them with their vectors.

    Versions before it stay for those who read them (``Published.expire`` drops them). A writer that fails, or is
    still at work, leaves the newest version as it is.
    """
    table = Published(chunks.sparkSession, path)
    before = table.newest()
    content = index_content(chunks, [sorted_segment(table, chunks, 0, ordered)], model, size, overlap, dim)
    return StoredIndex(table, table.publish(content, before))


def open_index(spark: SparkSession, path: str, expect_model: str | None = None,
               expect_dim: int | None = None) -> StoredIndex | None:
    """The newest complete version, or None when there is none.

    Raises when the index was built with another model or dimension than the questions will be.
    """
    table = Published(spark, path)
    version = table.newest()
    if version is None:
        return None
    built = version.content["config"]
    if expect_model is not None and built["embedding_model"] != expect_model:
        raise ValueError(f"index was built with {built['embedding_model']!r}, not {expect_model!r}")
    if expect_dim is not None and built["embedding_dim"] != expect_dim:
        raise ValueError(f"index has dimension {built['embedding_dim']}, not {expect_dim}")
    return StoredIndex(table, version)


def read_index(spark: SparkSession, path: str, expect_model: str | None = None,
               expect_dim: int | None = None) -> tuple[DataFrame, DataFrame] | None:
    """``(chunks, config)`` of the newest version, or None; see ``open_index``."""
    index = open_index(spark, path, expect_model, expect_dim)
    return None if index is None else (index.chunks, index.config)

"""A published index that grows: full builds, later states of a corpus, arriving documents, merges.

What a change costs follows the change. A later state of the corpus is compared by fingerprints, and only documents that
are new or differ are chunked and embedded; documents that are gone leave a row that says so. Arriving documents make a
segment of their own. When segments become many, the later ones are merged into one, or, once they are no longer small
beside the base, all of them into a new base.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation, functions as F

from lodestone import settings
from lodestone.operators.chunking import chunk_docs, chunk_id
from lodestone.operators.embed import embed
from lodestone.operators.latest import latest_by_key
from lodestone.plans.index import long_enough, split_docs
from lodestone.plans.scratch import Scratch
from lodestone.sources.index import StoredIndex, index_content, open_index, sorted_segment
from lodestone.sources.published import Published

MAX_SEGMENTS = 8      # beside the base; one more and they are merged
BASE_SHARE = 4        # later segments of a base's quarter, or more, are merged into it


def fingerprint() -> Column:
    """What a document's chunks are made of, as a digest. Nulls and empty values differ."""
    return F.unhex(F.sha2(F.to_json(F.struct("url", "title", "content"), {"ignoreNullFields": "false"}), 256))


def _shaped(docs: DataFrame) -> DataFrame:
    """``doc_key, url, title, content, ts``; without times all documents are of one time."""
    ts = F.coalesce(F.col("ts").cast("double"), F.lit(0.0)) if "ts" in docs.columns else F.lit(0.0)
    return docs.select("doc_key", "url", F.coalesce("title", F.lit("")).alias("title"), "content", ts.alias("ts"))


def _chunked(docs: DataFrame, ways: dict) -> tuple[DataFrame, DataFrame]:
    good, errors = split_docs(docs)
    chunks = chunk_docs(good.select("doc_key", "url", "title", "content"), ways["size"], ways["overlap"])
    chunks = chunks.withColumn("chunk_id", chunk_id(F.col("url"), F.col("chunk_index")))
    return embed(chunks, "content", ways["embed_fn"], ways["dim"]), errors


def _ways(size, overlap, embed_fn, dim, model) -> dict:
    return {"size": size, "overlap": overlap, "embed_fn": embed_fn, "dim": dim, "model": model}


def _same_settings(index: StoredIndex, ways: dict) -> bool:
    built = index.settings
    return (built["chunk_size"], built["chunk_overlap"], built["embedding_dim"], built["embedding_model"]) == (
        ways["size"], ways["overlap"], ways["dim"], ways["model"])


def _rows_of(docs: DataFrame) -> DataFrame:
    return docs.select("doc_key", fingerprint().alias("fingerprint"), "ts", F.lit(False).alias("deleted"))


def _with_docs(table: Published, segment: dict, rows: DataFrame) -> dict:
    folder = table.folder("docs")
    rows.write.parquet(table.full(folder))
    return {**segment, "docs": folder, "doc_rows": table.spark.read.parquet(table.full(folder)).count()}


def _errors(table: Published, errors: DataFrame) -> str:
    folder = table.folder("errors")
    errors.write.parquet(table.full(folder))
    return folder


def build_published(docs: DataFrame, path: str, size: int = settings.CHUNK_SIZE, overlap: int = settings.CHUNK_OVERLAP, embed_fn=None,
                    dim: int = settings.EMBED_DIM, model: str = settings.HASH_MODEL, **more) -> StoredIndex:
    """Publish an index of ``docs`` (doc_key unique, url, title, content, optional ts) from scratch.

    Documents and those too short are counted by the pass that writes the chunks.
    """
    ways = _ways(size, overlap, embed_fn, dim, model)
    table = Published(docs.sparkSession, path)
    before, seen = table.newest(), Observation()
    docs = _shaped(docs)
    chunks, _ = _chunked(docs.observe(seen, F.count("*").alias("docs"), F.count_if(~long_enough()).alias("short")), ways)
    segment = sorted_segment(table, chunks, 0)
    counted = dict(seen.get)
    segment = _with_docs(table, segment, _rows_of(docs))
    errors = [_errors(table, split_docs(docs)[1])] if counted.get("short") else []
    content = index_content(chunks, [segment], model, size, overlap, dim, errors=errors, counted=counted, **more)
    return StoredIndex(table, table.publish(content, before))


def index_corpus(docs: DataFrame, path: str, **ways) -> tuple[StoredIndex | None, DataFrame]:
    """``(index, errors)`` of a whole corpus. Without documents, or without chunks, nothing is published, what was
    published stays, and one more error row says why."""
    spark = docs.sparkSession
    table = Published(spark, path)
    if docs.isEmpty():
        why, index = "No documents found", None
    elif split_docs(docs)[0].isEmpty():
        why, index = "No chunks created", None
    else:
        index = build_published(docs, path, **ways)
        return index, published_errors(index)
    row = spark.createDataFrame([("index", "", why)], "stage string, key string, message string")
    newest = table.newest()
    return StoredIndex(table, newest) if newest else index, split_docs(docs)[1].unionByName(row)


def index_totals(index: StoredIndex) -> DataFrame:
    """One row: the vectors and error rows of a freshly built index, as counted while it was written."""
    counted = index.version.content.get("counted", {})
    return index.spark.createDataFrame([(sum(s["rows"] for s in index.segments), counted.get("short", 0))],
                                       "vector_count long, error_count long")


def _next(index: StoredIndex, segments: list[dict], errors: list[str], applied: dict | None = None) -> StoredIndex:
    content = {**index.version.content, "segments": segments, "errors": errors}
    if applied:
        content["applied"] = {**content.get("applied", {}), **applied}
    return StoredIndex(index.table, index.table.publish(content, index.version))


def update_published(docs: DataFrame, path: str, size: int = settings.CHUNK_SIZE, overlap: int = settings.CHUNK_OVERLAP, embed_fn=None,
                     dim: int = settings.EMBED_DIM, model: str = settings.HASH_MODEL) -> StoredIndex:
    """Publish the index of a later state of the whole corpus: equal to a full build, but only new and changed documents
    are chunked and embedded. Other settings than the index was built with, or an index without document rows, mean a full
    build. Without any change no version is published.
    """
    spark = docs.sparkSession
    ways = _ways(size, overlap, embed_fn, dim, model)
    index = open_index(spark, path)
    if index is None or not _same_settings(index, ways) or not all(s["docs"] for s in index.segments):
        return build_published(docs, path, size, overlap, embed_fn, dim, model)
    scratch, docs = Scratch(spark, "update"), _shaped(docs)
    held = index.docs.select("doc_key", F.col("fingerprint").alias("old"), F.col("ts").alias("old_ts"), F.lit(True).alias("held"))
    both = _rows_of(docs).drop("deleted").withColumn("now", F.lit(True)).join(held, "doc_key", "full")
    differs = F.col("held").isNull() | F.col("now").isNull() | (F.col("old") != F.col("fingerprint"))
    changes = scratch.write(both.filter(differs).select(
        "doc_key", "fingerprint", F.greatest("ts", "old_ts").alias("ts"), F.col("now").isNull().alias("deleted")), "changes")
    if changes.isEmpty():
        return index
    wanted = scratch.write_small(changes.filter(~F.col("deleted")).select("doc_key"), "changed")
    changed = scratch.write(docs.join(wanted, "doc_key", "left_semi"), "documents")
    return _add(index, changed, changes, ways)


def _add(index: StoredIndex, docs: DataFrame, rows: DataFrame, ways: dict, applied: dict | None = None) -> StoredIndex:
    """Publish a further segment: the chunks of ``docs``, and document rows, deletions among them."""
    chunks, errors = _chunked(docs, ways)
    number = max(s["segment"] for s in index.segments) + 1
    segment = _with_docs(index.table, sorted_segment(index.table, chunks, number), rows)
    found = _next(index, [*index.segments, segment], [*index.version.content.get("errors", []), _errors(index.table, errors)], applied)
    return merge_segments(found) if len(found.segments) > MAX_SEGMENTS + 1 else found


def upsert_published(docs: DataFrame, path: str, size: int = settings.CHUNK_SIZE, overlap: int = settings.CHUNK_OVERLAP, embed_fn=None,
                     dim: int = settings.EMBED_DIM, model: str = settings.HASH_MODEL, applied: dict | None = None) -> StoredIndex:
    """Publish an index that also has ``docs`` (``schemas.DOC``): of a document the row of the latest time counts, of equal
    times the one that came last, and of equal ones that came together the greater text. A first one makes the index.

    ``applied`` names a source and the number of its batch: a batch that the index has seen is left out, so that a
    replayed one adds nothing.
    """
    spark, ways = docs.sparkSession, _ways(size, overlap, embed_fn, dim, model)
    index = open_index(spark, path)
    seen = index.version.content.get("applied", {}) if index else {}
    if applied and all(seen.get(source, -1) >= batch for source, batch in applied.items()):
        return index
    if index and not _same_settings(index, ways):
        raise ValueError(f"the index was built with other settings: {index.settings}")
    batch = Scratch(spark, "batch").write(_shaped(latest_by_key(docs, ties=("content",))), "documents")
    if index is None:
        return build_published(batch, path, size, overlap, embed_fn, dim, model, applied=applied or {})
    return _add(index, batch, _rows_of(batch), ways, applied)


def merge_segments(index: StoredIndex, whole: bool | None = None) -> StoredIndex:
    """Publish the same content in fewer segments: the later ones as one, or (``whole``; if not given, once they are a
    quarter of the base) all as a new base without the rows of replaced and deleted documents."""
    base, later = index.segments[0], index.segments[1:]
    if not later:
        return index
    if whole is None:
        whole = BASE_SHARE * sum(s["rows"] + s["doc_rows"] for s in later) >= base["rows"] + base["doc_rows"]
    parts = index.segments if whole else later
    scratch = Scratch(index.spark, "merge")
    gone = _replaced(index, parts, scratch)
    chunks = index.live(index.chunks_of(parts), gone)
    rows = index.live(index.docs_of(parts), gone)
    if whole:
        rows = rows.filter(~F.col("deleted"))
    number = base["segment"] if whole else max(s["segment"] for s in later)
    merged = _with_docs(index.table, sorted_segment(index.table, chunks, number), rows)
    return _next(index, [merged] if whole else [base, merged], index.version.content.get("errors", []))


def _replaced(index: StoredIndex, segments: list[dict], scratch: Scratch) -> DataFrame:
    """``doc_key, segment`` of the document rows among ``segments`` that are not the newest; deletions that are stay."""
    rows = index.docs_of(segments).select("doc_key", "ts", "segment")
    newest = rows.groupBy("doc_key").agg(F.max(F.struct("ts", "segment")).alias("newest"), F.count("*").alias("n")).filter("n > 1")
    old = rows.join(newest, "doc_key").filter(F.struct("ts", "segment") != F.col("newest"))
    return scratch.write_small(old.select("doc_key", "segment"), "replaced")


def published_errors(index: StoredIndex) -> DataFrame:
    """The error rows of all documents that the index's writers left out."""
    folders = [index.table.full(f) for f in index.version.content.get("errors", [])]
    return index.spark.read.parquet(*folders) if folders else index.spark.createDataFrame(
        [], "stage string, key string, message string")


def drop_old_versions(index: StoredIndex, keep: int = 3) -> list[str]:
    """Drop all but the newest ``keep`` versions, with the folders that only those read."""
    return index.table.expire(keep)



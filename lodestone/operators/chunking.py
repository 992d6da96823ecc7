"""Overlapping chunks of documents."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T

from lodestone.operators.arrow import slices
from lodestone.settings import CHUNK_OVERLAP, CHUNK_SIZE

_FLUSH_CHARS = 1024 * 1024


def chunk_windows(text: str, size: int, overlap: int):
    """Yield ``(start, end)`` of each chunk, surrounding whitespace already excluded.

    A window ends at its last plain space when it stops short of the end of the text. A space too near the
    start to make progress is ignored, so text without spaces is cut hard instead of looping.
    """
    n = len(text)
    if n <= size:
        yield 0, n
        return
    start = 0
    while start < n:
        end = min(start + size, n)
        if start + size < n:
            space = text.rfind(" ", start, end)
            if space > start and space - overlap > start:
                end = space
        window = text[start:end]
        lead = len(window) - len(window.lstrip())
        body = len(window.strip())
        if body:
            yield start + lead, start + lead + body
        start = (end if end < n else start + size) - overlap


def kept_windows(text: str, size: int, overlap: int, drop_redundant_tail: bool = False) -> list[tuple[int, int]]:
    """``chunk_windows`` as a list, without a last chunk that lies inside the one before it if that is asked for."""
    windows = list(chunk_windows(text, size, overlap))
    if drop_redundant_tail and len(windows) > 1 and windows[-1][0] >= windows[-2][0] and windows[-1][1] <= windows[-2][1]:
        windows.pop()
    return windows


def chunk_docs(docs: DataFrame, size: int = CHUNK_SIZE, overlap: int = CHUNK_OVERLAP,
               text_col: str = "content", drop_redundant_tail: bool = False) -> DataFrame:
    """One row per chunk: the other columns of ``docs``, then ``chunk_index, content, start_char, end_char,
    src_start, src_end``.

    ``start_char``/``end_char`` are the recorded offsets (each chunk starts ``overlap`` before the recorded end
    of the one before, so they drift when whitespace was stripped); ``src_start``/``src_end`` are exact. Both
    come out of the same pass over the text, so no window over a document's chunks, and no shuffle, is needed. The rule
    leaves a last chunk that lies wholly inside its predecessor; ``drop_redundant_tail`` leaves it out.
    """
    if not 0 <= overlap < size:
        raise ValueError(f"need 0 <= overlap < size, got size={size} overlap={overlap}")
    kept = [c for c in docs.columns if c != text_col]
    added = [("chunk_index", pa.int32()), ("content", pa.string()), ("start_char", pa.int64()),
             ("end_char", pa.int64()), ("src_start", pa.int64()), ("src_end", pa.int64())]
    schema = T.StructType([docs.schema[c] for c in kept] + [
        T.StructField("chunk_index", T.IntegerType()), T.StructField("content", T.StringType()),
        T.StructField("start_char", T.LongType()), T.StructField("end_char", T.LongType()),
        T.StructField("src_start", T.LongType()), T.StructField("src_end", T.LongType())])
    names = kept + [name for name, _ in added]

    def emit(batch, rows):
        source = pa.array([r[0] for r in rows], pa.int32())
        passed = [batch.column(c).take(source) for c in kept]
        fresh = [pa.array([r[i + 1] for r in rows], kind) for i, (_, kind) in enumerate(added)]
        return pa.RecordBatch.from_arrays(passed + fresh, names=names)

    def chunk(batches):
        for batch in slices(batches):
            rows, chars = [], 0
            for i, text in enumerate(batch.column(text_col).to_pylist()):
                text, recorded = text or "", 0
                for index, (a, b) in enumerate(kept_windows(text, size, overlap, drop_redundant_tail)):
                    end = recorded + b - a
                    rows.append((i, index, text[a:b], recorded, end, a, b))
                    recorded = end - overlap
                    chars += b - a
                    if chars >= _FLUSH_CHARS:
                        yield emit(batch, rows)
                        rows, chars = [], 0
            if rows:
                yield emit(batch, rows)

    return docs.select(*kept, text_col).mapInArrow(chunk, schema)


def chunk_id(url: Column, chunk_index: Column) -> Column:
    """``url#i``; a display value, not a key: two documents may share a URL."""
    return F.concat(url, F.lit("#"), chunk_index.cast("string"))


def chunk_stats(chunks: DataFrame) -> DataFrame:
    return chunks.agg(
        F.count("*").alias("chunks"),
        F.coalesce(F.avg(F.length("content")), F.lit(0.0)).alias("avg_chars"))

"""Ranked hits -> one bounded context and one source list per question (at most k rows each)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from lodestone.functions.text import snippet
from lodestone.settings import CONTEXT_CHARS, CONTEXT_MIN_ROOM, CONTEXT_RESERVE


def fit_parts(hits: DataFrame, max_length: int = CONTEXT_CHARS) -> DataFrame:
    """Add ``part`` to ``hits`` (q_id, rank, url, content): its text in the context, null when it does not fit.

    Parts are taken whole in rank order while the running length stays within ``max_length``; the first one
    that overflows is cut to the remaining room when that is worth it; nothing follows it.
    """
    source = F.concat(F.lit("Source: "), F.col("url"), F.lit("\n"))
    head = F.length("_source")
    whole = F.concat("_source", F.lit("Content: "), "content", F.lit("\n\n"))
    running = Window.partitionBy("q_id").orderBy("rank").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    before = F.col("_total") - F.length("_whole")
    room = F.lit(max_length) - before - head - CONTEXT_RESERVE
    cut = F.concat("_source", F.lit("Content: "), F.substring(F.col("content"), F.lit(1), room.cast("int")),
                   F.lit("...\n\n"))
    return (hits.withColumn("_source", source).withColumn("_whole", whole)
            .withColumn("_total", F.sum(F.length("_whole")).over(running))
            .withColumn("part", F.when(F.col("_total") <= max_length, F.col("_whole"))
                        .when((before <= max_length) & (room > CONTEXT_MIN_ROOM), cut))
            .drop("_source", "_whole", "_total"))


def _context():
    parts = F.array_sort(F.collect_list(F.struct("rank", "part")))
    return F.array_join(F.transform(parts, lambda p: p["part"]), "").alias("context")


def _sources():
    ranked = F.array_sort(F.collect_list(F.struct(
        "rank", "url", snippet(F.col("content")).alias("snippet"), F.col("score").alias("similarity_score"))))
    return F.transform(ranked, lambda s: F.struct(
        s["url"].alias("url"), s["snippet"].alias("snippet"),
        s["similarity_score"].alias("similarity_score"))).alias("sources")


def pack_context(hits: DataFrame, max_length: int = CONTEXT_CHARS) -> DataFrame:
    """``q_id, context``; questions without hits are absent (an empty context)."""
    return fit_parts(hits, max_length).groupBy("q_id").agg(_context())


def sources(hits: DataFrame) -> DataFrame:
    """``q_id, sources``: every hit in rank order, also those that did not fit the context."""
    return hits.groupBy("q_id").agg(_sources())


def context_and_sources(hits: DataFrame, max_length: int = CONTEXT_CHARS) -> DataFrame:
    """Both in one grouping over the hits."""
    return fit_parts(hits, max_length).groupBy("q_id").agg(_context(), _sources())

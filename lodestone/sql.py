"""The library's operators as functions of SQL statements.

``register(spark)`` makes them known to a session: ``chunk_text`` as a table function for ``LATERAL`` joins, ``embed_tokens``
as a vectorised function, and columns as SQL functions that the optimizer sees through.
"""

from __future__ import annotations

from pyspark.sql import SparkSession, functions as F

from lodestone import settings
from lodestone.functions.vectors import hash_tokens
from lodestone.operators.chunking import chunk_windows

_CHUNK = "chunk_index int, chunk string, src_start bigint, src_end bigint"


def _chunk_text():
    """``chunk_text(text, size, overlap)``: a row per chunk of the text, as ``chunk_docs`` cuts it; a null text is empty.

    Texts come and chunks go in Arrow batches.
    """

    @F.udtf(returnType=_CHUNK, useArrow=True)
    class ChunkText:
        def eval(self, text: str, size: int, overlap: int):
            if not 0 <= overlap < size:
                raise ValueError(f"need 0 <= overlap < size, got size={size} overlap={overlap}")
            text = text or ""
            for index, (a, b) in enumerate(chunk_windows(text, size, overlap)):
                yield index, text[a:b], a, b

    return ChunkText


_FUNCTIONS = {
    "url_domain(url STRING) RETURNS STRING":
        r"regexp_replace(split_part(lower(regexp_extract(regexp_replace(ltrim(url), '[\\t\\r\\n]', ''), "
        r"'^(?:([A-Za-z][A-Za-z0-9+.-]*):)?(?://([^/?#]*))?', 2)), ':', 1), '^www\\.', '')",
    "snippet(text STRING) RETURNS STRING":
        f"CASE WHEN length(text) > {settings.SNIPPET_CHARS} THEN concat(substring(text, 1, {settings.SNIPPET_CHARS}), '...') ELSE text END",
    "inner_product(l ARRAY<FLOAT>, r ARRAY<FLOAT>) RETURNS DOUBLE":
        "aggregate(zip_with(l, r, (x, y) -> CAST(x AS DOUBLE) * CAST(y AS DOUBLE)), CAST(0 AS DOUBLE), (a, x) -> a + x)",
    "cosine(l ARRAY<FLOAT>, r ARRAY<FLOAT>) RETURNS DOUBLE":
        "coalesce(try_divide(aggregate(zip_with(l, r, (x, y) -> CAST(x AS DOUBLE) * CAST(y AS DOUBLE)), CAST(0 AS DOUBLE), (a, x) -> a + x),"
        " sqrt(aggregate(l, CAST(0 AS DOUBLE), (a, x) -> a + CAST(x AS DOUBLE) * CAST(x AS DOUBLE))"
        " * aggregate(r, CAST(0 AS DOUBLE), (a, x) -> a + CAST(x AS DOUBLE) * CAST(x AS DOUBLE)))), CAST(0 AS DOUBLE))",
}


def register(spark: SparkSession, dim: int = settings.EMBED_DIM) -> None:
    """Register the functions in a session, replacing earlier ones of these names."""
    spark.udtf.register("chunk_text", _chunk_text())
    spark.udf.register("embed_tokens", hash_tokens(dim))
    for head, body in _FUNCTIONS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {head} RETURN {body}")

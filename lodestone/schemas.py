"""Schemas of the tables that cross a file boundary; nothing is inferred."""

from __future__ import annotations

from pyspark.sql import types as T

DOC_FILE = T.StructType([
    T.StructField("url", T.StringType()),
    T.StructField("title", T.StringType()),
    T.StructField("content", T.StringType()),
    T.StructField("timestamp", T.DoubleType()),
    T.StructField("content_length", T.IntegerType()),
])

DOC = T.StructType([
    T.StructField("doc_key", T.StringType()),
    T.StructField("url", T.StringType()),
    T.StructField("title", T.StringType()),
    T.StructField("content", T.StringType()),
    T.StructField("ts", T.DoubleType()),
    T.StructField("content_length", T.IntegerType()),
])

ERROR = T.StructType([
    T.StructField("stage", T.StringType()),
    T.StructField("key", T.StringType()),
    T.StructField("message", T.StringType()),
])

INDEX_CONFIG = T.StructType([
    T.StructField("embedding_model", T.StringType()),
    T.StructField("chunk_size", T.IntegerType()),
    T.StructField("chunk_overlap", T.IntegerType()),
    T.StructField("embedding_dim", T.IntegerType()),
    T.StructField("total_chunks", T.LongType()),
    T.StructField("timestamp", T.DoubleType()),
])

PAGE = T.StructType([
    T.StructField("page_id", T.LongType()),
    T.StructField("url", T.StringType()),
    T.StructField("html", T.StringType()),
])

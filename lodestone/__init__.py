"""Retrieval and grounded answering over document collections, as Spark DataFrame operators."""

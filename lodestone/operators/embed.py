"""Text -> vector, with the model as a parameter."""

from typing import Iterator

import pandas as pd
from pyspark.sql import DataFrame, functions as F, types as T

from lodestone.functions.vectors import hash_tokens, l2_normalize
from lodestone.settings import EMBED_DIM


def embed(df: DataFrame, text_col: str, embed_fn=None, dim: int = EMBED_DIM,
          out_col: str = "embedding") -> DataFrame:
    """Add an embedding column.

    ``embed_fn`` takes an iterator of pandas Series of texts and yields Series of float vectors; it runs as an
    iterator pandas UDF, so a model it loads before its loop is loaded once per Python worker. Its vectors are
    brought to unit length, as the inner product of unit vectors is the score. Without one, tokens are hashed
    to ``dim`` counts (see ``hash_tokens``), to be scored with ``metric="cosine"``.
    """
    if embed_fn is None:
        return df.withColumn(out_col, hash_tokens(dim)(F.col(text_col)))
    model = F.pandas_udf(_typed(embed_fn), T.ArrayType(T.FloatType())).asNondeterministic()
    return df.withColumn(out_col, model(F.col(text_col))).withColumn(out_col, l2_normalize(F.col(out_col)))


def _typed(embed_fn):
    """``embed_fn`` with the type hints by which Spark knows an iterator UDF."""

    def run(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        yield from embed_fn(texts)

    return run

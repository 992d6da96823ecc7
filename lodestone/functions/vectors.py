"""Vector columns: normalisation, inner product, token-hash embedding."""

from __future__ import annotations

import hashlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, functions as F

from lodestone.settings import EMBED_DIM

_NO_TOKEN = r"[^\p{L}\p{N}]+"
_PIECE = 4 << 20  # bytes of texts whose tokens are counted together


def l2_normalize(col: Column) -> Column:
    """Unit vector; a zero vector stays zero."""
    wide = F.transform(col, lambda x: x.cast("double"))
    norm = F.sqrt(F.aggregate(wide, F.lit(0.0), lambda acc, x: acc + x * x))
    return F.transform(col, lambda x: F.coalesce(F.try_divide(x.cast("double"), norm), F.lit(0.0)).cast("float"))


def dot(left: Column, right: Column) -> Column:
    """Inner product in plain expressions: for few rows. Batches of vectors go through ``top_k_join``."""
    products = F.zip_with(left, right, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(products, F.lit(0.0), lambda acc, x: acc + x)


def hash_tokens(dim: int = EMBED_DIM):
    """Column function: text -> ``array<float>`` of token counts per bucket.

    Token = run of letters and digits, lower case; bucket = first 32 bits of its MD5 modulo ``dim``. The counts
    are whole numbers, so similarity is one exact division and does not depend on the order of summation.
    Declared non-deterministic so that the optimizer never evaluates it twice to move a filter below it.
    """

    @F.arrow_udf("array<float>")
    def embed(texts: pa.Array) -> pa.Array:
        counts = np.zeros(len(texts) * dim, np.float32)
        for at, piece in _pieces(texts):
            counts[at * dim:(at + len(piece)) * dim] = _token_counts(piece, dim)
        pa.default_memory_pool().release_unused()
        return pa.ListArray.from_arrays(np.arange(0, len(texts) * dim + 1, dim, dtype=np.int32), counts)

    return embed.asNondeterministic()


def _pieces(texts: pa.Array):
    """Slices of few characters, or of one text, with their places: the tables of tokens below are many times the text."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    at = 0
    while at < len(texts):
        end = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + _PIECE, "right")))
        yield at, texts.slice(at, end - at)
        at = end


def _token_counts(texts: pa.Array, dim: int) -> np.ndarray:
    words = pc.replace_substring_regex(pc.utf8_lower(texts.fill_null("")), _NO_TOKEN, " ")
    words = pc.ascii_split_whitespace(words)
    rows = pc.list_parent_indices(words).to_numpy()
    tokens = words.flatten().dictionary_encode()
    buckets = np.array([_bucket(t) % dim if t else -1 for t in tokens.dictionary.cast(pa.binary()).to_pylist()], np.int64)
    cells = buckets[tokens.indices.to_numpy()] if len(buckets) else np.zeros(0, np.int64)
    cells = (rows * dim + cells)[cells >= 0]
    return np.bincount(cells, minlength=len(texts) * dim)


@lru_cache(maxsize=1 << 17)  # the commonest; all words of a corpus would fill each worker's memory
def _bucket(token: bytes) -> int:
    return int.from_bytes(hashlib.md5(token).digest()[:4], "big")

"""SimHash near-duplicates by anchor points of a covering code.

The low 31 bits of both halves of a fingerprint are words of a space that the perfect Hamming(31, 26) code covers with
radius 1. Two fingerprints at most 3 bits apart differ in at most one bit of one half, so there the nearest anchor
(codeword) of one lies within 1 + 1 bits of the other. Every distinct fingerprint is therefore replicated to the
anchors within radius 2 of each half, at most 16 per half, and fingerprints are compared per anchor, over all 64 bits.

Copies are gathered before anything is replicated. Per anchor only a spanning forest of the links is emitted, so a large
group of near copies costs rows in proportion to its size; an anchor of more than ``BLOCK`` fingerprints is dealt out in
pairs of blocks instead of meeting in one task.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, functions as F

from lodestone.llm.columns import small_batches, unused
from lodestone.llm.graph import components
from lodestone.plans.scratch import Scratch

SHINGLE = 3
MAX_BITS = 3   # the covering argument above holds for 3 or fewer
BLOCK = 4096   # fingerprints of one anchor that one task compares with as many others
SEED = 42

_HALF = (1 << 31) - 1
_PARITY = [sum(1 << (i - 1) for i in range(1, 32) if i >> k & 1) for k in range(5)]
_CHUNK = 1 << 16


def simhash(text: str | None, shingle: int = SHINGLE) -> int:
    """The fingerprint of one text, unsigned."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    ahead = [words[i:] for i in range(shingle)] if len(words) >= shingle else [[b" ".join(words)]]
    hashes = np.fromiter((xxhash.xxh64_intdigest(b" ".join(s), SEED) for s in zip(*ahead, strict=False)), np.uint64)
    ones = np.zeros(64, np.int64)
    for at in range(0, len(hashes), _CHUNK):
        part = hashes[at:at + _CHUNK].view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view(np.uint64)[0])


def fingerprint(text: Column, shingle: int = SHINGLE) -> Column:
    """Fingerprints as signed longs of the same bits. A null or wordless text has 0."""

    @F.pandas_udf("long")
    def of(texts: pd.Series) -> pd.Series:
        return pd.Series(np.array([simhash(t, shingle) for t in texts], np.uint64).view(np.int64))

    return of(text)


def _anchors(word: Column) -> Column:
    """Codewords within radius 2 of a 31-bit word, as longs."""
    parity = [F.bit_count(word.bitwiseAND(F.lit(m))).bitwiseAND(F.lit(1)) * F.lit(1 << k) for k, m in enumerate(_PARITY)]
    syndrome = parity[0] + parity[1] + parity[2] + parity[3] + parity[4]
    bit = lambda i: F.when(i == 0, F.lit(0).cast("long")).otherwise(
        F.call_function("shiftleft", F.lit(1).cast("long"), (i - 1).cast("int")))
    rows = F.transform(F.sequence(F.lit(0), F.lit(31)), lambda i: F.struct(i.alias("i"), i.bitwiseXOR(syndrome).alias("j")))
    pairs = F.filter(rows, lambda r: (r["i"] < r["j"]) | ((r["i"] == 0) & (r["j"] == 0)))
    return F.transform(pairs, lambda r: word.bitwiseXOR(bit(r["i"])).bitwiseXOR(bit(r["j"])))


def _forest(fps: np.ndarray, bits: int) -> list[tuple[int, int]]:
    """Links that span what links of at most ``bits`` bits connect: each fingerprint is compared with those not yet
    reached, so a dense group is used up quickly."""
    links, left = [], fps
    while len(left):
        queue, left = [left[0]], left[1:]
        while queue and len(left):
            at = queue.pop()
            near = np.bitwise_count(left ^ at) <= bits
            if near.any():
                found = left[near]
                links += [(int(at), int(x)) for x in found]
                queue += list(found)
                left = left[~near]
    return links


def _links(buckets: DataFrame, bits: int) -> DataFrame:
    """Spanning links ``a, b`` of each row's list ``fps``."""

    def of(batches):
        for batch in batches:
            pairs = [pair for fps in batch.column(0)
                     for pair in _forest(np.unique(fps.values.to_numpy().view(np.uint64)), bits)]
            ends = np.array(pairs, np.uint64).reshape(-1, 2).view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(ends[:, 0]), pa.array(ends[:, 1])], ["a", "b"])

    return buckets.select("fps").mapInArrow(of, "a long, b long")


def links(fingerprints: DataFrame, bits: int = MAX_BITS, block: int = BLOCK) -> DataFrame:
    """Links ``a, b`` that connect the distinct ``fp`` of the table exactly as all links of at most ``bits`` bits do."""
    if not 0 <= bits <= MAX_BITS:
        raise ValueError("the anchors cover distances of 0 to 3 bits")
    fp = F.col("fp")
    low, high = fp.bitwiseAND(F.lit(_HALF)), F.shiftrightunsigned(fp, 32).bitwiseAND(F.lit(_HALF))
    mark = F.lit(1 << 40)
    placed = fingerprints.select("fp", F.explode(F.concat(_anchors(low), F.transform(_anchors(high), lambda x: x + mark)))
                                 .alias("anchor"))
    sizes = placed.groupBy("anchor").agg(F.count("*").alias("size"), F.min("fp").alias("a"), F.max("fp").alias("b"))
    pairs = sizes.filter((F.col("size") == 2) & (F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= bits)).select("a", "b")
    # the engine takes the anchors for as few bytes as the fingerprints they come from, and would broadcast them
    met = placed.join(sizes.filter("size > 2").select("anchor", F.ceil(F.col("size") / block).cast("int").alias("blocks")).hint("merge"),
                      "anchor")
    cold = met.filter("blocks = 1").groupBy("anchor").agg(F.collect_list("fp").alias("fps"))
    own = F.pmod(F.xxhash64("fp"), F.col("blocks")).cast("int")
    hot = (met.filter("blocks > 1").withColumn("own", own)
           .select("anchor", "fp", "own", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"))
           .select("anchor", "fp", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"))
           .repartition("anchor", "i", "j").groupBy("anchor", "i", "j").agg(F.collect_list("fp").alias("fps")))
    return pairs.unionByName(_links(cold, bits)).unionByName(_links(hot, bits)).distinct()


def groups(marked: DataFrame, key: str, scratch: Scratch, bits: int = MAX_BITS) -> DataFrame:
    """``fp, root, component_id`` for every distinct ``fp`` of a slim table ``key, fp``.

    ``component_id`` is the smallest key reachable over links of at most ``bits`` bits; nulls count as none, and a group
    of null keys alone has null.
    """
    each = scratch.write(marked.groupBy("fp").agg(F.min(key).alias("low")), "distinct")
    roots = components(links(each.select("fp"), bits), scratch)
    rooted = scratch.write(each.join(roots.hint("merge"), each["fp"] == roots["node"], "left").select(
        "fp", "low", F.coalesce("root", "fp").alias("root")), "rooted")
    return rooted.select("fp", "root").join(rooted.groupBy("root").agg(F.min("low").alias("component_id")).hint("merge"), "root")


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", shingle: int = SHINGLE,
                    bits: int = MAX_BITS) -> DataFrame:
    """``key, fp, component_id`` for every row of ``docs``; repeated rows and keys stay, each with its own result.

    Null and wordless texts have fingerprint 0 and are linked like any other; an empty table gives an empty result.
    """
    scratch = Scratch(docs.sparkSession, "simhash")
    with small_batches(docs.sparkSession):
        marked = scratch.write(docs.select(key, fingerprint(F.col(text), shingle).alias("fp")), "fingerprints")
    return marked.join(groups(marked, key, scratch, bits).hint("merge"), "fp").select(key, "fp", "component_id")


def keep_one(docs: DataFrame, key: str = "doc_id", text: str = "text", shingle: int = SHINGLE,
             bits: int = MAX_BITS) -> DataFrame:
    """``docs`` with one row of each group of near-duplicates: one with the smallest key (nulls last), whole.

    All columns are kept, whatever their names. Rows that tie for it count as copies of one another, and one of them stays.
    Null, empty and wordless texts are alike; long texts are read whole; an empty table stays empty.
    """
    scratch = Scratch(docs.sparkSession, "simhash")
    with small_batches(docs.sparkSession):
        marked = scratch.write(docs.select(F.col(key).alias("_key"), fingerprint(F.col(text), shingle).alias("_fp")), "fingerprints")
    found = groups(marked.select("_key", F.col("_fp").alias("fp")), "_key", scratch, bits).select(
        F.col("fp").alias("_fp"), F.col("root").alias("_root"), F.col("component_id").alias("_low"))
    fp, root, low = unused(docs, "_fp", "_root", "_low")
    first = marked.join(found.hint("merge"), "_fp").filter(F.col("_key").eqNullSafe(F.col("_low"))).groupBy("_root").agg(
        F.min("_fp").alias("_fp"), F.first("_low").alias("_low")).select(
        F.col("_fp").alias(fp), F.col("_root").alias(root), F.col("_low").alias(low))
    if marked.groupBy("_key").agg(F.count("*").alias("n")).filter("n > 1 or _key is null").isEmpty():
        return docs.join(scratch.write_small(first.select(F.col(low).alias(key)), "first"), key, "left_semi").select(*docs.columns)
    # rows that share a key are told apart by their fingerprints
    return (docs.withColumn(fp, fingerprint(F.col(text), shingle)).join(first, fp)
            .filter(F.col(key).eqNullSafe(F.col(low))).dropDuplicates([root]).drop(fp, root, low))

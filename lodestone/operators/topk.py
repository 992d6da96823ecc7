"""Exact top-k similarity join: every question against every vector, the best k kept per question.

The corpus is never shuffled and no score row leaves a task unless it is among the task's best k of a
question. A block of questions of proven size is broadcast as one matrix; partitions of the corpus stream
past it in Arrow batches (one matrix product each). Question tables beyond the bound are written out in hash
blocks, each again checked (and split) before it is broadcast; one pass over the vectors per block, partial
results written to the checkpoint folder.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window, functions as F, types as T

from lodestone import settings
from lodestone.operators.arrow import slices
from lodestone.plans.scratch import Scratch

_TILE = 1024           # questions scored together
_BATCH = 4096          # vectors scored together
_GATHER = 8192         # pairs re-scored together
_GROUPS = 64           # of vectors, whose best scores tell what a question gets at least
_HELD = 1 << 20        # hits that a task holds before it hands them on
_MAX_SPLITS = 24
_PRINT = np.random.default_rng(7).integers(1, 1 << 40, 1 << 16).astype(np.float64)


def _matrix(column, dim=None) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        raise ValueError("null embedding")
    lengths = np.diff(column.offsets.to_numpy())
    dim = dim or (int(lengths[0]) if len(lengths) else 0)
    if not (lengths == dim).all():
        raise ValueError(f"embedding length differs from {dim}")
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), dim)


class _Scorer:
    """Best vectors of a batch per question.

    A float32 matrix product with a proven error margin selects candidates, which are then scored exactly in
    float64 and rounded to six decimals. Ranking rounded scores makes the order independent of summation
    order, hence of batching and retries. For cosine the product is one of vectors scaled to unit length.
    """

    def __init__(self, questions, metric):
        self.cosine = metric == "cosine"
        self.q32 = questions.astype(np.float32)
        self.q64 = questions.astype(np.float64)
        self.q_sq = np.einsum("ij,ij->i", self.q64, self.q64)
        if self.cosine:
            self.q32 *= _inverse(self.q_sq)[:, None]

    def load(self, vectors):
        self.vectors = vectors
        self.v32 = vectors.astype(np.float32, copy=False)
        self.v_sq = np.einsum("ij,ij->i", vectors, vectors, dtype=np.float64, casting="safe")
        if self.cosine:
            self.v32 = self.v32 * _inverse(self.v_sq)[:, None]
        longest = np.sqrt(self.v_sq.max(initial=0.0))
        reach = 1.0 if self.cosine else np.sqrt(self.q_sq) * longest
        self.margin = np.broadcast_to(vectors.shape[1] * 2.0 ** -22 * reach + 1e-6, self.q_sq.shape)

    def _exact(self, rows, cols):
        out = np.empty(len(rows))
        for at in range(0, len(rows), _GATHER):
            r, c = rows[at:at + _GATHER], cols[at:at + _GATHER]
            out[at:at + _GATHER] = np.einsum("ij,ij->i", self.q64[r], self.vectors[c].astype(np.float64))
        if self.cosine:
            length = np.sqrt(self.q_sq[rows] * self.v_sq[cols])
            out = np.divide(out, length, out=np.zeros_like(out), where=length > 0)
        return np.copysign(np.floor(np.abs(out) * 1e6 + 0.5) / 1e6, out)

    def best(self, lo, hi, floor, ks):
        """Question numbers, vector numbers and scores of the best ``ks`` of each question that reach its ``floor``.

        Of equal scores the earlier vectors count.
        """
        k = max(int(ks[lo:hi].max(initial=1)), 1)
        rough = self.q32[lo:hi] @ self.v32.T
        margin, least = self.margin[lo:hi], floor[lo:hi] - self.margin[lo:hi]
        tops = _tops(rough, max(_GROUPS, 4 * k))
        live = np.flatnonzero(tops.max(axis=1, initial=-np.inf) >= least)
        if len(live) < len(rough):
            rough, tops, margin, least = rough[live], tops[live], margin[live], least[live]
        if tops.shape[1] > k:  # the best of k groups are k vectors
            kth = np.partition(tops, tops.shape[1] - k, axis=1)[:, tops.shape[1] - k]
            least = np.maximum(least, kth - 2 * margin)
        rows, cols = np.nonzero(rough >= least.astype(np.float32)[:, None])
        rows = live[rows] + lo
        scores = self._exact(rows, cols)
        keep = scores >= floor[rows]
        rows, cols, scores = rows[keep], cols[keep], scores[keep]
        order = np.lexsort((cols, -scores, rows))
        rows, cols, scores = rows[order], cols[order], scores[order]
        keep = _place(rows) < ks[rows]
        return rows[keep], cols[keep], scores[keep]


def _tops(scores, groups):
    """The best score of each of ``groups`` or more groups of columns, of every row."""
    while (half := scores.shape[1] // 2) >= groups:
        folded = np.maximum(scores[:, :half], scores[:, half:2 * half])
        if scores.shape[1] % 2:
            np.maximum(folded[:, 0], scores[:, -1], out=folded[:, 0])
        scores = folded
    return scores


def _first_copies(vectors, k):
    """Rows other than the later copies of a vector: of equal vectors only the first ``k`` can be among the best."""
    prints = (vectors * _PRINT[:vectors.shape[1]]).sum(axis=1)
    order = np.argsort(prints, kind="stable")
    place = _place(prints[order])
    keep = np.ones(len(vectors), bool)
    if place.max(initial=0) >= k:  # only then compare the vectors themselves
        words = np.ascontiguousarray(vectors).view(np.uint8).reshape(len(vectors), -1)
        order = np.lexsort(np.flipud(words.T))
        copies = np.cumsum(np.r_[False, (words[order[1:]] != words[order[:-1]]).any(axis=1)])
        keep[order] = _place(copies) < k
    return keep


def _inverse(squares):
    return np.divide(1.0, np.sqrt(squares), out=np.zeros_like(squares), where=squares > 0).astype(np.float32)


def _place(groups):
    """Position of each element within its run of equal values."""
    at = np.arange(len(groups))
    first = np.r_[True, groups[1:] != groups[:-1]] if len(groups) else np.zeros(0, bool)
    return at - np.maximum.accumulate(np.where(first, at, 0))


def _keep_best(table, ks, key_cols):
    """Best ``ks`` rows of each question of a small candidate table, total order (score desc, keys)."""
    table = table.sort_by([("_q", "ascending"), ("score", "descending"), *[(c, "ascending") for c in key_cols]])
    q = table.column("_q").to_numpy()
    return table.filter(pa.array(_place(q) < ks[q]))


def _score_partition(shared, key_cols, vec_col, threshold, metric):
    def run(batches):
        ids, questions, ks, *floors = shared.value
        n, dim = questions.shape
        scorer = _Scorer(questions, metric)
        floor = np.full(n, -np.inf if threshold is None else float(threshold))
        if floors:  # scores that each question is known to reach k times
            floor = np.maximum(floor, floors[0])
        best = None
        for piece in slices(batches, _BATCH):
            batch = pa.Table.from_batches([piece]).sort_by([(c, "ascending") for c in key_cols])
            matrix = _matrix(batch.column(vec_col), dim)
            keep = _first_copies(matrix, int(ks.max(initial=1)))
            scorer.load(matrix[keep])
            keys = batch.select(key_cols).filter(pa.array(keep))
            found = []
            for lo in range(0, n, _TILE):
                rows, cols, scores = scorer.best(lo, min(lo + _TILE, n), floor, ks)
                if len(rows):
                    hit = keys.take(pa.array(cols)).append_column("_q", pa.array(rows))
                    found.append(hit.append_column("score", pa.array(scores)))
            if not found:
                continue
            best = pa.concat_tables(([best] if best is not None else []) + found)
            best = _keep_best(best, ks, key_cols).combine_chunks()
            q, score = best.column("_q").to_numpy(), best.column("score").to_numpy()
            last = np.flatnonzero(np.r_[q[1:] != q[:-1], True])
            full = last[np.bincount(q, minlength=n)[q[last]] >= ks[q[last]]]
            floor[q[full]] = score[full]
            if best.num_rows > _HELD:  # their floors stay
                yield from _as_hits(best, ids, ks, key_cols)
                best = None
        if best is not None:
            yield from _as_hits(best, ids, ks, key_cols)

    return run


def _as_hits(best, ids, ks, key_cols):
    out = best.select(key_cols).add_column(0, "q_id", pc.take(ids, best.column("_q")))
    out = out.append_column("score", best.column("score")).append_column(
        "_k", pa.array(ks[best.column("_q").to_numpy()], pa.int32()))
    return out.combine_chunks().to_batches(_BATCH)


def _fits(block: pa.Table) -> bool:
    return block.num_rows <= settings.BROADCAST_QUESTIONS and block.nbytes <= settings.BROADCAST_BYTES


def _head(questions: DataFrame) -> pa.Table:
    """The questions, or one row more than may be broadcast; never an unbounded result."""
    return questions.limit(settings.BROADCAST_QUESTIONS + 1).toArrow()


def _by_block(questions, count, score, schema, scratch):
    """Score a question table too big to broadcast at once, block by block, into written tables."""
    blocks = max(2, -(-2 * count // settings.BROADCAST_QUESTIONS))
    split = questions.withColumn("block", F.pmod(F.xxhash64("q_id"), F.lit(blocks)).cast("int"))
    stored = scratch.write(split, "questions", partition_by="block")
    todo, done = [(stored.where(F.col("block") == i).drop("block"), 1) for i in range(blocks)], []
    while todo:
        block, depth = todo.pop()
        head = _head(block)
        if not _fits(head):
            if depth >= _MAX_SPLITS:
                raise ValueError("question ids are not unique: cannot split the question table into blocks")
            side = F.pmod(F.xxhash64("q_id", F.lit(depth)), F.lit(4))
            todo += [(block.where(side == i), depth + 1) for i in range(4)]
        elif head.num_rows:
            done.append(f"block-{len(done)}")
            hits, shared = score(head)
            scratch.write(hits, done[-1])
            shared.destroy()
    if not done:
        return questions.sparkSession.createDataFrame([], schema)
    return scratch.read(schema, *done)


def top_k_join(questions: DataFrame, vectors: DataFrame, k: int = settings.TOP_K,
               threshold: float | None = settings.SIMILARITY_THRESHOLD,
               keys=("doc_key", "chunk_index"), vec_col: str = "embedding",
               metric: str = "inner") -> DataFrame:
    """``questions`` (q_id unique, embedding, optional top_k) x ``vectors`` -> ``q_id, rank, keys, score``.

    ``metric="cosine"`` divides by both lengths, for vectors stored unnormalised. ``threshold`` is inclusive and
    the same before or after the cut to k, so it is applied inside the tasks. Equal scores rank by ``keys``.
    A ``top_k`` column overrides ``k`` per question, in either direction; a question with less than 1 has no hits.
    Repeated ids are refused.
    """
    return bounded_top_k(questions, vectors, k, threshold, keys, vec_col, metric)[0]


def bounded_top_k(questions: DataFrame, vectors: DataFrame, k: int = settings.TOP_K,
               threshold: float | None = settings.SIMILARITY_THRESHOLD,
               keys=("doc_key", "chunk_index"), vec_col: str = "embedding",
               metric: str = "inner"):
    """``top_k_join`` and the most rows it can hold."""
    if k < 1:
        raise ValueError("k must be at least 1")
    if metric not in ("inner", "cosine"):
        raise ValueError(f"unknown metric {metric!r}")
    keys = list(keys)
    spark = vectors.sparkSession
    schema = T.StructType([T.StructField("q_id", questions.schema["q_id"].dataType)]
                          + [T.StructField(c, vectors.schema[c].dataType) for c in keys]
                          + [T.StructField("score", T.DoubleType()), T.StructField("_k", T.IntegerType())])

    def score(block):
        shared = spark.sparkContext.broadcast(
            (block.column("q_id").combine_chunks(), _matrix(block.column("embedding")), block.column("_k").to_numpy()))
        run = _score_partition(shared, keys, vec_col, threshold, metric)
        return vectors.select(*keys, vec_col).mapInArrow(run, schema), shared

    own = F.greatest(F.coalesce("top_k", F.lit(k)), F.lit(0)) if "top_k" in questions.columns else F.lit(k)
    asked = questions.select("q_id", "embedding", own.cast("int").alias("_k"))
    head = _head(asked)
    if head.num_rows <= settings.BROADCAST_QUESTIONS:
        ks = head.column("_k").to_numpy()
        count, largest, rows = head.num_rows, int(ks.max(initial=0)), int(ks.sum())
        copies = pc.max(pc.value_counts(head.column("q_id")).field("counts")).as_py() if count else 1
    else:
        per_id = asked.groupBy("q_id").agg(F.count("*").alias("n"), F.max("_k").alias("_k"))
        count, copies, largest, rows = per_id.agg(F.sum("n"), F.max("n"), F.max("_k"), F.sum(F.col("_k").cast("long"))).first()
    if copies > 1:
        raise ValueError("question ids are not unique")
    scratch = None
    if count == 0:
        hits, most = spark.createDataFrame([], schema), 0
    elif _fits(head):
        hits, most = score(head)[0], rows
    else:
        scratch = Scratch(spark, "top-k")
        hits = _by_block(asked, count, score, schema, scratch)
    order = Window.partitionBy("q_id").orderBy(F.desc("score"), *keys)
    ranked = (hits.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= max(largest or k, 1))
              .where(F.col("rank") <= F.col("_k")).select("q_id", "rank", *keys, "score"))
    if scratch is not None:
        ranked = scratch.write(ranked, "ranked")
        most = ranked.count()
    return ranked, most


def best_score(questions: DataFrame, hits: DataFrame) -> DataFrame:
    """Highest score per question, 0 for a question without hits."""
    top = hits.groupBy("q_id").agg(F.max("score").alias("_top"))
    return questions.select("q_id").join(top, "q_id", "left").select(
        "q_id", F.coalesce("_top", F.lit(0.0)).alias("top_similarity"))

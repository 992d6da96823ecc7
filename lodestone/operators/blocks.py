"""Exact top-k search that leaves out the blocks of vectors that cannot hold a hit.

Vectors are stored by the nearest of a bounded sample of them, the pivots, and within a pivot's block by their distance to
it. A question's score with a vector exceeds that with the pivot by at most the question's length times the vector's
distance, so of each block only the rows from some distance on can reach a question's floor: a partition and row groups
that the scan skips. Floors are scores that a question is known to reach ``k`` times: first among the pivots, then in a
first pass over a few blocks near the questions. They also keep tasks from emitting hits that another task has beaten, so
the number of partial hits does not grow with the number of tasks.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window, functions as F, types as T

from lodestone import settings
from lodestone.operators.arrow import slices
from lodestone.operators.topk import _fits, _head, _matrix, _score_partition
from lodestone.plans.scratch import Scratch
from lodestone.sources.published import Published

PIVOTS = 256           # sampled vectors; the driver holds them, and a row of figures for each
FIRST_SHARE = 16       # the first pass reads about one in so many rows
_ROWS = 4096
_SLACK = 1e-5          # of lengths and scores: what rounding may take from a bound


def _unit(vectors: np.ndarray, metric: str) -> np.ndarray:
    vectors = vectors.astype(np.float64)
    if metric != "cosine":
        return vectors
    length = np.linalg.norm(vectors, axis=1, keepdims=True)
    return np.divide(vectors, length, out=np.zeros_like(vectors), where=length > 0)


class VectorBlocks:
    """A stored version of vectors in blocks: ``keys``, the vectors, and what a search knows of each block."""

    def __init__(self, table: Published, content: dict):
        self.spark, self.keys, self.metric = table.spark, content["keys"], content["metric"]
        self.path = table.full(content["blocks"])
        self.schema = T.StructType.fromJson(content["schema"])
        pivots = self.spark.read.parquet(table.full(content["pivots"])).orderBy("pivot").toArrow()  # at most PIVOTS rows
        self.pivots = _matrix(pivots.column("centre")) if pivots.num_rows else np.zeros((0, 0))
        self.rows, self.radius = pivots.column("rows").to_numpy(), pivots.column("radius").to_numpy()

    def near(self, least: dict[int, float]) -> DataFrame:
        """The vectors of the given blocks at least so far from their pivots."""
        rows = self.spark.read.schema(self.schema).parquet(self.path)
        tests = [(F.col("pivot") == p) & (F.col("distance") >= d) for p, d in sorted(least.items())]
        while len(tests) > 1:
            tests = [reduce(lambda a, b: a | b, tests[i:i + 2]) for i in range(0, len(tests), 2)]
        return rows.filter(tests[0] if tests else F.lit(False))


def write_vectors(vectors: DataFrame, path: str, keys=("doc_key", "chunk_index"), vec_col: str = "embedding", metric: str = "inner",
                  pivots: int = PIVOTS) -> VectorBlocks:
    """Publish ``vectors`` (``keys`` unique, ``vec_col``) in blocks at ``path``, for searches by ``metric``.

    The pivots are the vectors of the smallest hashed keys. Rows are range partitioned by block, distance and key, so that
    a block of very many or of equal vectors is spread over tasks and files.
    """
    spark, keys = vectors.sparkSession, list(keys)
    table, scratch = Published(spark, path), Scratch(spark, "vectors")
    stored = vectors.select(*keys, F.col(vec_col).alias("embedding"))
    sample = stored.orderBy(F.xxhash64(*keys), *keys).limit(pivots).select("embedding").toArrow()
    held = spark.sparkContext.broadcast(_unit(_matrix(sample.column(0)), metric) if sample.num_rows else np.zeros((0, 0)))
    schema = T.StructType([*[stored.schema[c] for c in keys], T.StructField("embedding", stored.schema["embedding"].dataType),
                           T.StructField("distance", T.DoubleType()), T.StructField("pivot", T.IntegerType())])

    def place(batches):
        centres = held.value
        squares = (centres ** 2).sum(axis=1)
        for batch in slices(batches, _ROWS):
            x = _unit(_matrix(batch.column(len(keys)), centres.shape[1]), metric)
            nearest = (squares - 2 * (x @ centres.T)).argmin(axis=1)
            distance = np.linalg.norm(x - centres[nearest], axis=1)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(distance), pa.array(nearest.astype(np.int32))], schema.names)

    placed = scratch.write(stored.mapInArrow(place, schema), "placed")
    order = ["pivot", "distance", *keys]
    blocks, figures = table.folder("blocks"), table.folder("pivots")
    placed.repartitionByRange(*order).sortWithinPartitions(*order).write.partitionBy("pivot").parquet(table.full(blocks))
    counted = {r["pivot"]: r for r in placed.groupBy("pivot").agg(F.count("*").alias("rows"), F.max("distance").alias("radius")).collect()}
    rows = [(i, [float(v) for v in centre], counted[i]["rows"] if i in counted else 0, counted[i]["radius"] if i in counted else 0.0)
            for i, centre in enumerate(held.value)]
    spark.createDataFrame(rows, "pivot int, centre array<double>, rows long, radius double").coalesce(1).write.parquet(table.full(figures))
    held.destroy()
    content = {"blocks": blocks, "pivots": figures, "keys": keys, "metric": metric, "schema": schema.jsonValue()}
    table.publish(content, table.newest())
    scratch.drop()
    return VectorBlocks(table, content)


def open_vectors(spark: SparkSession, path: str) -> VectorBlocks | None:
    """The newest version of the vectors at ``path``, or None."""
    table = Published(spark, path)
    version = table.newest()
    return None if version is None else VectorBlocks(table, version.content)


def _kth(scores: np.ndarray, ks: np.ndarray) -> np.ndarray:
    """For each row its k-th largest score, minus infinity where there are fewer."""
    falling = -np.sort(-scores, axis=1)
    out = np.full(len(ks), -np.inf)
    known = (ks >= 1) & (ks <= scores.shape[1])
    out[known] = falling[known, ks[known] - 1]
    return out


class _Search:
    """One set of questions that fits the driver, against stored blocks."""

    def __init__(self, blocks: VectorBlocks, asked: pa.Table, id_field: T.StructField, threshold: float | None, scratch: Scratch):
        self.blocks, self.id_field, self.threshold, self.scratch = blocks, id_field, threshold, scratch
        self.ids, self.ks = asked.column("q_id").combine_chunks(), asked.column("_k").to_numpy()
        self.raw = _matrix(asked.column("embedding"))
        self.questions = _unit(self.raw, blocks.metric)
        self.length = np.linalg.norm(self.questions, axis=1)
        known = len(self.ks) and len(blocks.rows)
        self.to_pivots = self.questions @ blocks.pivots.T if known else np.zeros((len(self.ks), len(blocks.rows)))
        self.floor = np.full(len(self.ks), -np.inf if threshold is None else float(threshold))
        reached = _kth(self.to_pivots, self.ks)  # the pivots are stored vectors themselves
        self.floor = np.maximum(self.floor, reached - _SLACK * (1 + np.abs(self.to_pivots).max(initial=0)))
        self.floor[self.ks < 1] = np.inf

    def least(self, among: np.ndarray) -> dict[int, float]:
        """For each block that may hold a hit: the distance from the pivot at which hits can begin."""
        out = {}
        with np.errstate(divide="ignore", invalid="ignore"):
            for p in among:
                room = self.floor - self.to_pivots[:, p] - _SLACK * (1 + np.abs(self.floor))
                need = np.where(self.length > 0, room / self.length, np.where(room > 0, np.inf, 0.0))
                first = float(np.nan_to_num(need, nan=0.0, neginf=0.0, posinf=np.inf).min(initial=np.inf)) - _SLACK
                if self.blocks.rows[p] and first <= self.blocks.radius[p]:
                    out[int(p)] = max(first, 0.0)
        return out

    def score(self, least: dict[int, float], name: str) -> DataFrame:
        keys = self.blocks.keys
        spark = self.blocks.spark
        schema = T.StructType([self.id_field] + [self.blocks.schema[c] for c in keys]
                              + [T.StructField("score", T.DoubleType()), T.StructField("_k", T.IntegerType())])
        shared = spark.sparkContext.broadcast((self.ids, self.raw, self.ks, self.floor))
        run = _score_partition(shared, keys, "embedding", self.threshold, self.blocks.metric)
        found = self.scratch.write(self.blocks.near(least).select(*keys, "embedding").mapInArrow(run, schema), name)
        shared.destroy()
        return found

    def run(self, name: str) -> DataFrame:
        blocks, n = self.blocks, len(self.blocks.rows)
        if not n or not len(self.ks):
            return self.score({}, name)
        # the first pass: blocks that are nearest to most questions, up to a share of all rows
        wanted = np.bincount(self.to_pivots.argmax(axis=1), minlength=n)
        order = np.lexsort((blocks.rows, -wanted))
        first = order[np.cumsum(blocks.rows[order]) <= max(blocks.rows.sum() / FIRST_SHARE, blocks.rows[order[0]])]
        hits = self.score(self.least(first), f"{name}-first")
        best = Window.partitionBy("q_id").orderBy(F.desc("score"), *blocks.keys)
        ranked = hits.withColumn("at", F.row_number().over(best)).filter(F.col("at") == F.col("_k")).select("q_id", "score").toArrow()
        place = {q: i for i, q in enumerate(self.ids.to_pylist())}
        for q, s in zip(ranked.column("q_id").to_pylist(), ranked.column("score").to_pylist(), strict=True):
            self.floor[place[q]] = max(self.floor[place[q]], s)
        rest = np.setdiff1d(np.arange(n), first)
        return hits.unionByName(self.score(self.least(rest), f"{name}-rest"))


def top_k_blocks(questions: DataFrame, blocks: VectorBlocks, k: int = settings.TOP_K,
                 threshold: float | None = settings.SIMILARITY_THRESHOLD) -> DataFrame:
    """``top_k_join`` against stored blocks: ``q_id, rank, keys, score``, the same rows.

    Question tables beyond the broadcast bounds are asked in parts by a hash of their ids.
    """
    if k < 1:
        raise ValueError("k must be at least 1")
    scratch = Scratch(blocks.spark, "blocks")
    own = F.greatest(F.coalesce("top_k", F.lit(k)), F.lit(0)) if "top_k" in questions.columns else F.lit(k)
    asked = scratch.write(questions.select("q_id", "embedding", own.cast("int").alias("_k")), "questions")
    if not asked.groupBy("q_id").agg(F.count("*").alias("n")).filter("n > 1").isEmpty():
        raise ValueError("question ids are not unique")
    todo, done = [(asked, 0)], []
    while todo:
        part, depth = todo.pop()
        head = _head(part)
        if _fits(head):
            done.append(_Search(blocks, head, asked.schema["q_id"], threshold, scratch).run(f"part-{len(done)}"))
        else:
            side = F.pmod(F.xxhash64("q_id", F.lit(depth)), F.lit(4))
            todo += [(part.where(side == i), depth + 1) for i in range(4)]
    hits = reduce(DataFrame.unionByName, done)
    order = Window.partitionBy("q_id").orderBy(F.desc("score"), *blocks.keys)
    return hits.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= F.col("_k")).select(
        "q_id", "rank", *blocks.keys, "score")

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestone.operators.blocks import _Search, open_vectors, top_k_blocks, write_vectors
from lodestone.operators.topk import top_k_join


def table(spark, vectors, name):
    rows = [(i, [float(c) for c in v]) for i, v in enumerate(vectors)]
    return spark.createDataFrame(rows, f"{name} long, embedding array<float>").repartition(3)


def clusters(seed, groups=12, each=60, dim=8, spread=0.05):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(groups, dim))
    centres /= np.linalg.norm(centres, axis=1, keepdims=True)
    return (np.repeat(centres, each, axis=0) + spread * rng.normal(size=(groups * each, dim))).round(3)


def same(got, want):
    key = lambda r: (r["q_id"], r["rank"])
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


@pytest.mark.parametrize("metric", ["inner", "cosine"])
@pytest.mark.parametrize("threshold", [None, 0.9])
@pytest.mark.parametrize("pivots", [1, 7, 40])
def test_equal_to_the_plain_search(spark, tmp_path, metric, threshold, pivots):
    vectors = np.concatenate([clusters(3), np.repeat([[0.5] * 8], 200, axis=0), np.zeros((3, 8)), 5 * clusters(4, 2, 5)])
    rng = np.random.default_rng(9)
    asked = np.concatenate([vectors[::97], rng.normal(size=(6, 8)).round(2), np.zeros((1, 8))])
    stored = table(spark, vectors, "vec_id")
    questions = table(spark, asked, "q_id").withColumn("top_k", (F.col("q_id") % 6).cast("int"))
    blocks = write_vectors(stored, str(tmp_path / "v"), ["vec_id"], metric=metric, pivots=pivots)
    same(top_k_blocks(questions, blocks, threshold=threshold),
         top_k_join(questions, stored, threshold=threshold, keys=["vec_id"], metric=metric))


def test_far_blocks_are_not_read(spark, tmp_path, monkeypatch):
    vectors = clusters(1, groups=16, each=100)
    stored = table(spark, vectors, "vec_id")
    blocks = write_vectors(stored, str(tmp_path / "v"), ["vec_id"], pivots=64)
    read = []
    whole = _Search.score
    monkeypatch.setattr(_Search, "score", lambda self, least, name: read.append(self.blocks.near(least).count()) or whole(self, least, name))
    questions = table(spark, vectors[:3], "q_id")
    found = top_k_blocks(questions, blocks, k=3, threshold=None)
    same(found, top_k_join(questions, stored, k=3, threshold=None, keys=["vec_id"]))
    assert sum(read) < len(vectors) / 4
    plan = blocks.near({3: 0.25, 5: 0.0})._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters" in plan and "GreaterThanOrEqual(distance,0.25)" in plan


def test_questions_in_parts_and_versions(spark, tmp_path, monkeypatch):
    monkeypatch.setattr("lodestone.settings.BROADCAST_QUESTIONS", 5)
    vectors = clusters(2, groups=3, each=20)
    stored, questions = table(spark, vectors, "vec_id"), table(spark, vectors[::4], "q_id")
    path = str(tmp_path / "v")
    assert open_vectors(spark, path) is None
    write_vectors(stored.limit(1), path, ["vec_id"])
    write_vectors(stored, path, ["vec_id"], pivots=4)
    same(top_k_blocks(questions, open_vectors(spark, path), k=2), top_k_join(questions, stored, k=2, keys=["vec_id"]))
    with pytest.raises(ValueError, match="not unique"):
        top_k_blocks(questions.unionByName(questions), open_vectors(spark, path))


def test_nothing_stored_and_nothing_asked(spark, tmp_path):
    stored = table(spark, clusters(2, 2, 3), "vec_id")
    none = write_vectors(stored.limit(0), str(tmp_path / "a"), ["vec_id"])
    some = write_vectors(stored, str(tmp_path / "b"), ["vec_id"])
    asked = table(spark, clusters(2, 1, 2), "q_id")
    assert top_k_blocks(asked, none).count() == 0 == top_k_blocks(asked.limit(0), some).count()

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestone import settings
from lodestone.functions.vectors import dot, hash_tokens, l2_normalize
from lodestone.operators.topk import best_score, top_k_join

VECTOR = "array<float>"


def vectors(spark, matrix, parts=4, name="doc_key"):
    rows = [(i, 0, [float(x) for x in v]) for i, v in enumerate(matrix)]
    return spark.createDataFrame(rows, f"{name} int, chunk_index int, embedding {VECTOR}").repartition(parts)


def questions(spark, matrix):
    rows = [(f"q{i}", [float(x) for x in v]) for i, v in enumerate(matrix)]
    return spark.createDataFrame(rows, f"q_id string, embedding {VECTOR}")


def brute(asked, corpus, k, threshold, cosine):
    out = set()
    for i, q in enumerate(np.float32(asked).astype(float)):
        scored = []
        for j, v in enumerate(np.float32(corpus).astype(float)):
            score = float(q @ v)
            if cosine:
                length = np.sqrt((q @ q) * (v @ v))
                score = score / length if length else 0.0
            score = float(np.copysign(np.floor(abs(score) * 1e6 + 0.5) / 1e6, score))
            if threshold is None or score >= threshold:
                scored.append((-score, j))
        out |= {(f"q{i}", rank + 1, j, -s) for rank, (s, j) in enumerate(sorted(scored)[:k])}
    return out


def found(hits):
    return {(r["q_id"], r["rank"], r["doc_key"], r["score"]) for r in hits.collect()}


@pytest.mark.parametrize("k, threshold", [(1, None), (5, None), (5, 0.3), (40, 0.1), (500, None)])
@pytest.mark.parametrize("metric", ["inner", "cosine"])
def test_equals_brute_force(spark, k, threshold, metric):
    rng = np.random.default_rng(7)
    corpus, asked = rng.normal(size=(200, 16)) / 3, rng.normal(size=(13, 16)) / 3
    hits = top_k_join(questions(spark, asked), vectors(spark, corpus), k, threshold, metric=metric)
    assert found(hits) == brute(asked, corpus, k, threshold, metric == "cosine")


def test_whole_number_vectors_with_many_ties(spark):
    rng = np.random.default_rng(8)
    corpus, asked = rng.poisson(0.4, size=(300, 6)), rng.poisson(0.6, size=(20, 6))
    hits = top_k_join(questions(spark, asked), vectors(spark, corpus), 7, 0.2, metric="cosine")
    assert found(hits) == brute(asked, corpus, 7, 0.2, True)


def test_hot_group_of_copies(spark):
    """A third of all vectors equal: the lowest keys win, from whichever partition."""
    rng = np.random.default_rng(9)
    corpus = rng.normal(size=(3000, 8))
    corpus[::3] = corpus[0]
    asked = np.vstack([corpus[0], rng.normal(size=(3, 8))])
    hits = top_k_join(questions(spark, asked), vectors(spark, corpus, 7), 5, None, metric="cosine")
    assert found(hits) == brute(asked, corpus, 5, None, True)


def test_questions_beyond_the_broadcast_bound(spark, monkeypatch):
    rng = np.random.default_rng(10)
    corpus, asked = rng.normal(size=(90, 8)), rng.normal(size=(57, 8))
    monkeypatch.setattr(settings, "BROADCAST_QUESTIONS", 10)
    hits = top_k_join(questions(spark, asked), vectors(spark, corpus), 4, 0.1)
    assert found(hits) == brute(asked, corpus, 4, 0.1, False)


def test_questions_beyond_the_byte_bound(spark, monkeypatch):
    rng = np.random.default_rng(11)
    corpus, asked = rng.normal(size=(50, 8)), rng.normal(size=(30, 8))
    monkeypatch.setattr(settings, "BROADCAST_BYTES", 600)
    hits = top_k_join(questions(spark, asked), vectors(spark, corpus), 3, None)
    assert found(hits) == brute(asked, corpus, 3, None, False)


def test_repeated_question_ids_are_refused_when_blocks_are_needed(spark, monkeypatch):
    monkeypatch.setattr(settings, "BROADCAST_QUESTIONS", 2)
    same = spark.createDataFrame([("q", [1.0, 0.0])] * 5, f"q_id string, embedding {VECTOR}")
    with pytest.raises(ValueError, match="not unique"):
        top_k_join(same, vectors(spark, np.eye(2)))


def test_top_k_column(spark):
    asked = questions(spark, np.eye(3)).withColumn("top_k", F.expr("if(q_id = 'q1', 1, null)"))
    hits = top_k_join(asked, vectors(spark, np.ones((4, 3))), 2, None).collect()
    assert sorted((r["q_id"], r["rank"]) for r in hits) == [("q0", 1), ("q0", 2), ("q1", 1), ("q2", 1), ("q2", 2)]


def test_empty_sides(spark):
    none = spark.createDataFrame([], f"q_id string, embedding {VECTOR}")
    assert top_k_join(none, vectors(spark, np.eye(3))).count() == 0
    empty = spark.createDataFrame([], f"doc_key int, chunk_index int, embedding {VECTOR}")
    hits = top_k_join(questions(spark, np.eye(3)), empty)
    assert hits.count() == 0
    assert {r["top_similarity"] for r in best_score(questions(spark, np.eye(3)), hits).collect()} == {0.0}


def test_threshold_is_inclusive(spark):
    hits = top_k_join(questions(spark, [[1.0, 0.0]]), vectors(spark, [[0.3, 0.0], [0.299, 0.0]]), 5, 0.3)
    assert [r["doc_key"] for r in hits.collect()] == [0]


def test_bad_arguments(spark):
    with pytest.raises(ValueError):
        top_k_join(questions(spark, np.eye(2)), vectors(spark, np.eye(2)), 0)
    with pytest.raises(ValueError):
        top_k_join(questions(spark, np.eye(2)), vectors(spark, np.eye(2)), metric="l2")
    with pytest.raises(Exception, match="embedding length"):
        top_k_join(questions(spark, np.eye(2)), vectors(spark, np.eye(3))).collect()


def test_plan_shuffles_only_hits(spark):
    plan = top_k_join(questions(spark, np.eye(2)), vectors(spark, np.eye(2), 2), 3, None)
    text = plan._jdf.queryExecution().executedPlan().toString()
    assert text.count("Exchange hashpartitioning(q_id") == 1 and text.count("WindowGroupLimit") == 2


def test_native_vector_functions(spark):
    frame = spark.createDataFrame([([3.0, 4.0], [1.0, 2.0]), ([0.0, 0.0], [1.0, 1.0])], f"a {VECTOR}, b {VECTOR}")
    rows = frame.select(l2_normalize(F.col("a")).alias("n"), dot(F.col("a"), F.col("b")).alias("d")).collect()
    assert rows[0]["n"] == pytest.approx([0.6, 0.8]) and rows[0]["d"] == 11.0
    assert rows[1]["n"] == [0.0, 0.0] and rows[1]["d"] == 0.0


def test_hash_tokens(spark):
    import hashlib

    frame = spark.createDataFrame([("Héllo, hello_HELLO 42!",), ("",), (None,), (" .,; ",)], "t string")
    got = [r["e"] for r in frame.coalesce(1).select(hash_tokens(16)(F.col("t")).alias("e")).collect()]
    want = [0.0] * 16
    for token in ("héllo", "hello", "hello", "42"):
        want[int(hashlib.md5(token.encode()).hexdigest()[:8], 16) % 16] += 1
    assert got == [want, [0.0] * 16, [0.0] * 16, [0.0] * 16]


def test_copies_cost_no_more_than_others():
    """Within a batch only the first k of equal vectors are scored."""
    from lodestone.operators.topk import _first_copies

    vectors = np.array([[1, 2], [3, 4], [1, 2], [1, 2], [3, 4], [1, 2]], dtype=np.float32)
    assert _first_copies(vectors, 2).tolist() == [True, True, True, False, True, False]


def test_each_question_has_its_own_k_and_ids_are_unique(spark):
    rows = [(i, [float(i % 7 + 1), float(i % 5 - 2)]) for i in range(60)]
    vectors = spark.createDataFrame(rows, "doc_key int, embedding array<float>").repartition(3)
    asked = spark.createDataFrame([(q, v, k) for (q, v), k in zip(rows, [None, 0, 1, 20, 100] * 12)],
                                  "q_id int, embedding array<float>, top_k int")
    got = top_k_join(asked, vectors, threshold=None, keys=["doc_key"]).collect()
    assert {q: sum(r["q_id"] == q for r in got) for q in range(5)} == {0: 5, 1: 0, 2: 1, 3: 20, 4: 60}
    best = sorted(rows, key=lambda v: (-round(sum(a * b for a, b in zip(v[1], rows[3][1])), 6), v[0]))[:20]
    assert [r["doc_key"] for r in sorted(got, key=lambda r: r["rank"]) if r["q_id"] == 3] == [i for i, _ in best]
    with pytest.raises(ValueError):
        top_k_join(asked.unionByName(asked.limit(1)), vectors, keys=["doc_key"])


def test_best_of_groups_of_columns():
    from lodestone.operators.topk import _tops

    scores = np.random.default_rng(3).random((5, 1037)).astype(np.float32)
    tops = _tops(scores, 64)
    assert 64 <= tops.shape[1] < 128 and (tops.max(axis=1) == scores.max(axis=1)).all()
    kth = np.sort(tops, axis=1)[:, -3]
    assert ((scores >= kth[:, None]).sum(axis=1) >= 3).all() and _tops(scores, 2000) is scores


SEARCHES = {  # what a row is to get of all rows, best first
    "vector_topk": lambda i, best: best[:5],
    "vector_topk_blocks": lambda i, best: best[:5],
    "vector_topk_threshold": lambda i, best: [h for h in best if h[1] >= 0.3][:1 + i % 5],
    "vector_topk_each": lambda i, best: best[:1 + i % 20],
    "vector_topk_edges": lambda i, best: [h for h in best if i % 2 == 0 and h[1] >= 0.25],
}


@pytest.fixture
def table_of_vectors(spark, tmp_path):
    vectors = np.random.default_rng(11).integers(-2, 3, (45, 4)) / 4  # products are exact
    rows = [(i, v.tolist()) for i, v in enumerate(vectors)]
    spark.createDataFrame(rows, f"vec_id long, embedding {VECTOR}").write.parquet(f"{tmp_path}/embeddings.parquet")
    return str(tmp_path), vectors


@pytest.mark.parametrize("name", SEARCHES)
def test_registered_searches_ask_every_row(spark, table_of_vectors, name):
    from lodestone.queries import QUERIES

    path, vectors = table_of_vectors
    scores = np.round(vectors @ vectors.T, 6)
    best = [sorted(enumerate(row.tolist()), key=lambda h: (-h[1], h[0])) for row in scores]
    want = {(i, at, *hit) for i in range(45) for at, hit in enumerate(SEARCHES[name](i, best[i]), 1)}
    got = QUERIES[name](spark, path).select("q_id", "rank", "vec_id", "score").collect()
    assert len(got) == len(want) and {tuple(r) for r in got} == want


def test_a_task_hands_on_hits_before_it_holds_too_many(monkeypatch):
    import pyarrow as pa

    from lodestone.operators import topk
    from types import SimpleNamespace

    vectors = np.random.default_rng(12).integers(-2, 3, (60, 4)) / 4
    questions, ks = vectors[:20], np.array([1_000_000, 3] * 10, np.int32)
    batch = pa.RecordBatch.from_pydict({"vec_id": list(range(60)), "embedding": pa.array(vectors.tolist(), pa.list_(pa.float64()))})
    monkeypatch.setattr(topk, "_BATCH", 10)

    def hits():
        run = topk._score_partition(SimpleNamespace(value=(pa.array(range(20)), questions, ks)), ["vec_id"], "embedding", 0.25, "inner")
        return [b.to_pylist() for b in run([batch])]

    whole = {tuple(r.values()) for rows in hits() for r in rows}
    monkeypatch.setattr(topk, "_HELD", 50)
    handed = [tuple(r.values()) for rows in hits() for r in rows]
    assert len(handed) == len(set(handed)) and whole <= set(handed)
    for q, k in enumerate(ks):  # what is handed on besides is beaten
        rows = [sorted((-s, v) for i, v, s, _ in found if i == q)[:k] for found in (whole, handed)]
        assert rows[0] == rows[1]


def test_best_scores_are_of_every_row(spark, table_of_vectors):
    from lodestone.queries import QUERIES

    path, vectors = table_of_vectors
    top = np.round(vectors[:, ::-1] @ vectors.T, 6).max(axis=1)
    got = QUERIES["vector_best_score"](spark, path).collect()
    assert sorted(map(tuple, got)) == [(i, t if t >= 0.3 else 0.0) for i, t in enumerate(top.tolist())]


def test_turns_of_every_conversation_are_asked(spark, tmp_path):
    from lodestone.queries import QUERIES

    texts = [f"The {w} of the valley tells of rain, of {w} and of the long way home." for w in ("river", "miller", "raven", "shepherd")]
    spark.createDataFrame([(i, t, "en", "web", len(t)) for i, t in enumerate(texts)],
                          "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    turns = [(c, t, role, texts[c % 4]) for c in range(45) for t, role in enumerate(("system", "user", "assistant", "user"))]
    spark.createDataFrame(turns, "conv_id long, turn long, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    got = QUERIES["retrieved_turns"](spark, str(tmp_path)).where("rank = 1").select("q_id", "doc_key").collect()
    assert {(r["q_id"], r["doc_key"]) for r in got} == {(f"{c}-{t}", c % 4) for c in range(45) for t in (1, 3)} and len(got) == 90


def test_tokens_are_counted_in_pieces_of_bounded_size(monkeypatch):
    import pyarrow as pa

    from lodestone.functions import vectors as v

    texts = pa.array(["a b", None, "ä" * 50 + " b", "", "c c c", "x " * 40])
    whole = v._token_counts(texts, 16)
    monkeypatch.setattr(v, "_PIECE", 20)
    pieces = list(v._pieces(texts))
    assert [at for at, _ in pieces] == [0, 2, 3, 5] and sum(len(p) for _, p in pieces) == 6
    assert np.concatenate([v._token_counts(p, 16) for _, p in pieces]).tolist() == whole.tolist()
    assert [at for at, _ in v._pieces(texts.slice(2, 2))] == [0, 1] and v._bucket.cache_info().maxsize <= 1 << 17

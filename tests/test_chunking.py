import random

import pytest
from hypothesis import given, settings as hypothesis_settings, strategies as st

from lodestone.operators.chunking import chunk_docs, chunk_stats, chunk_windows
from lodestone.operators.latest import latest_by_key

SAMPLE = "Chalk and slate. Marble lies under clay; granite, far below, holds both of them up."


def windows(text, size, overlap):
    return list(chunk_windows(text, size, overlap))


def test_golden_windows():
    assert windows(SAMPLE, 25, 8) == [(0, 23), (15, 34), (26, 49), (41, 60), (52, 74), (67, 83)]


@pytest.mark.parametrize("text, size, overlap, expected", [
    ("", 10, 2, [(0, 0)]),
    ("  short ", 10, 2, [(0, 8)]),
    ("abcdefghij", 10, 2, [(0, 10)]),
    ("abcdefghijk", 10, 2, [(0, 10), (8, 11)]),
    ("a" * 25, 10, 0, [(0, 10), (10, 20), (20, 25)]),
    ("a" * 19, 10, 2, [(0, 10), (8, 18), (16, 19)]),
    ("a" * 18, 10, 2, [(0, 10), (8, 18), (16, 18)]),
])
def test_edges(text, size, overlap, expected):
    assert windows(text, size, overlap) == expected


@hypothesis_settings(max_examples=300, deadline=None)
@given(st.text(alphabet="ab \né\U0001f600", max_size=400), st.integers(1, 60), st.integers(0, 59))
def test_properties(text, size, overlap):
    overlap = min(overlap, size - 1)
    spans = windows(text, size, overlap)
    assert all(b - a <= size or len(text) <= size for a, b in spans)
    if len(text) > size:
        assert all(text[a:b] == text[a:b].strip() != "" for a, b in spans)
        covered = set()
        for a, b in spans:
            covered.update(range(a, b))
        assert all(i in covered for i, c in enumerate(text) if not c.isspace())


def test_chunk_docs_offsets_and_columns(spark):
    rng = random.Random(3)
    docs = [(i, " ".join("w" * rng.randint(1, 12) for _ in range(rng.randint(1, 120))), f"t{i}") for i in range(60)]
    frame = spark.createDataFrame(docs, "doc_key int, content string, title string").repartition(3)
    rows = chunk_docs(frame, 100, 20).collect()
    texts = {k: (content, title) for k, content, title in docs}
    by_doc = {}
    for row in rows:
        content, title = texts[row["doc_key"]]
        assert row["title"] == title
        assert row["content"] == content[row["src_start"]:row["src_end"]]
        by_doc.setdefault(row["doc_key"], []).append(row)
    assert set(by_doc) == set(texts)
    for parts in by_doc.values():
        parts.sort(key=lambda r: r["chunk_index"])
        assert [r["chunk_index"] for r in parts] == list(range(len(parts)))
        start = 0
        for r in parts:
            assert (r["start_char"], r["end_char"]) == (start, start + len(r["content"]))
            start = r["end_char"] - 20
    total = chunk_stats(chunk_docs(frame, 100, 20)).first()
    assert total["chunks"] == len(rows)
    assert total["avg_chars"] == pytest.approx(sum(len(r["content"]) for r in rows) / len(rows))


def test_chunk_stats_of_nothing(spark):
    empty = spark.createDataFrame([], "doc_key int, content string")
    assert tuple(chunk_stats(chunk_docs(empty)).first()) == (0, 0.0)


def test_bad_sizes(spark):
    frame = spark.createDataFrame([(1, "x")], "doc_key int, content string")
    for size, overlap in ((10, 10), (10, -1), (0, 0)):
        with pytest.raises(ValueError):
            chunk_docs(frame, size, overlap)


def test_one_long_text_is_streamed_whole(spark):
    text = "word " * 400_000
    frame = spark.createDataFrame([(1, text)], "doc_key int, content string")
    rows = chunk_docs(frame).selectExpr("max(src_end) as last", "count(*) as n").first()
    assert rows["last"] == len(text.strip())


def test_latest_by_key_with_a_hot_key(spark):
    rows = [("hot", float(i), f"v{i}") for i in range(500)] + [("a", 1.0, "x"), ("a", 1.0, "y")]
    frame = spark.createDataFrame(rows, "doc_key string, ts double, content string").repartition(4)
    got = {r["doc_key"]: r["content"] for r in latest_by_key(frame, ties=("content",)).collect()}
    assert got == {"hot": "v499", "a": "y"}
    plan = latest_by_key(frame)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("WindowGroupLimit") == 2


def test_redundant_tails_can_be_left_out(spark):
    docs = spark.createDataFrame([(i, ("word " * n).strip()) for i, n in enumerate((1, 6, 8, 9, 20, 33, 47))] + [(90, "x" * 95)], "id int, content string")
    plain = {(r["id"], r["chunk_index"]): r for r in chunk_docs(docs, 40, 12).collect()}
    short = {(r["id"], r["chunk_index"]): r for r in chunk_docs(docs, 40, 12, drop_redundant_tail=True).collect()}
    last = {i: max(k for d, k in plain if d == i) for i, _ in plain}
    gone = set(plain) - set(short)
    assert set(short) <= set(plain) and all(short[k] == plain[k] for k in short)
    redundant = {(i, k) for i, k in last.items() if k and plain[i, k]["src_end"] <= plain[i, k - 1]["src_end"]}
    assert gone == redundant and redundant and len(redundant) < len(last)

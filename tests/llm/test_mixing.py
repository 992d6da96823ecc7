from collections import Counter, defaultdict
from fractions import Fraction

import pytest
from pyspark.sql import functions as F

from lodestone.llm.mixing import min_cost_flow, mix, quotas
from lodestone.llm.queries import QUERIES


def test_quotas_stop_at_three_times_and_share_the_rest():
    assert quotas([100, 100, 100], [5, 2, 1], 300) == [Fraction(375, 2), 75, Fraction(75, 2)]
    assert quotas([10, 100, 100], [5, 2, 1], 210) == [30, 120, 60]
    assert quotas([0, 0], [5, 2], 0) == [0, 0]


def test_flow_prefers_unread_words_over_repetition():
    flow = min_cost_flow({"a": (10, ["x"]), "ab": (10, ["x", "y"]), "b": (10, ["y"])}, {"x": 20, "y": 10})
    assert flow["a"]["x"] == 10 and flow["ab"]["x"] == 10 and flow["b"]["y"] == 10
    assert min_cost_flow({"a": (10, ["x"])}, {"x": 100}) == {"a": {"x": 30}}


def _rows(spark):
    return spark.createDataFrame(
        [(i, ["a"] if i % 3 == 0 else ["a", "b"] if i % 3 == 1 else ["b", None], 5 + i % 7, "clash") for i in range(600)],
        "doc_id long, sources array<string>, n long, copies string")


def test_overlapping_sources_come_near_their_targets(spark):
    out, plan = mix(_rows(spark), F.col("sources"), F.col("n"), ["doc_id"])
    rows = out.collect()
    assert len(rows) == 600 and max(r["copies"] for r in rows) <= 3
    took = Counter()
    for r in rows:
        assert r["copies"] == sum(s["copies"] for s in r["shares"])
        for s in r["shares"]:
            assert s["source"] in r["sources"]
            took[s["source"]] += s["copies"] * r["size"]
    for source, _, target in plan.sources:
        assert abs(took[source] - target) < 40
    again = {r["doc_id"]: r["copies"] for r in mix(_rows(spark).repartition(7), F.col("sources"), F.col("n"), ["doc_id"])[0].collect()}
    assert again == {r["doc_id"]: r["copies"] for r in rows}


def test_empty_null_and_repeated_rows(spark):
    schema = "doc_id long, sources array<string>, n long"
    assert mix(spark.createDataFrame([], schema), F.col("sources"), F.col("n"), ["doc_id"])[0].count() == 0
    rows = [(None, None, 3), (1, [], 4), (2, ["a"], None), (3, ["a"], 0), (4, ["a"], 7), (4, ["a"], 7)]
    got = mix(spark.createDataFrame(rows, schema), F.col("sources"), F.col("n"), ["doc_id"])[0].collect()
    assert len(got) == 6
    assert {r["copies"] for r in got if r["doc_id"] in (None, 1)} == {0}
    assert len({r["copies"] for r in got if r["doc_id"] == 4}) == 1


def test_too_many_patterns_are_refused(spark, monkeypatch):
    monkeypatch.setattr("lodestone.llm.mixing.MAX_PATTERNS", 2)
    with pytest.raises(ValueError):
        mix(_rows(spark), F.col("sources"), F.col("n"), ["doc_id"])


def test_query_against_brute_force(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").collect()
    got = {r["doc_id"]: r for r in QUERIES["op9_mixing"](spark, sf_dir).collect()}
    size = {d["doc_id"]: len((d["text"] or "").encode().split()) for d in docs}
    held, largest = defaultdict(int), defaultdict(int)
    for d in docs:
        held[d["source"]] += size[d["doc_id"]]
        largest[d["source"]] = max(largest[d["source"]], size[d["doc_id"]])
    names = sorted(held, key=lambda s: (s is None, s or ""))
    target = dict(zip(names, quotas([held[s] for s in names], [(5, 2, 1)[i % 3] for i in range(len(names))],
                                    sum(size.values())), strict=True))
    took = Counter()
    for d in docs:
        r = got[d["doc_id"]]
        assert (r["size"], r["source_size"], r["target"]) == (size[d["doc_id"]], held[d["source"]], float(target[d["source"]]))
        assert 0 <= r["taken"] <= 3 * r["size"]
        took[d["source"]] += r["taken"]
    for s in names:
        assert abs(took[s] - target[s]) <= largest[s]

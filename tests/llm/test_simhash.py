import random

import numpy as np
import pytest
import xxhash

from lodestone.llm import simhash as op
from lodestone.llm.graph import components
from lodestone.llm.queries import QUERIES
from lodestone.plans.scratch import Scratch


def slow_fingerprint(text):
    words = [w for w in "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").translate(
        {c: " " for c in (9, 10, 11, 12, 13)}).split(" ") if w]
    if not words:
        return 0
    shingles = [" ".join(words[i:i + 3]) for i in range(len(words) - 2)] or [" ".join(words)]
    hashes = [xxhash.xxh64(s.encode(), seed=42).intdigest() for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def slow_components(fps):
    """fingerprint -> set of reachable fingerprints, by comparing all."""
    fps, out = set(fps), {}
    while fps:
        reached, todo = set(), [fps.pop()]
        while todo:
            at = todo.pop()
            reached.add(at)
            near = {x for x in fps if (x ^ at).bit_count() <= 3}
            fps -= near
            todo += near
        out |= dict.fromkeys(reached, reached)
    return out


def test_fingerprints():
    for text in (None, "", " \n\t", "One", "One two", "A b C d e f", "École ÉCOLE über\vx", "w x y\u0085z q",
                 " ".join(str(i % 50) for i in range(3000))):
        assert op.simhash(text) == slow_fingerprint(text)


def test_every_pair_within_three_bits_shares_an_anchor(spark):
    rng = random.Random(1)
    pairs = []
    for _ in range(300):
        a = rng.getrandbits(64)
        b = a
        for bit in rng.sample(range(64), rng.randint(1, 3)):
            b ^= 1 << bit
        pairs.append((a, b))
    signed = lambda x: int(np.uint64(x).view(np.int64))
    fps = spark.createDataFrame([(signed(x),) for pair in pairs for x in pair], "fp long").distinct()
    got = {frozenset(r) for r in op.links(fps).collect()}
    assert {frozenset(map(signed, p)) for p in pairs} <= got


@pytest.mark.parametrize("block", [4096, 7])
def test_dense_groups_connect_like_all_pairs_but_stay_linear(spark, block):
    rng = random.Random(2)
    base = rng.getrandbits(64)
    fps = {base ^ sum(1 << b for b in rng.sample(range(64), rng.randint(0, 4))) for _ in range(250)}
    fps |= {rng.getrandbits(64) for _ in range(50)} | {0, 7, (1 << 64) - 1}
    signed = {int(np.uint64(x).view(np.int64)): x for x in fps}
    table = spark.createDataFrame([(x,) for x in signed], "fp long")
    links = op.links(table, block=block)
    assert all((signed[a] ^ signed[b]).bit_count() <= 3 for a, b in links.collect())
    roots = {r["node"]: r["root"] for r in components(links, Scratch(spark, "t")).collect()}
    want = slow_components(fps)
    for a, x in signed.items():
        for b, y in signed.items():
            assert (y in want[x]) == (roots.get(a, a) == roots.get(b, b))


def test_no_join_broadcasts_what_it_takes_for_small(spark, tmp_path):
    rng = random.Random(5)
    spark.createDataFrame([(rng.getrandbits(63),) for _ in range(50)], "fp long").write.parquet(f"{tmp_path}/fps")
    for df in (op.links(spark.read.parquet(f"{tmp_path}/fps")), op.near_duplicates(_docs(spark))):
        assert "Broadcast" not in df._jdf.queryExecution().executedPlan().toString()


def test_components_compute_their_edges_once(spark):
    rows = spark.sparkContext.accumulator(0)

    def counted(batches):
        for batch in batches:
            rows.add(batch.num_rows)
            yield batch

    edges = spark.createDataFrame([(i, i + 1) for i in range(40)], "a long, b long").coalesce(1).mapInArrow(counted, "a long, b long")
    assert components(edges, Scratch(spark, "t")).count() == 41 and rows.value == 40


def test_components_of_long_paths_and_nothing(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 101), (7, 7)], "a long, b long")
    roots = {r["node"]: r["root"] for r in components(edges, Scratch(spark, "t")).collect()}
    assert roots == dict.fromkeys(range(41), 0) | {100: 100, 101: 100}
    assert components(edges.limit(0), Scratch(spark, "t")).count() == 0


def _docs(spark):
    text = " ".join(f"w{i}" for i in range(200))
    rows = [(3, text, "x"), (1, text, "x"), (1, text, "x"), (None, text, "y"), (8, None, "z"), (9, "", "z"), (10, " \n", None),
            (20, "short one", "a"), (21, "other words here now", "a"), (None, "lone text without id", "a")]
    return spark.createDataFrame(rows, "doc_id long, text string, fp string")


def test_rows_nulls_ties_and_clashing_names(spark):
    got = sorted(op.near_duplicates(_docs(spark)).select("doc_id", "component_id").collect(), key=str)
    assert sorted(got, key=str) == sorted([(3, 1), (1, 1), (1, 1), (None, 1), (8, 8), (9, 8), (10, 8), (20, 20), (21, 21),
                                           (None, None)], key=str)
    kept = op.keep_one(_docs(spark))
    assert kept.columns == ["doc_id", "text", "fp"]
    assert sorted((r["doc_id"] or -1 for r in kept.collect())) == [-1, 1, 8, 20, 21]
    assert op.near_duplicates(_docs(spark).limit(0)).count() == 0 and op.keep_one(_docs(spark).limit(0)).count() == 0


def test_query_against_brute_force(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").collect()
    fps = {d["doc_id"]: slow_fingerprint(d["text"]) for d in docs}
    low = {}
    for i, fp in fps.items():
        low[fp] = min(i, low.get(fp, i))
    want = slow_components(set(fps.values()))
    got = {r["doc_id"]: r for r in QUERIES["op7_simhash"](spark, sf_dir).collect()}
    for i, fp in fps.items():
        assert got[i]["fingerprint"] == f"{fp:016x}"
        assert got[i]["component_id"] == min(low[x] for x in want[fp])

import re
from collections import Counter

from pyspark.sql import functions as F

import corpus_pipeline as pipeline
from lodestone.llm.mixing import quotas
from lodestone.llm.quality import quality
from tests.llm.test_decontam import brute as brute_hits
from tests.llm.test_simhash import slow_components, slow_fingerprint

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def _rows(df):
    assert df.columns[:5] == COLUMNS
    return {r["doc_id"]: r for r in df.collect()}


def test_stages_against_brute_force(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    names = [n for n, _ in pipeline.STAGES]
    assert names == ["quality", "near_duplicates", "decontamination", "pii", "mixing"] and pipeline.ORACLE_SQL is None
    stage = dict(pipeline.STAGES)

    good = stage["quality"](spark, docs, sf_dir).checkpoint()
    kept = _rows(good)
    want = {r["doc_id"] for r in quality(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")).filter("kept").collect()}
    assert set(kept) == want and len(want) > 0.7 * docs.count()

    single = stage["near_duplicates"](spark, good, sf_dir).checkpoint()
    fps = {i: slow_fingerprint(r["text"]) for i, r in kept.items()}
    groups = slow_components(set(fps.values()))
    low = {}
    for i, fp in fps.items():
        root = min(groups[fp])
        low[root] = min(i, low.get(root, i))
    one = _rows(single)
    assert set(one) == set(low.values())

    clean = stage["decontamination"](spark, single, sf_dir).checkpoint()
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    hit = {d for d, _, n, _ in brute_hits([(i, r["text"]) for i, r in one.items()], items) if n}
    before = _rows(clean)
    assert set(before) == set(one) - hit

    private = stage["pii"](spark, clean, sf_dir).checkpoint()
    after = _rows(private)
    secret = re.compile(r"[\w.]+@mail\d+\.example\.com|\+1 \(\d{3}\) \d{3}-\d{4}|(?<!\w)\d{16}(?!\w)|(?<!\w)[0-9a-f]{40}(?!\w)")
    assert set(after) == set(before)
    for i, r in after.items():
        found = secret.findall(before[i]["text"])
        assert not any(x in r["text"] for x in found) and r["n_chars"] == len(r["text"])
        assert re.sub(r"[\w@.+()-]+", "", r["text"]) == re.sub(r"[\w@.+()-]+", "", before[i]["text"]) or found

    mixed = _rows(stage["mixing"](spark, private, sf_dir))
    size = {i: len((r["text"] or "").encode().split()) for i, r in after.items()}
    held, took = Counter(), Counter()
    for i, r in after.items():
        held[r["source"]] += size[i]
    for i, r in mixed.items():
        assert 1 <= r["copies"] <= 3 and r["size"] == size[i] and r["text"] == after[i]["text"]
        took[r["source"]] += r["copies"] * r["size"]
    sources = sorted(held)
    for s, target in zip(sources, quotas([held[s] for s in sources], [(5, 2, 1)[k % 3] for k in range(len(sources))],
                                         sum(size.values())), strict=True):
        assert abs(took[s] - target) <= max(size[i] for i, r in after.items() if r["source"] == s)


def test_empty_table_runs_through(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").limit(0)
    for _, stage in pipeline.STAGES:
        docs = stage(spark, docs, sf_dir)
        assert docs.columns[:5] == COLUMNS
    assert docs.count() == 0


CLASHES = ["_k", "_data", "_windows", "_root", "_fp", "_low", "_pattern", "_key", "_cuts", "_class", "_sum", "_signs", "_id", "_lang",
           "_own", "_n", "_found", "_special", "_pieces", "pii", "perplexity", "word"]


def test_stages_with_nulls_repeated_rows_and_clashing_names(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    text = docs.filter("n_chars between 500 and 3000").first()
    odd = spark.createDataFrame(
        [(None, None, None, None, None), (1_000_001, None, "en", "src1", 0), (1_000_002, "", None, None, 0), (1_000_003, " \n", "en", "src1", 2),
         (None, text["text"], text["lang"], None, text["n_chars"])] + [tuple(text)] * 3, docs.schema)
    table = docs.unionByName(odd)
    for c in CLASHES:
        table = table.withColumn(c, F.lit(c))
    before = table.count()
    for name, stage in pipeline.STAGES:
        table = stage(spark, table, sf_dir).checkpoint()
        rows = table.collect()
        assert set(COLUMNS + CLASHES) <= set(table.columns) and 0 < len(rows) <= before
        assert {(c, r[c]) for r in rows for c in CLASHES} == {(c, c) for c in CLASHES}
        before = len(rows)
        if name == "quality":
            assert not any((r["text"] or "").strip() == "" for r in rows)           # texts without words are rejected
            assert sum(r["doc_id"] == text["doc_id"] for r in rows) in (0, 4)       # repeated rows are judged alike
        if name == "near_duplicates":
            assert len({r["text"] for r in rows}) == len(rows) and sum(r["text"] == text["text"] for r in rows) <= 1

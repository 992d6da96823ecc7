import hashlib
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestone.llm.queries import QUERIES
from lodestone.llm.spans import _copied, keep_bytes, phrases, remove_repeats


def brute(texts, length):
    seen = Counter(t[i:i + length] for t in texts for i in range(len(t) - length + 1))
    out = []
    for t in texts:
        hit = np.zeros(len(t), bool)
        for i in range(len(t) - length + 1):
            if seen[t[i:i + length]] > 1:
                hit[i:i + length] = True
        edges = np.flatnonzero(np.diff(np.concatenate([[0], hit.astype(int), [0]])))
        out.append((bytes(np.frombuffer(t, np.uint8)[~hit]), [tuple(map(int, e)) for e in edges.reshape(-1, 2)]))
    return out


def _texts(seed):
    rng = random.Random(seed)
    say = lambda n: "".join(rng.choice("abcdé ") for _ in range(n))
    shared = [say(n) for n in (60, 90, 150, 400)]
    texts = ["", None, "short", "x" * 300, "ab" * 200, "ab" * 90, say(500)]
    for _ in range(40):
        body = say(rng.randint(0, 300))
        for s in rng.sample(shared, rng.randint(0, 3)):
            cut = rng.randint(0, 20)
            at = rng.randint(0, len(body))
            body = body[:at] + s[cut:] + body[at:]
        texts.append(body)
    copy = list(texts[10])
    for i in range(0, len(copy), 97):
        copy[i] = "#"
    return [*texts, texts[9], texts[9], "".join(copy)]


@pytest.mark.parametrize("seed,piece,crowd", [(1, 1 << 19, 1024), (2, 128, 1024), (3, 1 << 19, 1), (4, 100, 2)])
def test_against_brute_force(spark, monkeypatch, seed, piece, crowd):
    monkeypatch.setattr("lodestone.llm.spans._PIECE", piece)
    texts = _texts(seed)
    docs = spark.createDataFrame([(i % 30, t, "clash") for i, t in enumerate(texts)], "doc_id long, text string, kept string")
    out = remove_repeats(docs, length=64, gram=24, crowd=crowd)
    assert out.columns == ["doc_id", "text", "kept", "removed"]
    got = Counter((r["text"], bytes(r["kept"]), tuple((x["begin"], x["end"]) for x in r["removed"])) for r in out.collect())
    want = Counter((t, kept, tuple(runs)) for t, (kept, runs) in zip(texts, brute([(t or "").encode() for t in texts], 64), strict=True))
    assert got == want


def test_windows_of_equal_bytes_have_equal_triggers():
    rng = np.random.default_rng(3)
    a, b, c = (rng.integers(0, 256, n, dtype=np.uint8) for n in (700, 900, 300))
    data = np.concatenate([b, a, c, a])
    found = phrases(data, np.array([1600, 2600]))
    by_window = {}
    for text, start, n, at, gram in zip(*(found[k].tolist() for k in ("text", "start", "n", "at", "gram")), strict=True):
        for s in range(start, start + n):
            by_window.setdefault(bytes(data[s:s + 400]), set()).add((start + at - s, gram))
    assert all(len(x) == 1 for x in by_window.values()) and len(by_window) == 1201 + 601 - 301
    assert len(phrases(data[:399], np.array([399]))["start"]) == 0


@pytest.mark.parametrize("common", [4, 1000])
def test_places_of_a_common_phrase_do_not_meet_in_one_task(spark, tmp_path, common):
    settings = {"spark.sql.adaptive.enabled": "false", "spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.shuffle.partitions": "4"}
    before = {k: spark.conf.get(k) for k in settings}
    copies = {(1, 7): 400, (1, 8): 4, (2, 9): 2, (2, 10): 1}
    places = [(g, p, i) for (g, p), n in copies.items() for i in range(n)]
    spark.createDataFrame(places, "gram long, phrase long, start int").repartition(8).write.parquet(str(tmp_path / "mixed"))
    mixed = spark.read.parquet(str(tmp_path / "mixed"))
    entries = spark.createDataFrame([(*k, n) for k, n in copies.items()], "gram long, phrase long, copies long")
    try:
        for k, v in settings.items():
            spark.conf.set(k, v)
        got = _copied(mixed, entries, common).withColumn("task", F.spark_partition_id()).collect()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert sorted((r["gram"], r["phrase"], r["start"]) for r in got) == sorted(x for x in places if x[:2] != (2, 10))
    tasks = {r["task"] for r in got if r["phrase"] == 7}
    assert len(tasks) > 1 if common == 4 else len(tasks) == 1


def test_kept_bytes_and_empty_table(spark):
    assert keep_bytes(b"0123456789", [(1, 2), (4, 4)], 2) == (b"06789", [(1, 6)])
    assert keep_bytes(b"01", [], 2) == (b"01", [])
    assert remove_repeats(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_query_against_brute_force(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").collect()
    want = brute([(d["text"] or "").encode() for d in docs], 400)
    got = {r["doc_id"]: r for r in QUERIES["op1_suffix_dedup"](spark, sf_dir).collect()}
    for d, (kept, runs) in zip(docs, want, strict=True):
        r = got[d["doc_id"]]
        assert (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) == (
            len((d["text"] or "").encode()), sum(b - a for a, b in runs), len(runs), hashlib.sha256(kept).hexdigest())

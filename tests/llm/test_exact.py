import glob
import hashlib
import os
import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from lodestone.llm.exact import dedup_stream, exact_duplicates, read_groups

COLUMNS = ["doc_id", "keep_id", "group_size", "kept", "text_sha256"]


def brute(rows):
    groups = defaultdict(list)
    for i, text in rows:
        groups[text or ""].append(i)
    out = []
    for text, ids in groups.items():
        ids = sorted(ids, key=lambda i: (i is not None, i or 0))
        digest = hashlib.sha256(text.encode()).hexdigest()
        out += [(i, ids[-1], len(ids), at == len(ids) - 1, digest) for at, i in enumerate(ids)]
    return sorted(out, key=_order)


def _order(row):
    return (row[0] is not None, row[0] or 0, row[4], row[3])


def _sorted(df):
    assert df.columns == COLUMNS
    return sorted(map(tuple, df.collect()), key=_order)


def _rows(seed=1):
    rng = random.Random(seed)
    rows = [(i, rng.choice(["a", "b", "A", "a ", "ä", "ä", "", None, "x" * 5000, f"own {i}"])) for i in range(300)]
    return rows + [(400 + i, "hot") for i in range(150)] + [(7, "same id"), (7, "same id"), (None, "a"), (None, None), (None, "alone")]


def _write(spark, path, rows, files):
    df = spark.createDataFrame([(i, t, "x", 1, "y") for i, t in rows], "doc_id long, text string, digest string, n int, _metadata string")
    df.repartition(files, F.rand(3)).write.parquet(path)


@pytest.mark.parametrize("files,max_files,spread,small", [(1, 1000, 2000, 100_000), (7, 1, 10, 0), (5, 2, 1, 100_000)])
def test_against_brute_force(spark, tmp_path, files, max_files, spread, small):
    _write(spark, str(tmp_path / "docs.parquet"), _rows(), files)
    out = exact_duplicates(spark, str(tmp_path / "docs.parquet"), max_files=max_files, spread=spread, small=small)
    assert _sorted(out) == brute(_rows())


@pytest.mark.parametrize("small", [0, 100_000])
def test_equal_digests_of_unlike_bytes(spark, tmp_path, small):
    _write(spark, str(tmp_path / "docs"), _rows(2), 4)
    weak = lambda text: F.unhex(F.hex(F.length(text) % 3))
    out = exact_duplicates(spark, str(tmp_path / "docs"), digest=weak, max_files=2, spread=20, small=small)
    assert _sorted(out) == brute(_rows(2))


def test_a_table_of_one_file_and_an_empty_one(spark, sf_dir, tmp_path):
    path = f"{sf_dir}/documents.parquet"
    docs = spark.read.parquet(path)
    assert _sorted(exact_duplicates(spark, path)) == brute([(r["doc_id"], r["text"]) for r in docs.collect()])
    docs.limit(0).write.parquet(str(tmp_path / "none"))
    assert _sorted(exact_duplicates(spark, str(tmp_path / "none"))) == []


def test_state_outlives_a_run(spark, tmp_path):
    def run():
        dedup_stream(spark, str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "state")).awaitTermination()
        found = read_groups(spark, str(tmp_path / "out"), spark.read.parquet(str(tmp_path / "in")).schema["doc_id"].dataType)
        return {(r["n"], r["keep"]["id"]) for r in found.collect()}

    spark.createDataFrame([(5, "a"), (1, "b")], "doc_id long, text string").coalesce(1).write.parquet(str(tmp_path / "in"))
    assert run() == {(1, 5), (1, 1)}
    spark.createDataFrame([(2, "a"), (9, "b")], "doc_id long, text string").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    assert run() == {(2, 5), (2, 9)}
    assert run() == {(2, 5), (2, 9)}
    assert "RocksDB" not in spark.conf.get("spark.sql.streaming.stateStore.providerClass", "")


def test_stores_reserve_no_disk(spark, tmp_path):
    local = os.environ.get("SPARK_LOCAL_DIRS") or spark.sparkContext.getConf().get(
        "spark.local.dir", spark._jvm.java.lang.System.getProperty("java.io.tmpdir"))
    folders = lambda: set(glob.glob(f"{local}/spark-*/StateStoreId*"))
    taken = lambda folder: sum(os.lstat(f"{d}/{f}").st_blocks * 512 for d, _, files in os.walk(folder) for f in files)
    before = folders()
    spark.createDataFrame(_rows(), "doc_id long, text string").write.parquet(str(tmp_path / "in"))
    stream = dedup_stream(spark, str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "state"), trigger={"processingTime": "1 second"})
    try:  # while it runs its stores stay
        stream.processAllAvailable()
        sizes = [taken(f) for f in folders() - before]
    finally:
        stream.stop()
    assert len(sizes) >= int(spark.conf.get("spark.sql.shuffle.partitions"))
    assert max(sizes) < 1 << 20


def test_no_batch_no_groups(spark, tmp_path):
    assert read_groups(spark, str(tmp_path / "none"), spark.range(1).schema["id"].dataType).count() == 0

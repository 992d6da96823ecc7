import json
import os

import pytest

from lodestone.plans import scratch
from lodestone.plans.index import build_index, error_counts, error_digest, index_result, index_status
from lodestone.sources.docs import (
    append_uploads, compact_docs, read_current_docs, read_doc_versions, read_docs, write_docs, write_report)
from lodestone.sources.index import read_index, write_index
from lodestone.sources.pages import as_questions, read_pages
from lodestone.sources.uploads import docs_from_page_texts, ingest_uploads, read_uploads, upload_receipts

DOC = "doc_key string, url string, title string, content string, ts double, content_length int"


@pytest.fixture
def corpus(tmp_path):
    folder = tmp_path / "crawled"
    folder.mkdir()
    files = {
        "a_1.json": {"url": "https://x/a", "title": "A", "content": "é" * 60, "timestamp": 5.5, "content_length": 60},
        "b_2.json": {"url": "https://x/b", "content": "short", "timestamp": 6.0},
        "c_3.json": {"title": "no url", "content": "c" * 60},
        "crawl_summary.json": {"crawl_timestamp": 1.0, "pages_count": 2, "urls": ["https://x/a"], "errors": []},
    }
    for name, value in files.items():
        (folder / name).write_text(json.dumps(value, indent=2, ensure_ascii=False), encoding="utf-8")
    (folder / "d_4.json").write_text("{ not json")
    (folder / "note.txt").write_text("ignored")
    return str(folder)


def test_read_docs(spark, corpus):
    docs, errors = read_docs(spark, corpus)
    rows = {r["doc_key"]: r for r in docs.collect()}
    assert set(rows) == {"a_1.json", "b_2.json"}
    assert (rows["a_1.json"]["title"], rows["a_1.json"]["ts"], rows["a_1.json"]["content_length"]) == ("A", 5.5, 60)
    assert (rows["b_2.json"]["title"], rows["b_2.json"]["content_length"]) == ("", 5)
    assert {(r["stage"], r["key"]) for r in errors.collect()} == {("load", "c_3.json"), ("load", "d_4.json")}


def test_missing_folder_is_empty(spark, tmp_path):
    docs, errors = read_docs(spark, str(tmp_path / "nowhere"))
    assert docs.count() == errors.count() == 0
    assert read_current_docs(spark, str(tmp_path / "nowhere")).count() == 0


def test_index_from_files(spark, corpus, tmp_path):
    docs, load_errors = read_docs(spark, corpus)
    chunks, errors = build_index(docs)
    all_errors = load_errors.unionByName(errors)
    assert {r["stage"]: r["errors"] for r in error_counts(all_errors).collect()} == {"load": 2, "index": 1}
    assert index_result(chunks, all_errors).first().asDict() == {"vector_count": 1, "error_count": 3}
    path = str(tmp_path / "index")
    assert read_index(spark, path) is None
    write_index(chunks, path)
    stored, config = read_index(spark, path, expect_model="token-hash-md5", expect_dim=384)
    assert stored.first()["chunk_id"] == "https://x/a#0"
    assert index_status(config).first().asDict() == {
        "vector_count": 1, "embedding_model": "token-hash-md5", "chunk_size": 800, "chunk_overlap": 100}
    with pytest.raises(ValueError, match="token-hash-md5"):
        read_index(spark, path, expect_model="other")
    with pytest.raises(ValueError, match="dimension"):
        read_index(spark, path, expect_dim=64)


def test_scoring_reads_no_text(spark, corpus, tmp_path):
    path = str(tmp_path / "index")
    write_index(build_index(read_docs(spark, corpus)[0])[0], path)
    chunks, _ = read_index(spark, path)
    plan = chunks.select("doc_key", "chunk_index", "embedding")._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<doc_key:string,chunk_index:int,embedding:array<float>>" in plan


def test_upsert_by_append(spark, tmp_path):
    path, other = str(tmp_path / "docs"), str(tmp_path / "compacted")
    first = spark.createDataFrame([("k", "u", "t", "old", 1.0, 3), ("l", "u", "t", "kept", 1.0, 4)], DOC)
    second = spark.createDataFrame([("k", "u", "t", "new", 2.0, 3), ("m", "u", "t", "more", 1.0, 4)], DOC)
    write_docs(first, path)
    write_docs(second, path, batch="b")
    write_docs(second, path, batch="b")
    assert read_doc_versions(spark, path).count() == 4
    expected = {"k": "new", "l": "kept", "m": "more"}
    assert {r["doc_key"]: r["content"] for r in read_current_docs(spark, path).collect()} == expected
    compact_docs(spark, path, other)
    assert {r["doc_key"]: r["content"] for r in read_doc_versions(spark, other).collect()} == expected


@pytest.fixture
def uploads(tmp_path):
    folder = tmp_path / "up"
    (folder / "sub").mkdir(parents=True)
    (folder / "notes.txt").write_bytes(b"  caf\xc3\xa9 \xff text\n")
    (folder / "READ.ME.MD").write_bytes("# títle".encode())
    (folder / "raw.json").write_bytes(b'{"url": "not parsed"}')
    (folder / "tool.exe").write_bytes(b"MZ")
    (folder / "empty.txt").write_bytes(" \n ".encode())
    (folder / "paper.pdf").write_bytes(b"%PDF")
    (folder / "sub" / "deep.TXT").write_bytes(b"deep")
    return str(folder)


def test_read_uploads(spark, uploads):
    meta = spark.createDataFrame([("notes.txt", "My notes", ""), ("raw.json", "", "https://src/raw"), ("zzz", "x", "y")],
                                 "filename string, title string, source_url string")
    docs, errors = read_uploads(spark, uploads, meta)
    rows = {r["filename"]: r for r in docs.collect()}
    assert {n: (r["url"], r["title"], r["content"]) for n, r in rows.items()} == {
        "notes.txt": ("uploaded://notes.txt", "My notes", "café  text"),
        "READ.ME.MD": ("uploaded://READ.ME.MD", "READ.ME", "# títle"),
        "raw.json": ("https://src/raw", "raw", '{"url": "not parsed"}'),
        "deep.TXT": ("uploaded://deep.TXT", "deep", "deep")}
    assert rows["notes.txt"]["content_length"] == 10
    assert rows["notes.txt"]["doc_key"] == f"upload_{int(rows['notes.txt']['ts'])}_notes.json"
    messages = {r["key"]: r["message"] for r in errors.collect()}
    assert set(messages) == {"tool.exe", "empty.txt", "paper.pdf"}
    assert messages["tool.exe"] == "Unsupported file type '.exe'" and "empty" in messages["empty.txt"]


def test_ingest_uploads(spark, uploads, tmp_path):
    path = str(tmp_path / "docs")
    crawled = spark.createDataFrame([("k", "u", "t", "crawled", 1.0, 7)], DOC)
    write_docs(crawled, path)
    receipts, errors = ingest_uploads(spark, uploads, path)
    assert {r["filename"] for r in receipts.collect()} == {"notes.txt", "READ.ME.MD", "raw.json", "deep.TXT"}
    assert errors.count() == 3
    assert read_current_docs(spark, path).count() == 5


def test_page_texts(spark, tmp_path):
    pages = spark.createDataFrame([("p.pdf", 2, "two"), ("p.pdf", 1, "one"), ("p.pdf", 3, None), ("q.pdf", 1, " ")],
                                  "filename string, page_no int, text string")
    docs, errors = docs_from_page_texts(pages, 7.9)
    row = docs.first()
    assert (row["content"], row["doc_key"], row["url"]) == ("one\n\ntwo", "upload_7_p.json", "uploaded://p.pdf")
    assert [r["key"] for r in errors.collect()] == ["q.pdf"]
    append_uploads(docs, str(tmp_path / "d"))
    assert upload_receipts(docs).first()["stored_as"] == "upload_7_p.json"


def test_report_and_digest(spark, tmp_path):
    errors = spark.createDataFrame([("walk", f"k{i}", f"m{i}") for i in range(8)], "stage string, key string, message string")
    digest = error_digest(errors).collect()
    assert [r["key"] for r in digest] == [f"k{i}" for i in range(5)] and {r["more"] for r in digest} == {3}
    assert {r["more"] for r in error_digest(errors, 20).collect()} == {0}
    summary = spark.createDataFrame([("s", 2, ["a", "b"])], "site string, page_count int, urls array<string>")
    write_report(summary, errors, str(tmp_path / "r"))
    assert spark.read.json(str(tmp_path / "r" / "summary")).first()["urls"] == ["a", "b"]
    assert spark.read.json(str(tmp_path / "r" / "errors")).count() == 8


def test_pages_and_questions(spark, sf_dir):
    assert read_pages(spark, f"{sf_dir}/pages.parquet").count() == 50
    asked = as_questions(spark.read.parquet(f"{sf_dir}/benchmark.parquet"), "item_id", "text", 3).first()
    assert asked["top_k"] == 3 and asked["question"]


def test_scratch_uses_the_named_folder(spark):
    root = spark.conf.get("spark.checkpoint.dir")
    assert scratch.checkpoint_root(spark) == root
    folder = scratch.Scratch(spark, "x")
    assert folder.path.startswith(root)
    stored = folder.write(spark.range(5), "five")
    assert all(root in f for f in stored.inputFiles()) and stored.count() == 5


def test_scratch_is_broadcast_only_when_small(spark):
    folder = scratch.Scratch(spark, "x")
    small = spark.range(3).join(folder.write_small(spark.range(3), "a", 5), "id")
    assert "BroadcastHashJoin" in small._jdf.queryExecution().executedPlan().toString()
    assert folder.write_small(spark.range(9), "b", 5)._jdf.queryExecution().logical().toString().find("hint") < 0


def test_scratch_folder_goes_with_its_block(spark):
    from lodestone.plans.scratch import Scratch
    with Scratch(spark, "gone") as scratch:
        assert scratch.write(spark.range(3), "t").count() == 3 and os.path.exists(scratch.path.removeprefix("file:"))
    assert not os.path.exists(scratch.path.removeprefix("file:"))


def test_refused_uploads_are_not_read(spark, tmp_path):
    (tmp_path / "in" / "deep").mkdir(parents=True)
    for name, text in (("a.txt", "alpha"), ("deep/b.MD", "beta"), ("big.txt", "x" * 500), ("c.exe", "code"), ("d.pdf", "%PDF"), ("txt", "none"),
                       ("e.json", " ")):
        (tmp_path / "in" / name).write_text(text)
    docs, errors = read_uploads(spark, str(tmp_path / "in"), max_bytes=100)
    assert {r["content"] for r in docs.collect()} == {"alpha", "beta"}
    assert {r["key"]: r["message"] for r in errors.collect()} == {
        "big.txt": "File is larger than 100 bytes", "c.exe": "Unsupported file type '.exe'", "d.pdf": "PDF text must be given as page texts",
        "txt": "Unsupported file type ''", "e.json": "Uploaded file is empty or could not extract text."}
    plan = docs._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull(length), LessThanOrEqual(length,100)" in plan
    assert plan.count("content:binary") <= 1


def test_rules_too_many_to_broadcast(spark):
    from lodestone.operators.robots import apply_rules, robots_filter, rule_tables

    rules = spark.createDataFrame([("big.com", i, f"/{i % 7}/{i}", i % 2 == 0) for i in range(60)] + [("big.com", 99, "/", False), ("b.org", 0, "/x", False)],
                                  "domain string, seq int, path_prefix string, allow boolean")
    urls = spark.createDataFrame([(f"https://big.com/{i % 7}/{i % 70}",) for i in range(400)] + [("https://b.org/y",), ("https://c.net/",)], "url string")
    want = sorted(map(tuple, robots_filter(urls, rules).collect()))
    tables = rule_tables(rules, most=0)
    got = apply_rules(urls, *tables)
    assert sorted(map(tuple, got.collect())) == want and {r[1] for r in want} == {True, False}
    assert "_part" in got._jdf.queryExecution().optimizedPlan().toString()


def test_many_small_files_make_few_tasks(spark, tmp_path):
    from lodestone.sources.pages import TASKS_PER_CORE

    for name, text in ((f"{i}.{kind}", text) for i in range(1500) for kind, text in (("txt", f"alpha {i}"), ("json", '{"url": "u"}'))):
        (tmp_path / name).write_text(text)
    most = TASKS_PER_CORE * spark.sparkContext.defaultParallelism
    uploads, _ = read_uploads(spark, str(tmp_path))
    docs, _ = read_docs(spark, str(tmp_path))
    assert uploads.rdd.getNumPartitions() <= most and docs.rdd.getNumPartitions() <= most
    assert uploads.count() == 3000 and docs.count() == 1500


def test_docs_of_uploads_take_one_scan(spark, uploads):
    docs, _ = read_uploads(spark, uploads)
    assert docs._jdf.queryExecution().executedPlan().toString().count("FileScan binaryFile") == 1


def test_bad_bytes_of_uploads_are_dropped(spark, tmp_path):
    (tmp_path / "a.txt").write_bytes(b"caf\xc3\xa9 \xff\xc0\x80 ok\xed\xa0\x80")
    (tmp_path / "b.txt").write_bytes("ä😀".encode())
    docs, _ = read_uploads(spark, str(tmp_path))
    assert {r["content"] for r in docs.collect()} == {b"caf\xc3\xa9 \xff\xc0\x80 ok\xed\xa0\x80".decode("utf-8", "ignore").strip(), "ä😀"}


def test_one_file_each_row(spark, tmp_path):
    from lodestone.queries import _one_file_each

    rows = spark.createDataFrame([("ä",), (None,), ("b\nc",), ("ä",)], "value string").coalesce(1)
    _one_file_each(rows, f"file://{tmp_path}/in", "text")
    names = os.listdir(tmp_path / "in")
    assert sorted((tmp_path / "in" / n).read_text() for n in names) == ["\n", "b\nc\n", "ä\n", "ä\n"]
    assert len({n.split("-")[1] for n in names}) > 1 and all(n.startswith("part-") and n.endswith(".txt") for n in names)
    _one_file_each(rows, f"{tmp_path}/tables", "csv")
    sizes = sorted(os.path.getsize(tmp_path / "tables" / n) for n in os.listdir(tmp_path / "tables"))
    assert len(sizes) == 4 and sizes[0] == 0 < sizes[1]


def test_uploads_are_decoded_once_above_the_few_tasks(spark, tmp_path):
    for i in range(3):
        (tmp_path / f"{i}.txt").write_bytes([b"fine", b"bad \xff byte", b" \n"][i])
    docs, errors = read_uploads(spark, str(tmp_path))
    assert {r["content"] for r in docs.collect()} == {"fine", "bad  byte"} and errors.count() == 1
    for df in (docs, errors):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert plan.count("ArrowEvalPython") == 1 and plan.index("ArrowEvalPython") < plan.index("Coalesce")

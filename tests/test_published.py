import pytest
from pyspark.sql import functions as F

from lodestone.plans import upkeep
from lodestone.plans.ask import ask_batch, retrieve
from lodestone.plans.index import build_index, by_key
from lodestone.plans.upkeep import (
    build_published, drop_old_versions, merge_segments, published_errors, update_published, upsert_published)
from lodestone.schemas import DOC
from lodestone.sources.index import StoredIndex, open_index, read_index, sorted_segment, write_index
from lodestone.sources.published import Published, VersionConflict
from lodestone.streaming.published import ask_published, index_stream


def words(word, n=200):
    return " ".join(f"{word}{i}" for i in range(n))


def docs(spark, *rows):
    return spark.createDataFrame([(k, f"u/{k}", "t", text, ts, len(text)) for k, text, ts in rows], DOC)


def shown(index):
    """Key and first word's stem of every current chunk."""
    return {(r["doc_key"], r["content"].split()[1].rstrip("0123456789")) for r in index.chunks.collect()}


def rows_of(index):
    return sorted(map(tuple, index.chunks.select("doc_key", "chunk_index", "content", "url", "chunk_id").collect()))


# --- versions ----------------------------------------------------------------

def test_versions_follow_each_other(spark, tmp_path):
    table = Published(spark, str(tmp_path / "t"))
    assert table.newest() is None and table.numbers() == []
    first = table.publish({"a": 1}, None)
    second = table.publish({"a": 2}, first)
    assert [first.number, second.number] == [1, 2] and table.newest().content == {"a": 2}
    with pytest.raises(VersionConflict):
        table.publish({"a": 3}, first)
    assert table.newest().content == {"a": 2} and table.read(1).content == {"a": 1} and table.read(9) is None


def test_a_manifest_cut_short_is_no_version(spark, tmp_path):
    table = Published(spark, str(tmp_path / "t"))
    first = table.publish({"a": 1}, None)
    (tmp_path / "t" / "manifests" / "v-000000000002.json").write_text('{"a": ')
    assert table.newest() == first
    assert table.publish({"a": 3}, first).number == 3 and table.newest().content == {"a": 3}


def test_expired_versions_take_only_their_own_folders(spark, tmp_path):
    table = Published(spark, str(tmp_path / "t"))
    version, folders = None, [table.folder("x") for _ in range(4)]
    stray = table.folder("writer")
    for f in [*folders, stray]:
        spark.range(1).write.parquet(table.full(f))
    for i in range(4):
        version = table.publish({"parts": [{"here": folders[0]}, folders[i]]}, version)
    assert table.expire(keep=2) == [folders[1]] and table.numbers() == [3, 4]
    left = {p.name for p in (tmp_path / "t" / "data").iterdir()}
    assert left == {f.split("/")[1] for f in (folders[0], *folders[2:], stray)}


# --- index versions -----------------------------------------------------------

def test_a_failing_writer_changes_nothing(spark, tmp_path):
    path = str(tmp_path / "index")
    chunks = build_index(docs(spark, ("a", words("alpha"), 1.0)).drop("ts", "content_length"))[0]
    write_index(chunks, path)
    broken = chunks.withColumn("content", F.raise_error(F.lit("stopped")).cast("string"))
    with pytest.raises(Exception, match="stopped"):
        write_index(broken, path)
    sorted_segment(Published(spark, path), chunks, 0)          # a writer that never came to publish
    assert shown(open_index(spark, path)) == {("a", "alpha")} and open_index(spark, path).number == 1


def test_readers_keep_their_version(spark, tmp_path):
    path = str(tmp_path / "index")
    build_published(docs(spark, ("a", words("old"), 1.0)), path)
    reader = open_index(spark, path)
    before = reader.chunks
    build_published(docs(spark, ("a", words("new"), 1.0)), path)
    assert shown(reader) == {("a", "old")} and before.count() == reader.chunks.count()
    assert shown(open_index(spark, path)) == {("a", "new")}
    assert read_index(spark, path)[1].first()["total_chunks"] == open_index(spark, path).chunks.count()
    assert open_index(spark, str(tmp_path / "none")) is None


# --- lookup of hits --------------------------------------------------------------

@pytest.fixture
def small_files(spark):
    keys = {"spark.sql.adaptive.advisoryPartitionSizeInBytes": "16k", "spark.sql.adaptive.coalescePartitions.minPartitionSize": "1k",
            "spark.sql.shuffle.partitions": "16"}
    before = {k: spark.conf.get(k) for k in keys}
    for k, v in keys.items():
        spark.conf.set(k, v)
    yield
    for k, v in before.items():
        spark.conf.set(k, v)


def _corpus(spark, n=120):
    return spark.createDataFrame([(f"k{i:03d}", f"u/{i}", "t", words(f"w{i}x", 150)) for i in range(n)],
                                 "doc_key string, url string, title string, content string")


def test_texts_are_read_from_the_files_that_hold_hits(spark, tmp_path, small_files):
    index = write_index(build_index(_corpus(spark))[0], str(tmp_path / "index"))
    assert index.segments[0]["file_count"] >= 8
    asked = spark.createDataFrame([(1, words("w7x", 40)), (2, words("w99x", 40))], "q_id int, question string")
    hits = retrieve(asked, index, k=1)
    plan = hits._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [Or(EqualTo(doc_key,k007),EqualTo(doc_key,k099))" in plan.replace("doc_key, ", "doc_key,").replace("), ", "),")
    rows = {r["q_id"]: r for r in hits.collect()}
    assert rows[1]["doc_key"] == "k007" and rows[2]["doc_key"] == "k099" and rows[1]["content"].startswith("w7x0 ")
    files = index.files_for(index.segments[0], ["k007", "k099"])
    read = spark.read.parquet(*files)
    assert 2 <= len(files) <= 4 and read.count() < index.chunks.count() / 2   # a document may lie across two files
    assert index.files_for(index.segments[0], ["a", "zz"]) == []


@pytest.mark.parametrize("bounds", [{}, {"EXACT_KEYS": 1}, {"LOOKUP_FILES": 0}, {"LOOKUP_KEYS": 1}])
def test_lookup_is_the_same_within_all_bounds(spark, tmp_path, small_files, monkeypatch, bounds):
    for name, value in bounds.items():
        monkeypatch.setattr(f"lodestone.sources.index.{name}", value)
    chunks = build_index(_corpus(spark, 40))[0]
    index = write_index(chunks, str(tmp_path / "index"))
    asked = spark.createDataFrame([(i, words(f"w{i}x", 30)) for i in (3, 5, 30)] + [(9, "nothing at all")], "q_id int, question string")
    plain = sorted(map(tuple, retrieve(asked, spark.createDataFrame(chunks.collect(), chunks.schema)).collect()))
    assert sorted(map(tuple, retrieve(asked, index).collect())) == plain and len(plain) >= 3


def test_no_hits_read_no_texts(spark, tmp_path):
    index = write_index(build_index(_corpus(spark, 5))[0], str(tmp_path / "index"))
    asked = spark.createDataFrame([(1, "zzz")], "q_id int, question string")
    assert retrieve(asked, index).count() == 0
    assert ask_batch(asked, index).first()["is_refusal"]


# --- incremental updates --------------------------------------------------------

def test_update_equals_a_full_build(spark, tmp_path, monkeypatch):
    before = docs(spark, ("same", words("same"), 1.0), ("changed", words("old"), 1.0), ("gone", words("gone"), 1.0), ("short", "x", 1.0),
                  ("grows", "tiny", 1.0), ("shrinks", words("big"), 1.0))
    after = docs(spark, ("same", words("same"), 1.0), ("changed", words("new"), 0.5), ("short", "x", 1.0), ("added", words("added"), 1.0),
                 ("grows", words("grown"), 1.0), ("shrinks", "", 1.0))
    path = str(tmp_path / "a")
    build_published(before, path)
    embedded = []
    whole = upkeep._chunked
    monkeypatch.setattr(upkeep, "_chunked", lambda d, w: embedded.append({r["doc_key"] for r in d.collect()}) or whole(d, w))
    index = update_published(after, path)
    assert embedded == [{"changed", "added", "grows", "shrinks"}]
    assert rows_of(index) == rows_of(build_published(after, str(tmp_path / "b"))) == rows_of(merge_segments(index, whole=True))
    assert update_published(after, path).number == open_index(spark, path).number       # no change, no version
    assert {r["doc_key"] for r in index.docs.collect()} == {"same", "changed", "short", "added", "grows", "shrinks"}
    back = update_published(before, path)
    assert rows_of(back) == rows_of(build_published(before, str(tmp_path / "c")))


def test_other_settings_mean_a_full_build(spark, tmp_path):
    path, rows = str(tmp_path / "a"), docs(spark, ("a", words("a"), 1.0))
    build_published(rows, path)
    index = update_published(rows, path, size=300, overlap=20)
    assert len(index.segments) == 1 and index.settings["chunk_size"] == 300
    with pytest.raises(ValueError, match="other settings"):
        upsert_published(rows, path)


def test_update_of_an_index_without_document_rows(spark, tmp_path):
    path, rows = str(tmp_path / "a"), docs(spark, ("a", words("a"), 1.0))
    write_index(build_index(rows.drop("ts", "content_length"))[0], path)
    assert shown(update_published(rows, path)) == {("a", "a")}


# --- arrivals and merges ----------------------------------------------------------

def test_newest_time_wins_then_the_last_to_come(spark, tmp_path):
    path = str(tmp_path / "i")
    upsert_published(docs(spark, ("a", words("one"), 5.0), ("b", words("one"), 1.0), ("c", words("one"), 1.0), ("b", words("two"), 1.0)), path)
    upsert_published(docs(spark, ("a", words("late"), 1.0), ("b", words("three"), 1.0), ("c", "short now", 2.0)), path)
    index = upsert_published(docs(spark, ("d", words("new"), 1.0)), path)
    want = {("a", "one"), ("b", "three"), ("d", "new")}
    assert shown(index) == want
    assert shown(merge_segments(index, whole=False)) == want
    assert shown(merge_segments(open_index(spark, path), whole=True)) == want
    assert len(open_index(spark, path).segments) == 1
    assert {r["key"] for r in published_errors(open_index(spark, path)).collect()} == {"u/c"}
    assert shown(upsert_published(docs(spark, ("c", words("again"), 2.0)), path)) == want | {("c", "again")}


def test_many_segments_are_merged(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(upkeep, "MAX_SEGMENTS", 2)
    path = str(tmp_path / "i")
    build_published(docs(spark, *[(f"base{i}", words(f"base{i}x"), 1.0) for i in range(30)]), path)
    for i in range(7):
        index = upsert_published(docs(spark, ("hot", words(f"v{'abcdefg'[i]}"), float(i))), path)
        assert len(index.segments) <= 3
    assert ("hot", "vg") in shown(index) and len(shown(index)) == 31
    assert drop_old_versions(index, keep=1) and len(shown(open_index(spark, path))) == 31


def test_a_deletion_outlives_a_partial_merge(spark, tmp_path):
    path = str(tmp_path / "i")
    build_published(docs(spark, ("a", words("a"), 1.0), ("b", words("b"), 1.0)), path)
    update_published(docs(spark, ("b", words("b"), 1.0)), path)
    index = update_published(docs(spark, ("b", words("b"), 1.0), ("c", words("c"), 1.0)), path)
    assert shown(merge_segments(index, whole=False)) == {("b", "b"), ("c", "c")}


def test_stream_progress_lies_in_the_manifest(spark, tmp_path):
    path, arrivals = str(tmp_path / "index"), tmp_path / "in"
    docs(spark, ("a", words("one"), 1.0)).coalesce(1).write.parquet(str(arrivals / "1"))

    def run():
        stream = spark.readStream.schema(DOC).option("recursiveFileLookup", True).option("maxFilesPerTrigger", 1).parquet(str(arrivals))
        index_stream(stream, path, str(tmp_path / "checkpoint")).awaitTermination()
        return open_index(spark, path)

    first = run()
    docs(spark, ("a", words("two"), 1.0)).coalesce(1).write.parquet(str(arrivals / "2"))
    docs(spark, ("b", words("b"), 1.0)).coalesce(1).write.parquet(str(arrivals / "3"))
    second = run()
    assert (first.number, second.number) == (1, 3) and shown(second) == {("a", "two"), ("b", "b")}
    assert list(second.version.content["applied"].values()) == [2]
    for name in ("2", ".2.crc"):
        (tmp_path / "checkpoint" / "commits" / name).unlink()       # as if the run had died after publishing: the batch is replayed
    assert run().number == 3


def test_answers_tell_their_index(spark, tmp_path):
    path, asked = str(tmp_path / "index"), str(tmp_path / "questions")

    def ask(at, text):
        spark.createDataFrame([(at, text)], "q_id int, question string").write.mode("append").parquet(asked)
        stream = spark.readStream.schema("q_id int, question string").parquet(asked)
        ask_published(stream, path, str(tmp_path / "answers"), str(tmp_path / "checkpoint")).awaitTermination()

    with pytest.raises(Exception, match="no index"):
        ask(0, "too early")
    upsert_published(docs(spark, ("a", words("alpha"), 1.0)), path)
    ask(1, words("beta", 30))
    upsert_published(docs(spark, ("b", words("beta"), 1.0)), path)
    ask(2, words("beta", 30))
    rows = {r["q_id"]: r for r in spark.read.parquet(str(tmp_path / "answers")).collect()}
    assert rows[1]["index_version"] == 1 and rows[1]["is_refusal"]
    assert rows[2]["index_version"] == 2 and rows[2]["sources"][0]["url"] == "u/b"


def test_a_stored_index_is_what_ask_takes(spark, tmp_path):
    index = write_index(build_index(_corpus(spark, 5))[0], str(tmp_path / "i"))
    assert isinstance(index, StoredIndex)
    asked = spark.createDataFrame([(1, words("w3x", 30))], "q_id int, question string")
    assert ask_batch(asked, index).first()["sources"][0]["url"] == "u/3"


def test_chunks_of_dealt_documents_are_written_once(spark, tmp_path):
    """Documents are sorted before they get vectors, so that no chunk is written or shuffled with them; a null key too."""
    rows = _corpus(spark, 40).select("doc_key", "url", "title", "content")
    rows = rows.unionByName(rows.limit(1).withColumn("doc_key", F.lit(None).cast("string")))
    chunks, _ = build_index(by_key(rows), 60, 10)
    index = write_index(chunks, str(tmp_path / "index"), ordered=True)
    assert "Exchange" not in chunks._jdf.queryExecution().executedPlan().toString().split("MapInArrow")[0]
    listed = spark.read.parquet(index.table.full(index.segments[0]["files"])).filter("first is not null").orderBy("first").collect()
    assert len(listed) > 1 and all(a["last"] < b["first"] for a, b in zip(listed, listed[1:]))
    whole = write_index(build_index(rows, 60, 10)[0], str(tmp_path / "other"))
    key = lambda i: sorted((str(r["doc_key"]), r["chunk_index"], r["content"], str(r["embedding"])) for r in i.chunks.collect())
    assert key(index) == key(whole)
    assert not any(n.startswith("raw") for n in index.table._names("data"))

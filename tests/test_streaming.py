from lodestone.schemas import DOC
from lodestone.sources.docs import append_uploads
from lodestone.streaming.ask import ask_stream
from lodestone.streaming.ingest import append_ingested_uploads, doc_stream, ingest_batch, ingest_stream, read_ingested


def docs(spark, *rows):
    return spark.createDataFrame([(k, f"u/{k}", "t", text, ts, len(text)) for k, text, ts in rows], DOC)


def words(word, n=200):
    return " ".join(f"{word}{i}" for i in range(n))


def run(spark, tmp_path):
    stream = doc_stream(spark, str(tmp_path / "in"))
    query = ingest_stream(stream, str(tmp_path / "out"), str(tmp_path / "checkpoint"))
    query.awaitTermination()


def test_newest_version_wins_across_batches(spark, tmp_path):
    docs(spark, ("a", words("old"), 1.0), ("b", words("b"), 1.0), ("c", words("c"), 1.0),
         ("a", words("older"), 0.5)).write.parquet(str(tmp_path / "in" / "one"))
    run(spark, tmp_path)
    first = read_ingested(spark, str(tmp_path / "out"))
    assert {r["doc_key"] for r in first.collect()} == {"a", "b", "c"}
    assert not first.where("content like '%older%'").count()

    docs(spark, ("a", words("new"), 2.0), ("c", "too short now", 3.0), ("b", words("late"), 0.1)).write.parquet(
        str(tmp_path / "in" / "two"))
    run(spark, tmp_path)
    rows = read_ingested(spark, str(tmp_path / "out")).collect()
    assert {r["doc_key"] for r in rows} == {"a", "b"}
    assert all(r["content"].lstrip("0123456789 ").startswith("new") for r in rows if r["doc_key"] == "a")
    assert not any("late" in r["content"] for r in rows)
    errors = spark.read.parquet(str(tmp_path / "out" / "errors")).collect()
    assert [r["key"] for r in errors] == ["u/c"]


def test_nothing_new_changes_nothing(spark, tmp_path):
    docs(spark, ("a", words("a"), 1.0)).write.parquet(str(tmp_path / "in" / "one"))
    run(spark, tmp_path)
    before = read_ingested(spark, str(tmp_path / "out")).count()
    run(spark, tmp_path)
    assert read_ingested(spark, str(tmp_path / "out")).count() == before > 0


def test_same_version_again_is_not_doubled(spark, tmp_path):
    docs(spark, ("a", words("a"), 1.0)).write.parquet(str(tmp_path / "in" / "one"))
    run(spark, tmp_path)
    before = read_ingested(spark, str(tmp_path / "out")).count()
    docs(spark, ("a", words("a"), 1.0)).write.parquet(str(tmp_path / "in" / "two"))
    run(spark, tmp_path)
    assert read_ingested(spark, str(tmp_path / "out")).count() == before


def test_batches_by_number_beside_uploads(spark, tmp_path):
    out = str(tmp_path / "out")
    ingest_batch(docs(spark, ("a", words("nine"), 1.0)), out, "9")
    ingest_batch(docs(spark, ("a", words("ten"), 1.0)), out, "10")
    append_ingested_uploads(docs(spark, ("up", words("first"), 1.0)), out)
    append_uploads(docs(spark, ("a", words("upload"), 0.5)), f"{out}/docs")
    append_ingested_uploads(docs(spark, ("up", words("second"), 2.0)), out)
    shown = {(r["doc_key"], r["content"].split()[1].rstrip("0123456789")) for r in read_ingested(spark, out).collect()}
    assert shown == {("a", "ten"), ("up", "second")}


def test_questions_as_a_stream(spark, tmp_path):
    docs(spark, ("a", words("alpha"), 1.0), ("b", words("beta"), 1.0)).write.parquet(str(tmp_path / "in" / "one"))
    run(spark, tmp_path)
    index = read_ingested(spark, str(tmp_path / "out"))
    asked = spark.createDataFrame([(1, words("alpha", 30)), (2, "unknown")], "q_id int, question string")
    asked.write.parquet(str(tmp_path / "questions"))
    stream = spark.readStream.schema(asked.schema).parquet(str(tmp_path / "questions"))
    ask_stream(stream, index, str(tmp_path / "answers"), str(tmp_path / "checkpoint-q")).awaitTermination()
    rows = {r["q_id"]: r for r in spark.read.parquet(str(tmp_path / "answers")).collect()}
    assert rows[1]["sources"][0]["url"] == "u/a" and not rows[1]["is_refusal"]
    assert rows[2]["is_refusal"] and rows[2]["sources"] == []

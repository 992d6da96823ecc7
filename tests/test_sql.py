import pytest

from lodestone.functions import text as text_fn, urls
from lodestone.operators.chunking import chunk_docs
from lodestone.sql import register
from pyspark.sql import functions as F


@pytest.fixture(scope="module")
def sql(spark):
    register(spark)
    register(spark)  # again: replaces
    return spark.sql


def test_chunks_by_a_lateral_join(spark, sql):
    docs = spark.createDataFrame([(1, "words and more words " * 20), (2, ""), (3, None), (4, "x" * 90)], "id int, content string")
    docs.createOrReplaceTempView("docs")
    got = sql("SELECT id, chunk_index, chunk, src_start, src_end FROM docs, LATERAL chunk_text(content, 40, 10)").collect()
    want = chunk_docs(docs, 40, 10).select("id", "chunk_index", "content", "src_start", "src_end").collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, want)) and len(got) > 10
    with pytest.raises(Exception, match="overlap < size"):
        sql("SELECT * FROM chunk_text('abc', 5, 5)").collect()


def test_columns_as_sql_functions(spark, sql):
    rows = spark.createDataFrame([(u, t) for u, t in zip(
        ["https://www.A.com:80/x", "//h.org", "mailto:x", None, " \thttp://u@B.de", "HTTP://www.www.c.d?q"],
        ["", "short", "y" * 201, None, "z" * 200, "w" * 500])], "url string, text string")
    rows.createOrReplaceTempView("rows")
    got = sql("SELECT url_domain(url) AS a, snippet(text) AS b FROM rows").collect()
    assert got == rows.select(urls.domain(F.col("url")).alias("a"), text_fn.snippet(F.col("text")).alias("b")).collect()


def test_vectors(sql):
    row = sql("""SELECT inner_product(array(1f, 2f), array(3f, 4f)) AS a, cosine(array(3f, 4f), array(6f, 8f)) AS b,
        cosine(array(0f, 0f), array(1f, 0f)) AS c, cosine(embed_tokens('one two'), embed_tokens('Two, one!')) AS d""").first()
    assert (row["a"], row["b"], row["c"]) == (11.0, 1.0, 0.0) and abs(row["d"] - 1) < 1e-12

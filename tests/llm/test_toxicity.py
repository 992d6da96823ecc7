import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from lodestone.llm.queries import QUERIES
from lodestone.llm.toxicity import DIMENSIONS, fit, toxicity, train, word_features


def test_ngrams_stay_inside_words():
    owner, feature = word_features(["ab", "stupid", "", "ab"])
    assert (feature >= 0).all() and (feature < DIMENSIONS).all()
    per_word = [sorted(feature[owner == i].tolist()) for i in range(4)]
    assert per_word[0] == per_word[3] and len(per_word[0]) == 2 + 1  # of 4 signs: two 3-grams, one 4-gram
    assert per_word[2] == [] and len(per_word[1]) == 6 + 5 + 4
    assert word_features([])[0].size == 0


def _table(spark):
    rows = [(i, f"a calm and friendly note about gardens {i}" + (" you stupid moron" if i % 3 == 0 else "")) for i in range(120)]
    return (spark.createDataFrame(rows, "doc_id long, text string"),
            spark.createDataFrame([(i, int(i % 3 == 0)) for i in range(120)], "doc_id long, toxic int"))


def test_learns_and_ignores_missing_labels(spark):
    docs, labels = _table(spark)
    model = train(docs, labels.unionByName(spark.createDataFrame([(None, 1), (5, None)], labels.schema)))
    more = spark.createDataFrame([(0, "you moron"), (1, "a friendly note"), (2, None), (3, ""), (4, "note " * 30000)],
                                 "doc_id long, text string")
    got = {r[0]: r[1] for r in more.select("doc_id", toxicity(F.col("text"), model)).collect()}
    assert got[0] > 0.5 > got[1]
    assert got[2] == got[3] and all(0 <= x <= 1 for x in got.values())


def test_one_class_or_none(spark):
    docs, labels = _table(spark)
    text = docs.limit(3)
    for keep, want in (("toxic = 1", 1), ("toxic = 0", 0), ("false", 0)):
        scores = text.select(toxicity(F.col("text"), train(docs, labels.filter(keep)))).collect()
        assert {round(r[0]) for r in scores} == {want}
    assert docs.limit(0).select(toxicity(F.col("text"), fit(pd.DataFrame({"label": [], "ids": [], "values": []})))).count() == 0


def test_query_on_held_out_rows(spark, sf_dir):
    sf_dir = sf_dir.replace("sf0.001", "sf0.01")
    got = QUERIES["op4_toxicity"](spark, sf_dir)
    assert got.columns == ["doc_id", "held_out", "score", "predicted"]
    rows = got.join(spark.read.parquet(f"{sf_dir}/labels.parquet"), "doc_id").filter("held_out").toPandas()
    rank, positive = rows["score"].rank(), rows["toxic"].to_numpy() == 1
    auc = (rank[positive].sum() - positive.sum() * (positive.sum() + 1) / 2) / (positive.sum() * (~positive).sum())
    assert auc > 0.9 and np.array_equal(rows["predicted"], (rows["score"] >= 0.5).astype(int))

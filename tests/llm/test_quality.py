import math
from collections import Counter, defaultdict

import pytest

from lodestone.llm.quality import discounts, quality, train, with_perplexity
from lodestone.llm.queries import QUERIES

ORDER = 3
TEXTS = ["the cat sat on the mat", "the dog sat", "a cat ate the rat the cat", "über die Brücke", "mat at rat hat", "dodo did do"]


def kneser_ney(texts, order):
    """Probability of a character after a context of fewer than ``order`` characters, by the formulas."""
    words = Counter(w for t in texts for w in t.split())
    raw = {k: Counter() for k in range(1, order + 1)}
    for w, n in words.items():
        seq = f"\x02{w}\x03"
        for k in raw:
            for i in range(len(seq) - k + 1):
                raw[k][seq[i:i + k]] += n
    count = {order: dict(raw[order])}
    for k in range(order - 1, 0, -1):
        left = defaultdict(set)
        for gram in raw[k + 1]:
            left[gram[1:]].add(gram[0])
        count[k] = {g: len(x) for g, x in left.items()}
        if k > 1:
            count[k] |= {g: n for g, n in raw[k].items() if g[0] == "\x02"}
    cut = {k: discounts(Counter(min(a, 5) for a in count[k].values())) for k in count}
    letters = len(count[1])

    def p(context, char):
        if not context:
            total = sum(count[1].values())
            rest = sum(cut[1][min(a, 3) - 1] for a in count[1].values()) / total
            a = count[1].get(char, 0)
            return (max(a - cut[1][min(a, 3) - 1], 0) / total if a else 0) + rest / (letters + 1)
        k = len(context) + 1
        after = {g: a for g, a in count[k].items() if g[:-1] == context}
        if not after:
            return p(context[1:], char)
        total = sum(after.values())
        rest = sum(cut[k][min(a, 3) - 1] for a in after.values()) / total
        a = after.get(context + char, 0)
        return (a - cut[k][min(a, 3) - 1] if a else 0) / total + rest * p(context[1:], char)

    return p, set(count[1])


def brute_perplexity(text, p, order):
    logs = [math.log(p(seq[max(0, i - order + 1):i], seq[i]))
            for seq in (f"\x02{w}\x03" for w in text.split()) for i in range(1, len(seq))]
    return math.exp(-sum(logs) / len(logs)) if logs else None


@pytest.mark.parametrize("rows", [3_000_000, 15])
def test_perplexity_against_the_formulas(spark, rows):
    model = train(spark.createDataFrame([(t,) for t in [*TEXTS, None, ""]], "text string"), order=ORDER)
    p, letters = kneser_ney(TEXTS, ORDER)
    for context in ("", "\x02", "\x02c", "at", "zz", "q"):
        assert sum(p(context, c) for c in letters) + p("", "?") == pytest.approx(1, abs=0.1)
    texts = [*TEXTS, "the zebra sät", "mat", "x", "", None, "  \n", "the\tcat" * 50]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    got = {r["doc_id"]: r["perplexity"] for r in with_perplexity(docs, model, order=ORDER, shard_rows=rows).collect()}
    for i, text in enumerate(texts):
        want = brute_perplexity(text or "", p, ORDER)
        assert got[i] == (None if want is None else pytest.approx(want, rel=1e-5))


def test_decisions_and_odd_tables(spark):
    good = [(i, f"the cat number {i} sat on the mat and the dog ate", "en", "clash") for i in range(80)]
    docs = spark.createDataFrame([*good, (100, "QXZ## ZZQ%% XQZ@@ QQQ", "en", "c"), (101, None, "en", None), (102, "", None, "c"),
                                  (103, "the cat sat", None, "c"), (103, "the cat sat", None, "c"), (None, "the dog sat", "fr", "c")],
                                 "doc_id long, text string, lang string, perplexity string")
    labels = spark.createDataFrame([(i, 1) for i in range(60)] + [(100, 0), (None, 1), (3, None), (61, 1), (61, 0)], "doc_id long, quality int")
    out = quality(docs, labels)
    assert out.columns == ["doc_id", "text", "lang", "perplexity", "threshold", "kept"]
    rows = out.collect()
    assert len(rows) == 86
    assert {r["doc_id"] for r in rows if not r["kept"]} == {100, 101, 102}
    assert quality(docs.limit(0), labels).count() == 0
    unlabelled = quality(docs, labels.limit(0)).collect()
    assert {r["doc_id"] for r in unlabelled if not r["kept"]} == {101, 102}


def test_query_separates_labelled_rows(spark, sf_dir):
    sf_dir = sf_dir.replace("sf0.001", "sf0.01")
    rows = QUERIES["op3_quality"](spark, sf_dir).join(spark.read.parquet(f"{sf_dir}/labels.parquet"), "doc_id").collect()
    good = [r["kept"] for r in rows if r["quality"] == 1]
    bad = [r["kept"] for r in rows if r["quality"] == 0]
    assert sum(good) / len(good) > 0.97 and sum(bad) / len(bad) < 0.5

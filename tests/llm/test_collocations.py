import random
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

from lodestone.llm import collocations as module
from lodestone.llm.collocations import collocations

COLUMNS = ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(rows, least, percent=80, top=2000):
    counts = defaultdict(Counter)
    for lang, text in rows:
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(UPPER)):
            words = [w for w in re.split(r"[ \t]+", piece) if w]
            for k in range(1, 5):
                for i in range(len(words) - k + 1):
                    counts["und" if lang is None else lang][tuple(words[i:i + k])] += 1
    out = []
    for lang, f in counts.items():
        n = sum(a for p, a in f.items() if len(p) == 1)
        found = {p: a for p, a in f.items() if len(p) > 1 and a >= least}
        longest = Counter()
        for p, a in found.items():
            for k in range(2, len(p)):
                for i in range(len(p) - k + 1):
                    longest[p[i:i + k]] = max(longest[p[i:i + k]], a)
        best = []
        for p, a in found.items():
            score, _, l, r = min((2_000_000 * a // (f[p[:k]] + f[p[k:]]), k, f[p[:k]], f[p[k:]]) for k in range(1, len(p)))
            if 100 * longest[p] < percent * a:
                best.append((-score, -a, " ".join(p).encode(), l, r))
        for rank, (score, a, phrase, l, r) in enumerate(sorted(best)[:top], start=1):
            out.append((lang, rank, phrase.decode(), -a, l, r, n, -score))
    return sorted(out)


def _rows(seed):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(5)] + ["Straße", "É", "日本", "it's", "-"]
    say = lambda n: "".join(rng.choice(vocabulary) + rng.choice([" ", " ", " ", "  ", "\t", ", ", ".", "\n", "\r\n"])
                            for _ in range(n))
    rows = [(rng.choice(["en", "de", None]), say(rng.randint(0, 60))) for _ in range(90)]
    rows += [("en", "The Quick brown fox jumps")] * 12 + [("en", "hot " * 200)] * 3 + [("xx", "a b a b a b a b")]
    return rows + [("en", None), (None, None), ("de", ""), ("de", " \t\n.")]


@pytest.mark.parametrize("seed,least,budget,bits", [(1, 5, 1_000_000, 27), (2, 4, 40, 10), (3, 3, 1, 27), (4, 12, 200, 12)])
def test_against_brute_force(spark, seed, least, budget, bits):
    rows = _rows(seed)
    docs = spark.createDataFrame([(t, lang, "x", 1) for lang, t in rows], "text string, lang string, h1 string, n int").repartition(5)
    out = collocations(docs, least=least, budget=budget, bits=bits)
    assert out.columns == COLUMNS
    want = brute(rows, least)
    assert sorted(map(tuple, out.collect())) == want and len(want) > 3


def test_ties_at_the_end_of_the_list(spark):
    rows = [("en", f"a{i} b{i}.") for i in range(20)] * 3
    docs = spark.createDataFrame(rows, "lang string, text string")
    got = [(r["rank"], r["phrase"], r["score"]) for r in collocations(docs, least=3, top=7).orderBy("rank").collect()]
    assert got == [(i + 1, p, 1_000_000) for i, p in enumerate(sorted(f"a{i} b{i}" for i in range(20))[:7])]


def test_empty_table_and_nothing_frequent(spark):
    docs = spark.createDataFrame([("en", "one two three")], "lang string, text string")
    for df in (docs, docs.limit(0)):
        out = collocations(df)
        assert out.columns == COLUMNS and out.count() == 0


def test_words_that_share_a_symbol_start_anew(spark, monkeypatch):
    seeds = []
    whole = module._count_words

    def clash(docs, seed):
        seeds.append(seed)
        words = whole(docs, seed)
        return words if seed else words.withColumn("symbol", module.F.lit(7).cast("long"))

    monkeypatch.setattr(module, "_count_words", clash)
    rows = [("en", "a b. a b. b a")] * 4
    out = collocations(spark.createDataFrame(rows, "lang string, text string"), least=4)
    assert seeds == [0, 1] and sorted(map(tuple, out.collect())) == brute(rows, 4)


def test_long_texts_in_chunks(monkeypatch):
    rng = random.Random(5)
    text = "".join(rng.choice(["ab", "c", "defg" * 9, " ", " ", "\t", ". "]) for _ in range(900)) + "x" * 300
    batch = pa.RecordBatch.from_arrays([pa.array(["en"]), pa.array([text.encode()])], ["lang", "text"])

    def suffixes():
        out = []
        for symbol, piece, own, *_ in module._chunks([batch], 0):
            for i in range(own):
                same = [j for j in range(i, min(i + 4, len(symbol))) if piece[j] == piece[i]]
                out.append(tuple(symbol[same].tolist()))
        return out

    want = suffixes()
    assert len(want) > 100
    for size in (16, 100, 1000):
        monkeypatch.setattr(module, "_CHUNK", size)
        assert suffixes() == want


def test_symbols_depend_on_word_and_language_only():
    data = np.frombuffer(b"to be or not to be", np.uint8)
    begin, end, _ = module._words(data)
    salt = np.full(len(begin), 3, np.uint64)
    one = module._symbols(data, begin, end, salt, 0)
    assert one[0] == one[4] and one[1] == one[5] and len(set(one.tolist())) == 4
    assert not set(one.tolist()) & set(module._symbols(data, begin, end, salt + np.uint64(1), 0).tolist())

"""Benchmark decontamination by winnowing, with DataFrame functions only.

Of every window of six consecutive five-word hashes the smallest is kept as a fingerprint, so two texts that share ten
words in a row share a fingerprint. Fingerprints of documents and of benchmark windows are joined; documents that match
are then extended: all their windows are compared with the benchmark's windows by 128-bit hashes, word for word.

Texts are addressed by a key of their content, so copies are examined under one key and no text is shuffled for its
group. The benchmark's side of a join is a written table whose size the engine knows, and is broadcast only if small.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from lodestone.llm.columns import ascii_lower, text_key, text_of, words_of, unused
from lodestone.plans.scratch import Scratch

SPAN = 10    # words in a row that count as shared
GRAM = 5     # words under one hash; SPAN - GRAM + 1 hashes lie in a span
_NO_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_KEY = ["ka", "kb"]


def tokens(text: Column) -> Column:
    """Words of a text: A-Z in lower case; digits, letters and everything beyond ASCII make words."""
    return words_of(ascii_lower(text), _NO_WORD)


def _grams(words: Column, length: int, salt: int | None = None) -> Column:
    """Hashes of all runs of ``length`` words; empty where there are fewer."""
    head = [] if salt is None else [F.lit(salt)]
    return F.when(F.size(words) >= length, F.transform(
        F.sequence(F.lit(0), F.size(words) - length),
        lambda at: F.xxhash64(*head, *[F.get(words, at + i) for i in range(length)]))).otherwise(
        F.array().cast("array<bigint>"))


def _winnowed(hashes: Column, window: int) -> Column:
    """The smallest hash of each window."""
    return F.when(F.size(hashes) >= window, F.transform(
        F.sequence(F.lit(0), F.size(hashes) - window),
        lambda at: F.least(*[F.get(hashes, at + i) for i in range(window)]))).otherwise(
        F.array().cast("array<bigint>"))


def _with_fingerprints(df: DataFrame, short: list[int], span: int, gram: int) -> DataFrame:
    """Adds ``fps``: distinct fingerprints of the spans in ``words``, and whole runs of the lengths ``short``."""
    df = df.withColumn("_grams", _grams(F.col("words"), gram))
    own = [_grams(F.col("words"), n, salt=n) for n in short]
    return df.withColumn("fps", F.array_distinct(F.concat(_winnowed(F.col("_grams"), span - gram + 1), *own))).drop("_grams")


def _windows(words: Column, length: int) -> Column:
    """``at, length, h1, h2`` of every run of ``length`` words."""
    runs = lambda at, salt: F.xxhash64(F.lit(salt), *[F.get(words, at + i) for i in range(length)])
    return F.when(F.size(words) >= length, F.transform(
        F.sequence(F.lit(0), F.size(words) - length),
        lambda at: F.struct(at.alias("at"), F.lit(length).alias("length"), runs(at, 1).alias("h1"), runs(at, 2).alias("h2")))
    ).otherwise(F.array().cast("array<struct<at:int,length:int,h1:bigint,h2:bigint>>"))


def _covered(spans: Column) -> Column:
    """Words under sorted ``at, length`` spans."""
    step = lambda acc, s: F.struct(
        F.greatest(acc["end"], s["at"] + s["length"]).alias("end"),
        (acc["n"] + F.greatest(F.lit(0), s["at"] + s["length"] - F.greatest(acc["end"], s["at"]))).alias("n"))
    return F.aggregate(spans, F.struct(F.lit(0).alias("end"), F.lit(0).alias("n")), step, lambda acc: acc["n"])


def contamination(docs: DataFrame, items: DataFrame, key: str = "doc_id", text: str = "text", item: str = "item_id",
                  item_text: str = "text", span: int = SPAN, gram: int = GRAM) -> DataFrame:
    """``key, ka, kb, n_words, n_hit, spans, item_ids`` for every row of ``docs``.

    A window is ``span`` consecutive words of an item; an item of fewer words, but not none, is one window. ``spans``
    (sorted ``at, length``) are its occurrences in the document, ``n_hit`` the words under them, ``item_ids`` the sorted
    strings of the items with one. ``ka, kb`` stand for the text. A null text, of a document or an item, has no words. An
    item without an id hits words but is not listed; repeated items count once, repeated documents each for itself.
    Other columns, whatever their names, are not read.
    """
    scratch = Scratch(docs.sparkSession, "decontam")
    bench = scratch.write(items.select(F.col(item).cast("string").alias("item"), tokens(text_of(item_text)).alias("words"))
                          .filter(F.size("words") > 0), "items")
    short = sorted(r[0] for r in bench.filter(F.size("words") < span).select(F.size("words")).distinct().collect())  # < span
    lengths = [span, *short]
    own_length = F.least(F.size("words"), F.lit(span))
    prints = scratch.write(
        _with_fingerprints(bench.filter(F.size("words") >= span), [], span, gram).select(F.explode("fps").alias("fp"))
        .unionByName(bench.filter(F.size("words") < span).select(F.explode(F.concat(
            *[F.when(own_length == n, _grams(F.col("words"), n, salt=n)).otherwise(F.array().cast("array<bigint>"))
              for n in short], F.array().cast("array<bigint>"))).alias("fp"))).distinct(), "prints")
    windows = scratch.write(bench.select("item", F.explode(F.concat(
        *[F.when(own_length == n, _windows(F.col("words"), n)).otherwise(
            F.array().cast("array<struct<at:int,length:int,h1:bigint,h2:bigint>>")) for n in lengths])).alias("w"))
        .select("item", "w.length", "w.h1", "w.h2").distinct(), "windows")

    content = text_of(text)
    marked = docs.select(F.col(key), content.alias("_text"), text_key(content).alias("_k")).select(
        key, "_text", F.col("_k.a").alias("ka"), F.col("_k.b").alias("kb"))
    seen = scratch.write(
        _with_fingerprints(marked.withColumn("words", tokens(F.col("_text"))), short, span, gram)
        .select(key, *_KEY, F.size("words").cast("long").alias("n_words"), "fps"), "fingerprints")
    matched = scratch.write(seen.select(*_KEY, F.explode("fps").alias("fp")).join(prints, "fp", "left_semi")
                            .select(*_KEY).distinct(), "matched")

    hits = scratch.write(
        marked.join(matched, _KEY, "left_semi").withColumn("words", tokens(F.col("_text")))
        .select(*_KEY, F.explode(F.concat(*[_windows(F.col("words"), n) for n in lengths])).alias("w"))
        .select(*_KEY, "w.at", "w.length", "w.h1", "w.h2")
        .join(windows.select("length", "h1", "h2").distinct(), ["length", "h1", "h2"], "left_semi"), "hits")
    spans = hits.groupBy(*_KEY).agg(F.sort_array(F.collect_set(F.struct("at", "length"))).alias("spans"))
    found = (hits.select(*_KEY, "length", "h1", "h2").distinct().join(windows, ["length", "h1", "h2"])
             .groupBy(*_KEY).agg(F.sort_array(F.collect_set("item")).alias("item_ids")))
    each = spans.join(found, _KEY).withColumn("n_hit", _covered(F.col("spans")).cast("long"))
    return seen.drop("fps").join(each, _KEY, "left").select(
        key, *_KEY, "n_words", F.coalesce("n_hit", F.lit(0).cast("long")).alias("n_hit"),
        F.coalesce("spans", F.array().cast("array<struct<at:int,length:int>>")).alias("spans"),
        F.coalesce("item_ids", F.array().cast("array<string>")).alias("item_ids"))


def decontaminate(docs: DataFrame, items: DataFrame, key: str = "doc_id", text: str = "text", **settings) -> DataFrame:
    """``docs`` without the rows that share a window with an item. All columns stay, whatever their names.

    Null, empty and wordless texts share nothing and stay; long texts are read whole; repeated rows stay or go together. An
    empty table, of documents or items, removes nothing.
    """
    dirty = Scratch(docs.sparkSession, "decontam").write(
        contamination(docs, items, key, text, **settings).filter("n_hit > 0").select("ka", "kb").distinct(), "dirty")
    k, = unused(docs, "_k")
    keyed = docs.withColumn(k, text_key(text_of(text)))
    return keyed.join(dirty.select(F.struct(F.col("ka").alias("a"), F.col("kb").alias("b")).alias(k)), k, "left_anti").select(*docs.columns)

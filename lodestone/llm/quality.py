"""Quality by the perplexity of an interpolated modified Kneser-Ney character n-gram model.

The model is trained on trusted text. Its grams run inside words, ends marked, so counts come from a table of distinct
words, and a document's score is the sum of its words' scores. Counts, continuation counts, context totals and
probabilities are DataFrames joined on the gram, its context and its suffix, one order after the other.

For scoring the finished table goes out in shards of about ``SHARD_ROWS`` grams, each used in a pass of its own and then
dropped, so neither a task nor the driver ever holds more of it, however much trusted text there is. A document is rejected
if its perplexity lies above a quantile of the trusted documents of its language; a fifth of these is kept out of the
training for that.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from lodestone.llm.columns import small_batches, text_of, unused, words_of
from lodestone.plans.scratch import Scratch

ORDER = 5
QUANTILE = 0.995       # of the trusted documents' perplexities in a language
MARGIN = 1.1           # a document may exceed the quantile by this factor
SLACK = 1.5            # a text of n signs may exceed it by exp(SLACK / sqrt(n)) more: short texts vary
HELD_OUT = 5           # one of so many trusted documents sets the quantile instead of training the model
LEAST_TRUSTED = 30     # languages with fewer trusted documents use the quantile over all languages
SHARD_ROWS = 3_000_000
LABELS_IN_MEMORY = 500_000  # trusted ids, 8 bytes each, that are broadcast; more are joined by a shuffle
_KNOWN = 100_000
_START, _END = "\x02", "\x03"


# --- training ---------------------------------------------------------------

def _adjusted(words: DataFrame, order: int) -> DataFrame:
    """``gram, a`` of all orders: counts at the top and for grams at a word's start, numbers of left neighbours below."""
    seq = F.concat(F.lit(_START), F.translate("word", _START + _END, ""), F.lit(_END))
    words = words.select(seq.alias("seq"), "n")
    of_length = lambda k: F.when(F.length("seq") >= k, F.transform(
        F.sequence(F.lit(1), F.length("seq") - k + 1), lambda s: F.substring(F.col("seq"), s, F.lit(k)))).otherwise(
        F.array().cast("array<string>"))
    raw = words.select(F.explode(F.concat(*[of_length(k) for k in range(2, order + 1)])).alias("gram"), "n").groupBy(
        "gram").agg(F.sum("n").alias("n"))
    keeps = (F.length("gram") == order) | F.startswith("gram", F.lit(_START))
    both = F.array(F.struct(F.when(keeps, F.col("gram")).alias("gram"), F.col("n").alias("a")),
                   F.struct(F.substring("gram", 2, order).alias("gram"), F.lit(1).cast("long").alias("a")))
    return raw.select(F.inline(both)).filter("gram is not null").groupBy("gram").agg(F.sum("a").alias("a"))


def discounts(counts_of_counts: dict[int, int]) -> tuple[float, float, float]:
    """Modified Kneser-Ney discounts for counts of 1, 2 and more; a half of each where they cannot be estimated."""
    t = [counts_of_counts.get(i, 0) for i in range(1, 5)]
    if not all(t):
        return 0.5, 1.0, 1.5
    y = t[0] / (t[0] + 2 * t[1])
    return tuple(min(max(i - (i + 1) * y * t[i] / t[i - 1], 0.05), i) for i in (1, 2, 3))


def train(trusted: DataFrame, text: str = "text", order: int = ORDER, scratch: Scratch | None = None) -> DataFrame:
    """``gram, logp, back``: log probability of a gram's last character and log weight of its back-off as a context.

    Nulls and texts without words add nothing. An empty table gives a model without grams.
    """
    scratch = scratch or Scratch(trusted.sparkSession, "quality")
    words = scratch.write(trusted.select(F.explode(words_of(text_of(text))).alias("word"))
                          .groupBy("word").agg(F.count("*").alias("n")), "words")
    k, gram = F.length("gram"), F.col("gram")
    counts = scratch.write(_adjusted(words, order), "counts")
    stats: dict[int, dict[int, int]] = {i: {} for i in range(1, order + 1)}
    letters = total = 0
    for r in counts.groupBy(k.alias("k"), F.least("a", F.lit(5)).alias("c")).agg(
            F.count("*").alias("n"), F.sum("a").alias("sum")).collect():  # at most five rows per order
        stats[r["k"]][r["c"]] = r["n"]
        if r["k"] == 1:
            letters, total = letters + r["n"], total + r["sum"]
    cuts = {i: discounts(x) for i, x in stats.items()}
    cut = F.coalesce(*[F.when(k == i, F.when(F.col("a") == 1, d[0]).when(F.col("a") == 2, d[1]).otherwise(d[2]))
                       for i, d in cuts.items()])
    counts = counts.withColumns({"cut": cut, "ctx": F.substring(gram, F.lit(1), k - 1), "suffix": F.substring(gram, 2, order)})
    totals = scratch.write(counts.filter(k > 1).groupBy("ctx").agg(F.sum("a").alias("sum"), F.sum("cut").alias("cuts")), "totals")
    # own share of a gram, and what its context leaves to the suffix
    terms = scratch.write(counts.filter(k > 1).join(totals, "ctx").select(
        "gram", "suffix", ((F.col("a") - F.col("cut")) / F.col("sum")).alias("own"), (F.col("cuts") / F.col("sum")).alias("rest")), "terms")
    rest = sum(cuts[1][min(c, 3) - 1] * n for c, n in stats[1].items()) / total if total else 1.0
    probs = scratch.write(counts.filter(k == 1).select(
        "gram", ((F.col("a") - F.col("cut")) / (total or 1) + rest / (letters + 1)).alias("p")), "probs-1")
    tables = [probs]
    for i in range(2, order + 1):
        lower = probs.select(F.col("gram").alias("suffix"), F.col("p").alias("q"))
        probs = scratch.write(terms.filter(k == i).join(lower, "suffix").select(
            "gram", (F.col("own") + F.col("rest") * F.col("q")).alias("p")), f"probs-{i}")
        tables.append(probs)
    model = reduce(DataFrame.unionByName, tables).join(
        totals.select(F.col("ctx").alias("gram"), (F.col("cuts") / F.col("sum")).alias("gamma")), "gram", "full")
    unknown = trusted.sparkSession.createDataFrame([("", rest / (letters + 1), None)], "gram string, p double, gamma double")
    return model.unionByName(unknown).select(
        "gram", F.log("p").alias("logp"), F.coalesce(F.log(F.col("gamma")), F.lit(0.0)).alias("back"))


# --- scoring ----------------------------------------------------------------

def gram_hashes(code: np.ndarray, order: int) -> list[np.ndarray]:
    """For each order the 64-bit hashes of the grams that start at each place."""
    mixed, out = np.full(len(code), 0x51, np.uint64), []
    for i in range(order):
        mixed = (mixed[:max(len(code) - i, 0)] ^ code[i:]) * np.uint64(0x9E3779B97F4A7C15)
        mixed ^= mixed >> np.uint64(29)
        out.append(mixed)
    return out


def _codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64)


class Grams:
    """A shard of the model: hashed grams in order, found through a directory of their leading bits."""

    def __init__(self, keys: np.ndarray, logp: np.ndarray, back: np.ndarray, unknown: float, lasts: list[int], others: bool):
        by = np.argsort(keys)
        self.keys = np.concatenate([keys[by], np.array([2**64 - 1], np.uint64)])
        self.logp, self.back = logp[by].astype(np.float32), back[by].astype(np.float32)
        self.unknown, self.lasts, self.others = unknown, lasts, others  # scores after these characters, or all others
        self.bits = max(1, int(len(keys)).bit_length())
        fill = np.bincount((self.keys[:-1] >> np.uint64(64 - self.bits)).astype(np.int64), minlength=1 << self.bits)
        self.directory = (np.cumsum(fill) - fill).astype(np.int32)
        self.probes = int(fill.max()) if len(keys) else 0

    def find(self, keys: np.ndarray) -> np.ndarray:
        """Row of each key, -1 where there is none."""
        at = self.directory[(keys >> np.uint64(64 - self.bits)).astype(np.int64)]
        out = np.full(len(keys), -1, np.int64)
        todo = np.arange(len(keys))
        for _ in range(self.probes):
            here = self.keys[at]
            hit = here == keys
            out[todo[hit]] = at[hit]
            more = here < keys
            todo, at, keys = todo[more], np.minimum(at[more] + 1, len(self.keys) - 1), keys[more]
            if not len(todo):
                break
        return out

    def score(self, words: list[str], order: int) -> np.ndarray:
        """Log probability of each word, of the characters whose left neighbour belongs to this shard."""
        clean = [w.replace(_START, "").replace(_END, "") for w in words] if any(_START in w or _END in w for w in words) else words
        code = _codes("".join([f"{_START}{w}{_END}" for w in clean]))
        start = code == ord(_START)
        owner = np.cumsum(start) - 1
        inside = np.arange(len(code)) - np.flatnonzero(start)[owner]  # place within the word
        rows, logp = None, None
        for k, hashes in enumerate(gram_hashes(code, order), start=1):
            found = np.full(len(code), -1, np.int64)
            ends = np.flatnonzero(inside >= k - 1)
            found[ends] = self.find(hashes[ends - k + 1])
            if k == 1:
                logp = np.where(found >= 0, self.logp[found], self.unknown) if len(self.logp) else np.full(len(code), self.unknown)
            else:
                context = np.append(-1, rows[:-1])
                backed = logp + np.where(context >= 0, self.back[context], 0) if len(self.back) else logp
                logp = np.where(inside < k - 1, logp, np.where(found >= 0, self.logp[found], backed) if len(self.logp) else backed)
            rows = found
        counts = (inside > 0) & np.append(False, np.isin(code, np.array(self.lasts, np.uint64), invert=self.others)[:-1])
        return np.bincount(owner[counts], logp[counts], len(words))


def shards(model: DataFrame, rows: int = SHARD_ROWS) -> Iterator[tuple]:
    """The arguments of ``Grams`` for each shard of the model, one after the other, split by context characters so that
    none exceeds ``rows`` grams by more than those around its commonest character. Tasks build the tables; the driver only
    passes the columns on."""

    def hashed(batches):
        for batch in batches:
            keys = [gram_hashes(_codes(g), len(g))[-1][0] for g in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(np.array(keys, np.uint64).view(np.int64)), batch.column(1), batch.column(2)],
                                             ["key", "logp", "back"])

    last, before = F.substring("gram", -1, 1), F.when(F.length("gram") > 1, F.substring("gram", -2, 1)).otherwise("")
    unknown = model.filter("gram = ''").select("logp").first()[0]
    grams = model.filter("gram <> ''").withColumns({"last": last, "before": before})
    parts: list[list[str]] = [[]]
    if grams.count() > rows:
        sizes: dict[str, int] = {}
        for column in ("last", "before"):
            for r in grams.groupBy(column).count().collect():  # one row per character
                sizes[r[0]] = sizes.get(r[0], 0) + r["count"]
        room = rows
        for char in sorted(c for c in sizes if c):
            if parts[-1] and sizes[char] > room:
                parts.append([])
                room = rows
            parts[-1].append(char)
            room -= sizes[char]
    for i, part in enumerate(parts):
        own = grams if len(parts) == 1 else grams.filter(F.col("last").isin(part) | F.col("before").isin(part) | (F.col("before") == ""))
        found = own.select("gram", F.coalesce("logp", F.lit(-99.0)).cast("float").alias("logp"), F.col("back").cast("float").alias(
            "back")).mapInArrow(hashed, "key long, logp float, back float").toArrow()
        yield (found["key"].to_numpy().view(np.uint64), found["logp"].to_numpy(), found["back"].to_numpy(), unknown,
               [ord(c) for c in (part if i else sum(parts[1:], []))], i == 0, len(parts))


def _log_probability(text: Column, held, order: int) -> Column:
    """Log probability of the characters of a text that the broadcast shard scores."""

    @F.pandas_udf("double")
    def of(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        grams, known = Grams(*held.value), {}
        for series in texts:
            out = np.zeros(len(series))
            for at in range(0, len(series), 128):
                docs = [t.encode("utf-8", "surrogatepass").split() for t in series.iloc[at:at + 128].fillna("")]
                new = list({w for words in docs for w in words if w not in known})
                if len(known) + len(new) > _KNOWN:
                    known, new = {}, list({w for words in docs for w in words})
                if new:
                    known.update(zip(new, grams.score([w.decode("utf-8", "surrogatepass") for w in new], order).tolist(),
                                     strict=True))
                for i, words in enumerate(docs):
                    out[at + i] = math.fsum(map(known.__getitem__, words))
            yield pd.Series(out)

    return of(text)


def with_perplexity(docs: DataFrame, model: DataFrame, text: str = "text", perplexity: str = "perplexity", signs: str = "signs",
                    keep: list[str] | None = None, order: int = ORDER, shard_rows: int = SHARD_ROWS,
                    scratch: Scratch | None = None) -> DataFrame:
    """The columns ``keep`` of ``docs`` (all, if not given) with the perplexity per sign, null without words, and the number
    of signs, characters and word ends: a written table."""
    spark, keep = docs.sparkSession, docs.columns if keep is None else keep
    scratch = scratch or Scratch(spark, "quality")
    total, = unused(docs, "_sum")
    words = words_of(text_of(text))
    out = docs.withColumns({total: F.lit(0.0), signs: F.length(F.array_join(words, "")) + F.size(words)})
    for i, (*shard, parts) in enumerate(shards(model, shard_rows)):
        held = spark.sparkContext.broadcast(tuple(shard))
        out = out.withColumn(total, F.col(total) + _log_probability(F.col(text), held, order))
        if i + 1 == parts:
            out = out.select(*keep, signs, F.when(F.col(signs) > 0, F.exp(-F.col(total) / F.col(signs))).alias(perplexity))
        with small_batches(spark):
            out = scratch.write(out, f"scored-{i}")
        held.destroy()
    return out


def quality(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang",
            label: str = "quality", quantile: float = QUANTILE, order: int = ORDER, columns: list[str] | None = None) -> DataFrame:
    """``columns`` of ``docs`` (all, if not given) with ``perplexity, threshold, kept``; columns of these names are replaced.

    Trusted are the rows whose id is labelled 1 and nowhere 0. ``threshold`` is the ``quantile`` of the perplexities of held
    out trusted rows (one of ``HELD_OUT`` by a hash of the id) in the row's language (null is a language) times ``MARGIN``,
    and some slack for short texts; languages with fewer than ``LEAST_TRUSTED`` held out rows use those of all languages,
    and where there are fewer in all, all trusted rows. Without any trusted row all documents with words are kept. Null texts
    and texts without words have null perplexity and are rejected; long texts are read whole. Repeated rows and ties are
    judged alike; an empty table stays empty. Other columns stay, whatever their names.
    """
    scratch = Scratch(docs.sparkSession, "quality")
    signs, ident, own_lang, own, number = unused(docs, "_signs", "_id", "_lang", "_own", "_n")
    good = (labels.select(F.col(key).alias(ident), F.col(label).alias(number)).dropna().groupBy(ident).agg(F.min(number).alias(number))
            .filter(F.col(number) == 1).select(ident))
    good = scratch.write_small(good, "good", LABELS_IN_MEMORY)
    held_out = F.pmod(F.xxhash64(ident), F.lit(HELD_OUT)) == 0
    trusted = lambda rows, ids: rows.join(ids, F.col(key) == F.col(ident), "left_semi")
    model = scratch.write(train(trusted(docs, good.filter(~held_out)).select(text), text, order, scratch), "model")
    kept = [c for c in dict.fromkeys([*(columns or docs.columns), key, lang]) if c not in ("perplexity", "threshold", "kept")]
    scored = with_perplexity(docs, model, text, "perplexity", signs, kept, order, scratch=scratch)
    level = F.percentile_approx("perplexity", quantile, 10_000)
    sure = trusted(scored, good.filter(held_out)).filter("perplexity is not null")
    every, count = sure.agg(level, F.count("*")).first()
    if count < LEAST_TRUSTED:
        sure = trusted(scored, good).filter("perplexity is not null")
        every = sure.agg(level).first()[0]
    by_lang = scratch.write_small(sure.groupBy(F.col(lang).alias(own_lang)).agg(level.alias(own), F.count("*").alias(number)).filter(
        F.col(number) >= LEAST_TRUSTED).drop(number), "levels")
    limit = F.coalesce(own, F.lit(every).cast("double")) * MARGIN * F.exp(SLACK / F.sqrt(F.greatest(signs, F.lit(1))))
    out = scored.join(by_lang, F.col(lang).eqNullSafe(F.col(own_lang)), "left").withColumn("threshold", limit)
    return out.withColumn("kept", F.col("perplexity").isNotNull() & F.coalesce(F.col("perplexity") <= F.col("threshold"), F.lit(True))
                          ).select(*[c for c in (columns or docs.columns) if c not in ("perplexity", "threshold", "kept")],
                                   "perplexity", "threshold", "kept")

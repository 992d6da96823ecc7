"""Phrases whose words occur together, counted by vertical partitioning of a depth-truncated suffix tree.

Words are the symbols, ``DEPTH`` of them the depth. Phrases of fewer than ``LEAST`` occurrences are never asked for, so a
suffix ends where a word, or a pair of neighbours, is rarer than that. Word and pair counts also partition the tree: a
prefix of one word that many suffixes share is extended to two words, and to three, until no prefix holds more than a
quarter of a group's budget; prefixes are then dealt to so many groups that half a budget falls on each. Every suffix goes
to its prefix's group, already counted within its chunk of text. A group is one sorted run of suffixes, the leaves of its
subtrees: the total of the leaves below a node is the number of occurrences of the node's phrase.

A word is one 64-bit symbol, hashed together with its language. The table of all words is checked for symbols that two
words share; if there are any, all starts anew with another hash. What is broadcast has a bound: bitmaps of
``2 ** BITS`` bits at most (a full bitmap ends fewer suffixes, with the same results), four prefixes a group.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from lodestone.llm.columns import small_batches, text_of
from lodestone.plans.scratch import Scratch

DEPTH = 4
LEAST = 30
INSIDE = 80            # percent: a phrase goes if a longer one makes up this much of its occurrences
TOP = 2000
BUDGET = 1_000_000     # suffixes that a group may hold in memory
MAX_GROUPS = 100_000
BITS = 27
_CHUNK = 1 << 20       # bytes of text hashed at a time
_NO_LANG = "und"
_CLASS = np.zeros(256, np.uint8)
_CLASS[[0x20, 0x09]] = 1
_CLASS[[*b".,;:!?", 0x0A, 0x0B, 0x0C, 0x0D]] = 2
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 32
_H = [f"h{i}" for i in range(1, DEPTH + 1)]
_powers: dict[int, np.ndarray] = {}


# --- symbols ----------------------------------------------------------------

def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x81DADEF4BC2DD44D)
    return x ^ (x >> np.uint64(33))


def _power(base: int, n: int) -> np.ndarray:
    """base ** 0 ... base ** (n - 1), modulo 2 ** 64."""
    if len(_powers.get(base, ())) < n:
        steps = np.full(max(n, _CHUNK + _CHUNK // 8), base, np.uint64)
        steps[0] = 1
        _powers[base] = np.cumprod(steps, dtype=np.uint64)
    return _powers[base][:n]


def _salt(lang: str) -> int:
    return int.from_bytes(hashlib.md5(lang.encode("utf-8", "surrogatepass")).digest()[:8], "little")


def _words(data: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Begin, end and piece number of every word."""
    kind = _CLASS[data]
    edge = np.diff(np.concatenate([[0], (kind == 0).view(np.int8), [0]]).astype(np.int8))
    begin = np.flatnonzero(edge == 1)
    return begin, np.flatnonzero(edge == -1), np.cumsum(kind == 2, dtype=np.int32)[begin]


def _symbols(data: np.ndarray, begin: np.ndarray, end: np.ndarray, salt: np.ndarray, seed: int) -> np.ndarray:
    base = 0x9E3779B97F4A7C15 + 2 * seed
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * _power(pow(base, -1, 1 << 64), len(data)), out=sums[1:])
    whole = (sums[end] - sums[begin]) * _power(base, len(data))[begin]
    out = _mixed(_mixed(whole + (end - begin).astype(np.uint64)) ^ salt)
    return np.where(out == 0, np.uint64(1), out)  # 0 means no word


def _cuts(data: np.ndarray) -> Iterator[tuple[np.ndarray, int]]:
    """A long text in chunks that end between words, each followed by the words that its last suffixes need; and the
    number of the chunk's own bytes."""
    at = 0
    while at < len(data):
        size, tail = _CHUNK, 64 * DEPTH
        while True:
            between = np.flatnonzero(_CLASS[data[at + 1:at + size]]) + 1  # a chunk ends after its beginning
            if at + size >= len(data) or len(between):
                break
            size *= 2
        end = len(data) if at + size >= len(data) else at + int(between[-1])
        while end + tail < len(data) and len(_words(data[end:end + tail])[0]) <= DEPTH:
            tail *= 2
        yield data[at:end + tail], end - at
        at = end


def _chunks(batches, seed: int) -> Iterator[tuple]:
    """``symbol, piece, own, begin, end, lang, data`` of chunks of rows ``lang, text``: of its words the first ``own`` begin
    suffixes here; ``lang`` is a function of a word's number."""

    def of(parts, langs, own=None):
        data = _LOWER[np.concatenate([x for p in parts for x in (p, np.array([10], np.uint8))])]
        begin, end, piece = _words(data)
        row = np.searchsorted(np.cumsum([len(p) + 1 for p in parts]), begin, side="right")
        salts = np.array([_salt(x) for x in langs], np.uint64)
        count = len(begin) if own is None else int(np.searchsorted(begin, own))
        return _symbols(data, begin, end, salts[row], seed), piece, count, begin, end, lambda i: langs[row[i]], data

    for batch in batches:
        parts, langs, held = [], [], 0
        for lang, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            data = np.frombuffer(text.as_buffer(), np.uint8)
            if held and held + len(data) > _CHUNK:
                yield of(parts, langs)
                parts, langs, held = [], [], 0
            if len(data) > _CHUNK:
                for cut, own in _cuts(data):
                    yield of([cut], [lang], own)
            elif len(data):
                parts.append(data)
                langs.append(lang)
                held += len(data) + 1
        if parts:
            yield of(parts, langs)


# --- counts of words and pairs, and what is made of them --------------------

def _long(x: np.ndarray) -> pa.Array:
    return pa.array(x.astype(np.uint64).view(np.int64) if x.dtype == np.uint64 else x.astype(np.int64))


def _count_words(docs: DataFrame, seed: int) -> DataFrame:
    def of(batches):
        for symbol, _, own, begin, end, lang, data in _chunks(batches, seed):
            found, first, n = np.unique(symbol[:own], return_index=True, return_counts=True)
            words = [data[b:e].tobytes() for b, e in zip(begin[first].tolist(), end[first].tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array([lang(i) for i in first], pa.string()), pa.array(words, pa.binary()),
                                              _long(found), _long(n)], ["lang", "word", "symbol", "n"])

    counted = docs.mapInArrow(of, "lang string, word binary, symbol long, n long")
    return counted.groupBy("lang", "word", "symbol").agg(F.sum("n").alias("n"))


def _pair(first: np.ndarray, second: np.ndarray) -> np.ndarray:
    return _mixed(first * np.uint64(0x9E3779B97F4A7C15) ^ second)


class _Frequent:
    """Keys that may be frequent: all that are, and few others while the bitmap has room."""

    def __init__(self, keys: DataFrame, bits: int):
        """``keys``: a written table of one long column ``key``."""
        self.bits = max(10, min(bits, (64 * max(keys.count(), 1)).bit_length()))
        place = F.shiftrightunsigned("key", 64 - self.bits)
        words = keys.groupBy(F.shiftright(place, 6).alias("at")).agg(
            F.bit_or(F.expr("shiftleft(1L, int(shiftrightunsigned(key, %d) & 63))" % (64 - self.bits))).alias("bits")).toArrow()
        self.words = np.zeros(1 << (self.bits - 6), np.uint64)  # at most 2 ** (BITS - 6) rows come back
        self.words[words["at"].to_numpy()] = words["bits"].to_numpy().view(np.uint64)

    def has(self, keys: np.ndarray) -> np.ndarray:
        place = keys >> np.uint64(64 - self.bits)
        return (self.words[(place >> np.uint64(6)).astype(np.int64)] >> (place & np.uint64(63))) & np.uint64(1) == 1


def _neighbours(symbol, piece, frequent: _Frequent) -> np.ndarray:
    """For each word but the last: do it and the next one lie in one piece, both frequent?"""
    good = frequent.has(symbol)
    return (piece[1:] == piece[:-1]) & good[1:] & good[:-1]


def _count_pairs(docs: DataFrame, seed: int, words) -> DataFrame:
    def of(batches):
        for symbol, piece, own, *_ in _chunks(batches, seed):
            both = np.flatnonzero(_neighbours(symbol, piece, words.value)[:own])
            found, n = np.unique(_pair(symbol[both], symbol[both + 1]), return_counts=True)
            yield pa.RecordBatch.from_arrays([_long(found), _long(n)], ["key", "n"])

    return docs.mapInArrow(of, "key long, n long").groupBy("key").agg(F.sum("n").alias("n"))


def _heavy(counts: DataFrame, key: str, most: int) -> np.ndarray:
    """The keys of more than ``most`` occurrences; their number is bounded by the choice of ``most``."""
    return np.sort(counts.filter(F.col("n") > most).select(key).toArrow()[key].to_numpy().view(np.uint64))


# --- the suffix tree --------------------------------------------------------

def _leaves(docs: DataFrame, seed: int, held) -> DataFrame:
    """``grp, h1 ... , n``: suffixes of two words or more (0 where they end), and how often they occur in a chunk."""

    def of(batches):
        words, pairs, heavy_words, heavy_pairs, groups = held.value
        for symbol, piece, own, *_ in _chunks(batches, seed):
            if len(symbol) < 2:
                continue
            key = _pair(symbol[:-1], symbol[1:])
            link = np.append(_neighbours(symbol, piece, words) & pairs.has(key), False)
            at = np.flatnonzero(link[:own])
            goes_on, cols = np.ones(len(at), bool), [symbol[at]]
            for i in range(1, DEPTH):
                here = np.minimum(at + i, len(symbol) - 1)
                goes_on &= link[here - 1] & (at + i < len(symbol))
                cols.append(np.where(goes_on, symbol[here], np.uint64(0)))
            whole = reduce(_pair, cols)
            _, first, inverse, n = np.unique(whole, return_index=True, return_inverse=True, return_counts=True)
            if all((c[first][inverse] == c).all() for c in cols):
                cols = [c[first] for c in cols]
            else:  # two suffixes share a hash: send them uncounted
                n = np.ones(len(at), np.int64)
            prefix, pair = cols[0], _pair(cols[0], cols[1])
            prefix = np.where(np.isin(prefix, heavy_words), pair, prefix)
            prefix = np.where(np.isin(pair, heavy_pairs), _pair(pair, cols[2]), prefix)
            yield pa.RecordBatch.from_arrays(
                [_long(_mixed(prefix) % np.uint64(groups)), *map(_long, cols), _long(n)], ["grp", *_H, "n"])

    return docs.mapInArrow(of, ", ".join(f"{c} long" for c in ["grp", *_H, "n"]))


def _nodes(leaves: DataFrame, least: int, heavy_pairs: np.ndarray) -> DataFrame:
    """``h1 ..., a``: the nodes of two words and more that at least ``least`` suffixes pass, group by group. Only a pair
    that was extended lies in several groups; its parts are added up."""

    def totals(rows: list[np.ndarray]):
        table = np.concatenate(rows, axis=1)
        new = np.zeros(table.shape[1], bool)
        new[0] = True
        for depth in range(DEPTH):
            new[1:] |= table[depth, 1:] != table[depth, :-1]
            if depth:
                at = np.flatnonzero(new)
                a = np.add.reduceat(table[DEPTH], at)
                keep = a >= least
                if depth == 1:
                    keep |= np.isin(_pair(*(table[i, at].view(np.uint64) for i in (0, 1))), heavy_pairs)
                keep &= table[depth, at] != 0
                node = [table[i, at[keep]] if i <= depth else np.zeros(keep.sum(), np.int64) for i in range(DEPTH)]
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in [*node, a[keep]]], [*_H, "a"])

    def of(batches):
        group, rows = None, []
        for batch in batches:
            cols = [c.to_numpy() for c in batch.columns]
            if not len(cols[0]):
                continue
            cut = [0, *(np.flatnonzero(np.diff(cols[0])) + 1).tolist(), len(cols[0])]
            for begin, end in zip(cut, cut[1:], strict=False):
                if rows and cols[0][begin] != group:
                    yield from totals(rows)
                    rows = []
                group = cols[0][begin]
                rows.append(np.stack([c[begin:end] for c in cols[1:]]))
        if rows:
            yield from totals(rows)

    dealt = leaves.repartition("grp").sortWithinPartitions("grp", *_H)
    found = dealt.mapInArrow(of, ", ".join(f"{c} long" for c in [*_H, "a"]))
    return found.groupBy(*_H).agg(F.sum("a").alias("a")).filter(F.col("a") >= least)


def phrase_counts(docs: DataFrame, scratch: Scratch, least: int = LEAST, budget: int = BUDGET, bits: int = BITS) -> tuple[DataFrame, DataFrame]:
    """For rows ``lang, text`` (binary, not null): ``lang, word, symbol, n`` of all words, and ``h1 ... h4, a`` of all
    phrases of two to ``DEPTH`` words with at least ``least`` occurrences, as symbols (0 after the phrase's end)."""
    spark, seed = docs.sparkSession, 0
    while True:
        with small_batches(spark):
            words = scratch.write(_count_words(docs, seed), f"words-{seed}")
        if words.groupBy("symbol").agg(F.count("*").alias("k")).filter("k > 1").isEmpty():
            break
        seed += 1
    frequent = words.filter(F.col("n") >= least)
    total = frequent.agg(F.sum("n")).first()[0] or 0
    groups = max(1, min(MAX_GROUPS, -(-2 * total // budget)))
    most = max(total // groups // 2, 1)  # a quarter of the budget; at most 2 * groups prefixes exceed it
    common = spark.sparkContext.broadcast(_Frequent(frequent.select(F.col("symbol").alias("key")), bits))
    with small_batches(spark):
        pairs = scratch.write(_count_pairs(docs, seed, common).filter(F.col("n") >= least), "pairs")
    held = spark.sparkContext.broadcast((common.value, _Frequent(pairs.select("key"), bits), _heavy(frequent, "symbol", most),
                                         _heavy(pairs, "key", most), groups))
    common.destroy()
    nodes = scratch.write(_nodes(_leaves(docs, seed, held), least, held.value[3]), "nodes")
    held.destroy()
    return words, nodes


# --- scores -----------------------------------------------------------------

def _part(first: int, last: int) -> list[Column]:
    """Symbols ``first`` to ``last`` (from 1) of a phrase, as ``p1 ...``."""
    own = [F.col(f"h{i}") for i in range(first, last + 1)]
    return [c.alias(f"p{i}") for i, c in enumerate([*own, *[F.lit(0).cast("long")] * (DEPTH - len(own))], start=1)]


def _by_length(make) -> Column:
    """The rows that ``make`` gives for a phrase of so many words."""
    length = sum((F.col(h) != 0).cast("int") for h in _H)
    return F.inline(F.coalesce(*[F.when(length == k, F.array(*make(k))) for k in range(2, DEPTH + 1)]))


def _scored(words: DataFrame, nodes: DataFrame) -> DataFrame:
    """``nodes`` with ``score, l, r`` of the lowest-scoring cut."""
    cuts = lambda n: [F.struct(F.lit(k).alias("k"), F.lit(side).alias("side"), *part)
                      for k in range(1, n) for side, part in (("l", _part(1, k)), ("r", _part(k + 1, n)))]
    none = F.lit(0).cast("long")
    known = words.select(F.col("symbol").alias("p1"), *[none.alias(f"p{i}") for i in range(2, DEPTH + 1)], F.col("n").alias("f")).unionByName(
        nodes.select(*_part(1, DEPTH), F.col("a").alias("f")))
    p = [f"p{i}" for i in range(1, DEPTH + 1)]
    parts = nodes.select(*_H, "a", _by_length(cuts)).join(known, p)
    both = parts.groupBy(*_H, "a", "k").agg(*[F.max(F.when(F.col("side") == s, F.col("f"))).alias(s) for s in ("l", "r")])
    whole = F.col("a").cast("decimal(20,0)") * F.lit(2_000_000).cast("decimal(7,0)")
    score = F.call_function("div", whole, F.col("l").cast("decimal(20,0)") + F.col("r").cast("decimal(20,0)"))
    lowest = both.withColumn("score", score.cast("long")).groupBy(*_H, "a").agg(F.min(F.struct("score", "k", "l", "r")).alias("cut"))
    return lowest.select(*_H, "a", "cut.score", "cut.l", "cut.r")


def _not_inside(scored: DataFrame, nodes: DataFrame, percent: int) -> DataFrame:
    """Without the phrases that mostly occur inside one longer phrase."""
    inner = lambda n: [F.struct(*_part(i, i + k - 1)) for k in range(2, n) for i in range(1, n - k + 2)]
    longer = nodes.filter("h3 <> 0").select("a", _by_length(lambda n: inner(max(n, 3))))
    most = longer.groupBy(*[F.col(f"p{i}").alias(h) for i, h in enumerate(_H, start=1)]).agg(F.max("a").alias("longest"))
    wide = lambda c: F.col(c).cast("decimal(20,0)")
    return scored.join(most, _H, "left").filter(F.col("longest").isNull() | (wide("longest") * 100 < wide("a") * percent)).drop("longest")


def collocations(docs: DataFrame, text: str = "text", lang: str = "lang", least: int = LEAST, percent: int = INSIDE,
                 top: int = TOP, budget: int = BUDGET, bits: int = BITS) -> DataFrame:
    """Each language's ``top`` phrases: ``lang, rank, phrase, a, l, r, n, score``.

    Texts are lower-cased (A-Z), split at ``.,;:!?`` and line ends, then at blanks; phrases lie within a piece, overlapping
    occurrences count, a null text is empty and a null language ``und``. Repeated rows count each. ``a`` counts the phrase,
    ``l`` and ``r`` its two parts at the cut of lowest score (the first of them), ``n`` the language's words. A phrase of
    fewer than ``least`` occurrences is none; one is dropped if a longer phrase that contains it has ``percent`` of its
    occurrences. Ranked by score, ``a``, then phrase in byte order. Only ``text`` and ``lang`` are read; an empty table
    gives no rows. ``budget`` and ``bits`` change the plan, never the result.
    """
    scratch = Scratch(docs.sparkSession, "collocations")
    slim = docs.select(F.coalesce(F.col(lang).cast("string"), F.lit(_NO_LANG)).alias("lang"), text_of(text).cast("binary").alias("text"))
    words, nodes = phrase_counts(slim, scratch, least, budget, bits)
    frequent = words.filter(F.col("n") >= least)
    kept = scratch.write(_not_inside(_scored(frequent, nodes), nodes, percent), "scored")
    langs = kept.join(frequent.select(F.col("symbol").alias("h1"), "lang"), "h1")
    level = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"))
    best = langs.withColumn("rank", F.rank().over(level)).filter(F.col("rank") <= top)
    for h in _H:
        best = best.join(frequent.select(F.col("symbol").alias(h), F.col("word").cast("string").alias(f"w{h}")), h, "left")
    best = best.withColumn("phrase", F.concat_ws(" ", *[f"w{h}" for h in _H]))
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    best = best.withColumn("rank", F.row_number().over(order).cast("long")).filter(F.col("rank") <= top)
    sizes = words.groupBy("lang").agg(F.sum("n").alias("n"))
    return best.join(sizes, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")

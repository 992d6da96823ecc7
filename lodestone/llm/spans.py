"""Removal of long repeated passages by prefix-free parsing and suffix order.

A rolling hash runs over every text. Of all hashed grams inside a window of ``LENGTH`` bytes the smallest (leftmost) is the
window's trigger, so equal windows have equal triggers at the same place, wherever they occur. Windows in a row with one
trigger make a phrase: the bytes under them. Equal phrases are one entry of the dictionary, however often they occur in
the parse, and repeat as a whole. Only entries that share their trigger's gram with a different entry need a closer look:
aligned at the trigger, they are put in suffix order of what follows and in order of what precedes (read backwards); the
common prefixes of neighbours in both orders tell, window by window, which of them occur again.

Grams and phrases travel as hashes, each text's bytes once to the phrases in question and once to the result. Triggers of
more than ``CROWD`` different phrases are settled by counting their windows' digests instead of meeting in one task. Phrases
in more than ``COMMON`` places, at most one in so many, go to their places by broadcast.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from lodestone.llm.columns import text_key, text_of, unused
from lodestone.plans.scratch import Scratch

LENGTH = 400
GRAM = 160          # bytes under the rolling hash
CROWD = 1024        # distinct phrases of one trigger that one task sorts
COMMON = 1024       # places of one phrase that meet in a task
_PIECE = 1 << 19    # bytes hashed at a time; longer texts go in overlapping pieces
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
_PLACE = np.uint64(511)
_powers: dict[int, np.ndarray] = {}


def _power(base: int, n: int) -> np.ndarray:
    """base ** 0 ... base ** (n - 1), modulo 2 ** 64."""
    if base not in _powers or len(_powers[base]) < n:
        steps = np.full(max(n, 2 * _PIECE), base, np.uint64)
        steps[0] = 1
        _powers[base] = np.cumprod(steps, dtype=np.uint64)
    return _powers[base][:n]


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def phrases(data: np.ndarray, ends: np.ndarray, length: int = LENGTH, gram: int = GRAM) -> dict[str, np.ndarray]:
    """The phrases of texts laid end to end: ``text`` (its number), ``start`` (in ``data``), ``n`` (windows), ``at`` (bytes
    from the start to the trigger), ``gram`` and ``phrase`` (hashes)."""
    width, n = length - gram + 1, len(data)
    empty = {k: np.zeros(0, np.int64) for k in ("text", "start", "n", "at")} | {k: np.zeros(0, np.uint64) for k in ("gram", "phrase")}
    if n < length:
        return empty
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * _power(_INVERSE, n), out=sums[1:])
    grams = _mixed((sums[gram:] - sums[:-gram]) * _power(_BASE, n - gram + 1))
    text = np.searchsorted(ends, np.arange(n - length + 1), side="right")
    starts = np.flatnonzero(np.arange(length, n + 1) <= ends[text])
    if not len(starts):
        return empty
    blocks = -(-len(grams) // width)
    packed = np.full(blocks * width, np.iinfo(np.uint64).max, np.uint64)
    packed[:len(grams)] = (grams & ~_PLACE) | (np.arange(len(grams), dtype=np.uint64) % np.uint64(width))
    packed = packed.reshape(blocks, width)
    ahead = np.minimum.accumulate(packed, axis=1).ravel()[starts + width - 1]
    behind = np.minimum.accumulate(packed[:, ::-1], axis=1)[:, ::-1].ravel()[starts]
    left = (behind | _PLACE) <= (ahead | _PLACE)
    trigger = np.where(left, starts // width * width + (behind & _PLACE).astype(np.int64),
                       (starts + width - 1) // width * width + (ahead & _PLACE).astype(np.int64))
    new = np.ones(len(starts), bool)
    new[1:] = (trigger[1:] != trigger[:-1]) | (starts[1:] != starts[:-1] + 1)
    first = np.flatnonzero(new)
    start, last = starts[first], starts[np.append(first[1:], len(starts)) - 1]
    at = trigger[first] - start
    whole = (sums[last + length] - sums[start]) * _power(_BASE, n)[start]
    size = (last - start + 1).astype(np.uint64)
    return {"text": text[start], "start": start, "n": last - start + 1, "at": at, "gram": grams[trigger[first]],
            "phrase": _mixed(_mixed(whole + size * np.uint64(_BASE)) + at.astype(np.uint64))}


def _parsed(docs: DataFrame, length: int, gram: int) -> DataFrame:
    """``ka, kb, start, n, at, gram, phrase`` of every phrase of every row ``ka, kb, data``."""

    def out(ka, kb, shift, found):
        number = found["text"]
        cols = [ka[number], kb[number], (found["start"] - shift[number]).astype(np.int32), found["n"].astype(np.int32),
                found["at"].astype(np.int32), found["gram"].view(np.int64), found["phrase"].view(np.int64)]
        return pa.RecordBatch.from_arrays([pa.array(c) for c in cols], ["ka", "kb", "start", "n", "at", "gram", "phrase"])

    def of(batches):
        for batch in batches:
            ka, kb = (batch.column(i).to_numpy() for i in (0, 1))
            parts, sizes, rows, shift, held = [], [], [], [], 0
            for row in range(batch.num_rows):
                whole = np.frombuffer(batch.column(2)[row].as_buffer(), np.uint8)
                for begin in range(0, max(len(whole) - length + 1, 0), _PIECE):
                    piece = whole[begin:begin + _PIECE + length - 1]
                    if parts and held + len(piece) > _PIECE + length:
                        yield out(ka[rows], kb[rows], np.array(shift), phrases(np.concatenate(parts), np.cumsum(sizes), length, gram))
                        parts, sizes, rows, shift, held = [], [], [], [], 0
                    parts.append(piece)
                    sizes.append(len(piece))
                    rows.append(row)
                    shift.append(held - begin)
                    held += len(piece)
            if parts:
                yield out(ka[rows], kb[rows], np.array(shift), phrases(np.concatenate(parts), np.cumsum(sizes), length, gram))

    return docs.mapInArrow(of, "ka long, kb long, start int, n int, at int, gram long, phrase long")


def _common(a: bytes, b: bytes) -> int:
    """Length of the common prefix."""
    m = min(len(a), len(b))
    if a[:m] == b[:m]:
        return m
    return int((np.frombuffer(a, np.uint8, m) != np.frombuffer(b, np.uint8, m)).argmax())


def _classes(texts: list[bytes], lengths: np.ndarray) -> np.ndarray:
    """A row per text, a column per length: the same number where the prefixes of that length agree."""
    order = sorted(range(len(texts)), key=texts.__getitem__)
    shared = np.array([-1] + [_common(texts[a], texts[b]) for a, b in zip(order, order[1:], strict=False)])
    out = np.empty((len(texts), len(lengths)), np.int64)
    out[order] = np.cumsum(shared[:, None] < lengths[None, :], axis=0)
    return out


def repeated(lefts: list[bytes], rights: list[bytes], low: np.ndarray, high: np.ndarray, length: int = LENGTH) -> np.ndarray:
    """Which windows of distinct phrases occur in another: a row per phrase, a column per number of bytes that the window
    has before the trigger. ``lefts`` end and ``rights`` begin at the trigger; ``low`` to ``high`` are a phrase's columns."""
    width = int(high.max()) + 1
    before = np.arange(width)
    key = _classes([x[::-1] for x in lefts], before) * len(lefts) + _classes(rights, length - before)
    inside = (before >= low[:, None]) & (before <= high[:, None])
    key = np.where(inside, key, -1 - np.arange(len(lefts))[:, None])  # a column that a phrase lacks matches nothing
    order = np.argsort(key, axis=0)
    ranked = np.take_along_axis(key, order, axis=0)
    same = np.zeros_like(inside)
    same[1:] = ranked[1:] == ranked[:-1]
    same[:-1] |= same[1:].copy()
    out = np.empty_like(same)
    np.put_along_axis(out, order, same, axis=0)
    return out


def _runs(flags: np.ndarray) -> list[tuple[int, int]]:
    """First and last places of the runs of true values."""
    edges = np.flatnonzero(np.diff(np.concatenate([[0], flags.astype(np.int8), [0]])))
    return [(int(a), int(b) - 1) for a, b in zip(edges[::2], edges[1::2], strict=True)]


_CONTENT = "gram long, phrase long, copies long, ka long, kb long, start int, n int, at int, left binary, right binary"


def _contents(texts: DataFrame, wanted: DataFrame, length: int) -> DataFrame:
    """The bytes of the wanted phrases, cut at the trigger."""
    lists = wanted.groupBy("ka", "kb").agg(F.collect_list(F.struct("gram", "phrase", "copies", "start", "n", "at")).alias("wanted"))
    names = [c.split()[0] for c in _CONTENT.split(", ")]

    def of(batches):
        for batch in batches:
            rows = []
            for ka, kb, data, wanted in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                for w in wanted:
                    cut, end = w["start"] + w["at"], w["start"] + w["n"] - 1 + length
                    rows.append((w["gram"], w["phrase"], w["copies"], ka, kb, w["start"], w["n"], w["at"],
                                 data[w["start"]:cut], data[cut:end]))
                    if len(rows) == 4096:
                        yield _batch(rows, names)
                        rows = []
            yield _batch(rows, names)

    return texts.join(lists, ["ka", "kb"]).select("ka", "kb", "data", "wanted").mapInArrow(of, _CONTENT)


def _batch(rows, names):
    types = [pa.int64()] * 5 + [pa.int32()] * 3 + [pa.binary()] * 2
    columns = zip(*rows, strict=True) if rows else [[]] * len(names)
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names)


_SPAN = "ka long, kb long, lo int, hi int"


def _sorted_out(contents: DataFrame, length: int) -> DataFrame:
    """``ka, kb, lo, hi``: first and last starts of repeated windows in phrases that occur once, trigger by trigger."""

    def settle(rows):
        low, high = (np.array([x[i] for x in rows]) for i in (0, 1))
        found = repeated([x[6] for x in rows], [x[7] for x in rows], low, high, length)
        for flags, (_, _, copies, ka, kb, trigger, _, _) in zip(found, rows, strict=True):
            if copies == 1:
                yield from ((ka, kb, trigger - b, trigger - a) for a, b in _runs(flags))

    def of(batches):
        gram, group = None, []
        for batch in batches:
            out = []
            for g, _, copies, ka, kb, start, n, at, left, right in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if g != gram:
                    if len(group) > 1:
                        out += settle(group)
                    gram, group = g, []
                group.append((at - n + 1, at, copies, ka, kb, start + at, left, right))
            yield _spans(out)
        if len(group) > 1:
            yield _spans(list(settle(group)))

    return contents.repartition("gram").sortWithinPartitions("gram").mapInArrow(of, _SPAN)


def _spans(rows):
    columns = zip(*rows, strict=True) if rows else [[]] * 4
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, [pa.int64()] * 2 + [pa.int32()] * 2, strict=True)],
                                      ["ka", "kb", "lo", "hi"])


def _counted_out(contents: DataFrame, length: int) -> DataFrame:
    """The same for crowded triggers, by counting digests of all windows."""

    def of(batches):
        for batch in batches:
            for _, _, copies, ka, kb, start, n, _, left, right in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                data = left + right
                digests = [hashlib.blake2b(data[i:i + length], digest_size=16).digest() for i in range(n)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([x] * n, pa.int64()) for x in (ka, kb, copies)] + [pa.array(range(start, start + n), pa.int32()),
                                                                                pa.array(digests, pa.binary())],
                    ["ka", "kb", "copies", "lo", "digest"])

    windows = contents.mapInArrow(of, "ka long, kb long, copies long, lo int, digest binary")
    again = windows.groupBy("digest").agg(F.count("*").alias("times")).filter("times > 1").select("digest")
    return windows.filter("copies = 1").join(again, "digest").select("ka", "kb", "lo", F.col("lo").alias("hi"))


def _whole(places: DataFrame) -> DataFrame:
    """First and last starts of the windows of phrases that repeat as a whole."""
    return places.select("ka", "kb", F.col("start").alias("lo"), (F.col("start") + F.col("n") - 1).alias("hi"))


def _copied(mixed: DataFrame, entries: DataFrame, common: int = COMMON) -> DataFrame:
    """The places of phrases that occur more than once."""
    of = lambda wanted: entries.filter(wanted).select("gram", "phrase")
    very = F.broadcast(of(F.col("copies") > common))
    rest = of(F.col("copies").between(2, common))
    return mixed.join(very, ["gram", "phrase"], "left_semi").unionByName(
        mixed.join(very, ["gram", "phrase"], "left_anti").join(rest, ["gram", "phrase"], "left_semi"))


def repeated_windows(docs: DataFrame, scratch: Scratch, length: int = LENGTH, gram: int = GRAM, crowd: int = CROWD) -> DataFrame:
    """``ka, kb, lo, hi`` for a table ``ka, kb, data``: starts of windows that occur more than once in it."""
    long = docs.filter(F.octet_length("data") >= length)
    parse = scratch.write(_parsed(long.select("ka", "kb", "data"), length, gram), "parse")
    shared = scratch.write(parse.groupBy("gram").agg(F.count("*").alias("times"), F.min("phrase").alias("a"), F.max("phrase").alias("b"))
                           .filter("times > 1").select("gram", (F.col("a") != F.col("b")).alias("mixed")), "grams")
    again = scratch.write(parse.join(shared, "gram"), "again")
    mixed = again.filter("mixed")
    entries = scratch.write(mixed.groupBy("gram", "phrase").agg(
        F.count("*").alias("copies"), F.min(F.struct("ka", "kb", "start", "n", "at")).alias("one")).select(
        "gram", "phrase", "copies", "one.*"), "dictionary")
    texts = long.select("ka", "kb", "data").dropDuplicates(["ka", "kb"])
    contents = scratch.write(_contents(texts, entries, length), "contents")
    crowded = contents.groupBy("gram").agg(F.count("*").alias("k")).filter(F.col("k") > crowd).select("gram")
    crowded = scratch.write(crowded, "crowded")
    found = _whole(again.filter("not mixed")).unionByName(_whole(_copied(mixed, entries))).unionByName(
        _sorted_out(contents.join(crowded, "gram", "left_anti"), length)).unionByName(
        # a written join of its own: the engine can split the rows of a digest that very many phrases share
        scratch.write(_counted_out(contents.join(crowded, "gram", "left_semi"), length), "counted"))
    return scratch.write(found.distinct(), "windows")


def keep_bytes(data: bytes, windows: list[tuple[int, int]], length: int = LENGTH) -> tuple[bytes, list[tuple[int, int]]]:
    """The bytes outside all windows, and the maximal removed runs as begin and end."""
    runs: list[list[int]] = []
    for lo, hi in sorted(windows):
        if runs and lo <= runs[-1][1]:
            runs[-1][1] = max(runs[-1][1], hi + length)
        else:
            runs.append([lo, hi + length])
    kept, at = [], 0
    for begin, end in runs:
        kept.append(data[at:begin])
        at = end
    return b"".join([*kept, data[at:]]), [(a, b) for a, b in runs]


def remove_repeats(docs: DataFrame, text: str = "text", length: int = LENGTH, gram: int = GRAM, crowd: int = CROWD) -> DataFrame:
    """``docs`` with ``kept`` (binary: the bytes that stay) and ``removed`` (list of ``begin, end`` in bytes).

    Every byte covered by a string of ``length`` bytes that also starts elsewhere, in the same or another row, goes; strings
    are judged on the texts as given, and lie within one text. A null text counts as empty; texts shorter than ``length``
    stay. Repeated rows are each other's repeats. Other columns stay; ``kept`` and ``removed`` are replaced.
    """
    scratch = Scratch(docs.sparkSession, "spans")
    content = text_of(text)
    k, data, spans, result = unused(docs, "_k", "_data", "_windows", "_cut")
    keyed = docs.withColumns({k: text_key(content), data: content.cast("binary")})
    slim = keyed.select(F.col(f"{k}.a").alias("ka"), F.col(f"{k}.b").alias("kb"), F.col(data).alias("data"))
    windows = repeated_windows(slim, scratch, length, gram, crowd)
    lists = windows.groupBy(F.struct(F.col("ka").alias("a"), F.col("kb").alias("b")).alias(k)).agg(
        F.collect_list(F.struct("lo", "hi")).alias(spans))

    @F.pandas_udf("struct<kept:binary,removed:array<struct<begin:int,end:int>>>")
    def cut(data: pd.Series, windows: pd.Series) -> pd.DataFrame:
        kept = [(d, []) if w is None or len(w) == 0 else keep_bytes(d, [(x["lo"], x["hi"]) for x in w], length)
                for d, w in zip(data, windows, strict=True)]
        return pd.DataFrame({"kept": [k for k, _ in kept], "removed": [[{"begin": a, "end": b} for a, b in r] for _, r in kept]})

    out = keyed.join(lists, k, "left").withColumn(result, cut(data, spans))
    return out.select(*[c for c in docs.columns if c not in ("kept", "removed")], f"{result}.kept", f"{result}.removed")

"""Toxicity by a linear classifier over character n-grams, scaled by naive Bayes log-count ratios.

Features are hashed n-grams of 3 to 5 characters inside a document's distinct words, word ends marked; a feature's value
is how often it occurs in them. Training fits one logistic weight per feature on values times their
log-count ratio. As the model is linear, a text's score is the sum of its words' scores, so words are scored once.

The classifier is fitted on a bounded sample: at most ``TRAIN_ROWS`` labelled rows of each class, those with the smallest
hash of their id. Every document is scored, over its whole text, in one pass without a shuffle.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from lodestone.plans.scratch import Scratch

ORDERS = (3, 4, 5)
_BITS = 18
DIMENSIONS = 1 << _BITS
TRAIN_ROWS = 2000      # the documented bound: labelled rows of each class that the fit may use
SMOOTHING = 1.0        # added to every count of the ratio
LEAST_COUNT = 4        # features seen less often get no weight
LEAST_RATIO = 0.4      # features nearer to zero carry no evidence and get no weight
PENALTY = 1e-3
STEP = 4.0
ROUNDS = 150
_KNOWN = 200_000       # word scores that a task remembers at most; more are computed again
_EDGES = " .,;:!?\"'()[]{}<>«»“”„…-–—*_#|/\\"


def word_features(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """For a list of words: the word number and the hashed feature of each of its n-grams."""
    text = "".join([f"\x02{w.strip(_EDGES)}\x03\n" for w in words])
    code = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")
    ends = np.zeros(len(code) + 1, np.int32)
    np.cumsum(code == 10, out=ends[1:])
    code, mixed, owner, feature = code.astype(np.uint64), np.zeros(len(code), np.uint64), [], []
    for i in range(max(ORDERS)):
        windows = max(len(code) - i, 0)
        mixed = (mixed[:windows] ^ code[i:]) * np.uint64(0x9E3779B97F4A7C15)
        mixed ^= mixed >> np.uint64(29)
        if i + 1 in ORDERS:
            inside = np.flatnonzero(ends[i + 1:] == ends[:windows])
            owner.append(ends[inside])
            feature.append((mixed[inside] >> np.uint64(64 - _BITS)).astype(np.int32))
    return np.concatenate(owner), np.concatenate(feature)


def _words(text: str | None) -> list[str]:
    return list(set((text or "").lower().replace("\x02", " ").replace("\x03", " ").split()))


def _values(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    return np.unique(word_features(_words(text))[1], return_counts=True)


def _counts(sample: DataFrame) -> np.ndarray:
    """Summed feature values of each class: one row per class, ``DIMENSIONS`` wide."""

    def of(batches):
        total = np.zeros((2, DIMENSIONS))
        for batch in batches:
            for text, label in zip(batch["text"], batch["label"], strict=True):
                ids, values = _values(text)
                total[int(label), ids] += values
        used = np.flatnonzero(total.sum(axis=0))
        yield pd.DataFrame({"id": used, "n0": total[0, used], "n1": total[1, used]})

    rows = (sample.mapInPandas(of, "id long, n0 double, n1 double").groupBy("id")
            .agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1")).toPandas())  # at most DIMENSIONS rows
    out = np.zeros((2, DIMENSIONS))
    out[:, rows["id"]] = rows[["n0", "n1"]].to_numpy().T
    return out


def log_ratios(counts: np.ndarray) -> np.ndarray:
    """Naive Bayes log-count ratios; 0 for features that are rare or say little."""
    smooth = counts + SMOOTHING
    ratio = np.log(smooth[1] / smooth[1].sum()) - np.log(smooth[0] / smooth[0].sum())
    ratio[(np.abs(ratio) < LEAST_RATIO) | (counts.sum(axis=0) < LEAST_COUNT)] = 0
    return ratio.astype(np.float32)


def _scaled(sample: DataFrame, ratio: np.ndarray) -> pd.DataFrame:
    """``label, ids, values`` of the sampled documents: only features with a ratio, values times it."""

    @F.pandas_udf("struct<ids:array<int>,values:array<float>>")
    def of(texts: pd.Series) -> pd.DataFrame:
        found = [(ids[ratio[ids] != 0], values[ratio[ids] != 0]) for ids, values in map(_values, texts)]
        return pd.DataFrame({"ids": [ids.astype(np.int32) for ids, _ in found],
                             "values": [(values * ratio[ids]).astype(np.float32) for ids, values in found]})

    return sample.select("label", of("text").alias("f")).select("label", "f.*").toPandas()


def fit(examples: pd.DataFrame) -> tuple[np.ndarray, float]:
    """Logistic weights and bias from ``label, ids, values``; both classes weigh the same."""
    label = examples["label"].to_numpy(np.float64)
    if len(label) == 0 or label.min() == label.max():
        return np.zeros(DIMENSIONS, np.float32), 20.0 if label.sum() else -20.0
    rows = np.repeat(np.arange(len(label), dtype=np.int32), [len(x) for x in examples["ids"]])
    ids = np.concatenate(list(examples["ids"])).astype(np.int32)
    values = np.concatenate(list(examples["values"])).astype(np.float32)
    scale = np.float32(np.sqrt(np.bincount(rows, values ** 2, len(label)).mean()) or 1.0)
    values /= scale
    weight = np.where(label == 1, 0.5 / label.sum(), 0.5 / (1 - label).sum())
    w, b, vw, vb = np.zeros(DIMENSIONS, np.float32), 0.0, np.zeros(DIMENSIONS, np.float32), 0.0
    for turn in range(ROUNDS):  # accelerated gradient descent on the weighted logistic loss
        keep = np.float32(turn / (turn + 3))
        lw, lb = w + keep * vw, b + keep * vb
        z = np.bincount(rows, values * lw[ids], len(label)) + lb
        slope = weight * (1 / (1 + np.exp(-np.clip(z, -30, 30))) - label)
        grad = np.bincount(ids, values * slope[rows].astype(np.float32), DIMENSIONS) + PENALTY * lw
        nw, nb = (lw - STEP * grad).astype(np.float32), lb - STEP * slope.sum()
        vw, vb, w, b = nw - w, nb - b, nw, nb
    return w / scale, float(b)


def train(docs: DataFrame, labels: DataFrame, label: str = "toxic", key: str = "doc_id", text: str = "text",
          rows: int = TRAIN_ROWS) -> tuple[np.ndarray, float]:
    """The model from labelled rows: weights (times the ratios) and bias.

    Null ids and labels are left out; contradicting labels of an id count as 1. A document that occurs twice is used
    twice. With examples of one class only, every text gets that class; with none, every text gets label 0.
    """
    clean = labels.select(key, label).dropna().groupBy(key).agg(F.max(label).alias(label))
    chosen = clean.filter(F.col(label) == 0).orderBy(F.xxhash64(key), key).limit(rows).unionByName(
        clean.filter(F.col(label) == 1).orderBy(F.xxhash64(key), key).limit(rows))
    sample = Scratch(docs.sparkSession, "toxicity").write(
        docs.select(key, F.col(text).alias("text")).join(F.broadcast(chosen), key)  # at most twice ``rows`` rows
        .select("text", F.col(label).alias("label")), "sample")
    ratio = log_ratios(_counts(sample))
    weights, bias = fit(_scaled(sample, ratio))
    return weights * ratio, bias


def toxicity(text: Column, model: tuple[np.ndarray, float]) -> Column:
    """Probability of label 1 for each text; null counts as empty, which gets the model's bias."""
    weights, bias = model

    @F.pandas_udf("double")
    def score(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        known: dict[str, float] = {}
        for series in texts:
            out = np.empty(len(series))
            for at in range(0, len(series), 128):
                docs = [_words(t) for t in series.iloc[at:at + 128]]
                new = list({w for words in docs for w in words if w not in known})
                if len(known) + len(new) > _KNOWN:
                    known, new = {}, list({w for words in docs for w in words})
                owner, feature = word_features(new)
                known.update(zip(new, np.bincount(owner, weights[feature], len(new)).tolist(), strict=True))
                for i, words in enumerate(docs):
                    out[at + i] = bias + math.fsum(map(known.__getitem__, words))  # exact, so in any order
            yield pd.Series(1 / (1 + np.exp(-np.clip(out, -50, 50))))

    return score(text)

"""The corpus pipeline: quality, near-duplicates, benchmark passages, personal data, mixture.

Every stage takes ``(spark, docs, sf_dir)`` and returns a DataFrame, which is written and read again as the next stage's
``docs``. All but the last return the columns of ``documents``, and further columns as they are, whatever their names.

A null text counts as an empty one. Long texts are read whole, repeated rows are separate rows, an empty table stays empty;
a null key, language or source is a value like any other.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from lodestone.llm.columns import table, text_of, unused, words_of
from lodestone.llm.decontam import decontaminate
from lodestone.llm.mixing import mix
from lodestone.llm.pii import with_surrogates
from lodestone.llm.quality import quality
from lodestone.llm.simhash import keep_one
from lodestone.plans.scratch import Scratch


def _beside(docs: DataFrame, operator: Callable[[DataFrame], DataFrame], *names: str) -> DataFrame:
    """The columns of ``docs`` after an operator that adds ``names``: columns of these names are kept out of its way."""
    aside = dict(zip(names, unused(docs, *[f"_{n}" for n in names]), strict=True))
    out = operator(docs.withColumnsRenamed({n: a for n, a in aside.items() if n in docs.columns}))
    return out.select(*[F.col(aside[c]).alias(c) if c in aside else F.col(c) for c in docs.columns])


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose perplexity is acceptable in their language; trusted text is what ``labels`` calls good.

    Texts without words go; repeated rows and ties are judged alike.
    """
    return _beside(docs, lambda d: quality(d, table(spark, sf_dir, "labels")).filter("kept"), "perplexity", "threshold", "kept")


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of SimHash near-duplicates: the one with the smallest id, a null one if there is no other;
    of rows that tie for it one stays. Texts without words are near-duplicates of one another."""
    return keep_one(docs)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage of ``benchmark``; texts without words have none, equal texts stay or go together."""
    return decontaminate(docs, table(spark, sf_dir, "benchmark"))


def pii_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with surrogates for personal data; ``n_chars`` follows the new text, null for a null one."""
    return _beside(docs, lambda d: with_surrogates(d).withColumn("n_chars", F.length("text").cast("long")), "pii")


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the mixture takes, each with its ``size`` in words and the number of its ``copies``. Documents
    without words are not taken; rows equal in id and text are taken alike."""
    mixed, _ = mix(docs, F.array("source"), F.size(words_of(text_of("text"))), ["doc_id", "text"])
    return mixed.filter("copies > 0").select(*docs.columns, "size", "copies")


STAGES = [
    ("quality", quality_stage),
    ("near_duplicates", near_duplicate_stage),
    ("decontamination", decontamination_stage),
    ("pii", pii_stage),
    ("mixing", mixing_stage),
]

ORACLE_SQL = None  # language models, fingerprints and keyed surrogates are beyond SQL; tests compare with brute force


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The result of all stages over ``documents``. Between stages the table is written to the shared folder."""
    scratch = Scratch(spark, "pipeline")
    docs = table(spark, sf_dir, "documents")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = scratch.write(docs, name)
    return docs

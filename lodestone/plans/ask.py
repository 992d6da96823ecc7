"""Questions -> hits -> grounded answers, for a whole table of questions at once."""

import pandas as pd
from pyspark.sql import DataFrame, functions as F, types as T

from lodestone import settings
from lodestone.functions.answers import answer_extractive, build_prompt, cap_answer, flag_unsafe, is_refusal
from lodestone.functions.text import strip_ws
from lodestone.operators.context import context_and_sources
from lodestone.operators.embed import embed
from lodestone.operators.topk import bounded_top_k
from lodestone.plans.scratch import Scratch
from lodestone.sources.index import StoredIndex

_KEYS = ["doc_key", "chunk_index"]


def retrieve(questions: DataFrame, index: DataFrame | StoredIndex, k: int = settings.TOP_K,
             threshold: float | None = settings.SIMILARITY_THRESHOLD, embed_fn=None,
             dim: int = settings.EMBED_DIM) -> DataFrame:
    """``questions`` (q_id, question, optional top_k) -> ``q_id, rank, doc_key, chunk_index, url, title,
    content, score``.

    Scoring reads keys and vectors only; its hits are stored, and the text is joined to them afterwards. Of a stored
    index only the files and row groups that can hold a hit are read for that; of a plain table, all of it. The text of
    the corpus is neither sent to Python nor shuffled while the stored hits are small enough to be broadcast.
    """
    stored = isinstance(index, StoredIndex)
    wanted = [c for c in ("q_id", "question", "top_k") if c in questions.columns]
    asked = embed(questions.select(*wanted), "question", embed_fn, dim)
    metric = "cosine" if embed_fn is None else "inner"
    hits, _ = bounded_top_k(asked, index.chunks if stored else index, k, threshold, _KEYS, metric=metric)
    hits = Scratch(questions.sparkSession, "hits").write_small(hits, "hits")
    texts = (index.lookup(hits) if stored else index).select(*_KEYS, "url", "title", "content")
    return texts.join(hits, _KEYS).select(
        "q_id", "rank", *_KEYS, "url", "title", "content", "score")


def _guarded(generate_fn):
    """Answers and what went wrong. A failing batch is halved until only the rows that fail by themselves are left without
    an answer, so that one bad row among n costs some ``2 log n`` calls and not one for each."""

    def run(prompts: pd.Series) -> pd.DataFrame:
        answers, errors = _halved(generate_fn, list(prompts))
        return pd.DataFrame({"answer": pd.Series(answers, dtype=object), "error": pd.Series(errors, dtype=object)})

    return run


def _halved(generate_fn, prompts: list) -> tuple[list, list]:
    if not prompts:
        return [], []
    try:
        made = list(generate_fn(pd.Series(prompts, dtype=object)))
        if len(made) != len(prompts):
            raise ValueError(f"{len(made)} answers to {len(prompts)} prompts")
        return made, [None] * len(made)
    except Exception as problem:
        if len(prompts) == 1:
            return [None], [f"{type(problem).__name__}: {problem}"]
        half = len(prompts) // 2
        first, second = _halved(generate_fn, prompts[:half]), _halved(generate_fn, prompts[half:])
        return first[0] + second[0], first[1] + second[1]


def _generate(rows: DataFrame, generate_fn) -> DataFrame:
    """Run a generator over the rows that have a context; an empty or failed generation is *insufficient*."""
    has_context = strip_ws(F.col("context")) != ""
    model = F.pandas_udf(_guarded(generate_fn), "answer string, error string").asNondeterministic()
    made = rows.where(has_context).withColumn("_made", model(build_prompt(F.col("question"), F.col("context"))))
    made = made.withColumn("answer", cap_answer(F.coalesce(
        F.nullif(strip_ws(F.col("_made.answer")), F.lit("")), F.lit(settings.ANSWER_INSUFFICIENT))))
    made = made.withColumn("generation_error", F.col("_made.error")).drop("_made")
    return made.unionByName(rows.where(~has_context).withColumns({
        "answer": F.lit(settings.ANSWER_NOT_FOUND), "generation_error": F.lit(None).cast("string")}))


def answer_hits(questions: DataFrame, hits: DataFrame, generate_fn=None,
                max_context: int = settings.CONTEXT_CHARS) -> DataFrame:
    """Exactly one row per question: ``q_id, question, answer, sources, is_refusal, unsafe_phrase``, and with a generator
    ``generation_error``: why it gave no answer (``generation_errors`` has these in the shape of all error tables).

    ``generate_fn`` maps a pandas Series of prompts to one of answers (null for a failed one). Unsafe rows and
    rows without context are split off first, so they never reach it. A null question is an error and refused.
    """
    rows = questions.select("q_id", "question").join(
        context_and_sources(hits, max_context), "q_id", "left")
    none = F.array().cast(rows.schema["sources"].dataType)
    rows = (rows.withColumn("context", F.coalesce("context", F.lit("")))
            .withColumn("sources", F.coalesce("sources", none)))
    rows = flag_unsafe(rows)
    unsafe = F.col("unsafe_phrase").isNotNull()
    rejected = unsafe | F.col("question").isNull()
    fixed = F.when(unsafe, F.lit(settings.ANSWER_UNSAFE)).otherwise(F.lit(settings.ANSWER_ERROR))
    if generate_fn is None:
        rows = rows.withColumn("answer", F.when(rejected, fixed).otherwise(
            answer_extractive(F.col("question"), F.col("context"))))
    else:
        rows = _generate(rows.where(~rejected), generate_fn).unionByName(
            rows.where(rejected).withColumns({"answer": fixed, "generation_error": F.lit(None).cast("string")}))
    failed = ["generation_error"] if generate_fn else []
    return rows.select(
        "q_id", "question", "answer", F.when(rejected, none).otherwise(F.col("sources")).alias("sources"),
        (rejected | is_refusal(F.col("answer"))).alias("is_refusal"), "unsafe_phrase", *failed)


def generation_errors(answers: DataFrame) -> DataFrame:
    """The questions that a generator failed on: ``stage, key, message``."""
    return answers.where(F.col("generation_error").isNotNull()).select(
        F.lit("generate").alias("stage"), F.col("q_id").cast("string").alias("key"), F.col("generation_error").alias("message"))


def ask_batch(questions: DataFrame, index: DataFrame | StoredIndex, k: int = settings.TOP_K,
              threshold: float | None = settings.SIMILARITY_THRESHOLD, generate_fn=None, embed_fn=None,
              dim: int = settings.EMBED_DIM) -> DataFrame:
    """Grounded answers for every question, from the index alone."""
    return answer_hits(questions, retrieve(questions, index, k, threshold, embed_fn, dim), generate_fn)

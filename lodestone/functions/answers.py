"""Answer columns: safety screening, prompt, extractive answer, refusal test."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from lodestone import settings
from lodestone.functions.text import contains_any, first_phrase, strip_ws

# Fixed value: the instruction a generator receives, indented as it is sent.
PROMPT = """
        You are a helpful assistant that answers strictly based on the provided context.
        If the context does not have enough information to answer the question, respond with:
        "I don't have enough information in the crawled content to answer this question."

        Context:
        {context}

        Question: {question}

        Answer:
        """


def flag_unsafe(df: DataFrame, question: str = "question", context: str = "context",
                phrases=settings.UNSAFE_PHRASES) -> DataFrame:
    """Add ``unsafe_phrase``: the first listed phrase found in question or context, else null."""
    text = F.lower(F.concat(F.coalesce(question, F.lit("")), F.lit(" "), F.coalesce(context, F.lit(""))))
    return df.withColumn("unsafe_phrase", first_phrase(text, phrases))


def is_refusal(answer: Column, phrases=settings.REFUSAL_PHRASES) -> Column:
    return contains_any(answer, phrases)


def build_prompt(question: Column, context: Column) -> Column:
    before, rest = PROMPT.split("{context}")
    between, after = rest.split("{question}")
    return F.concat(F.lit(before), context, F.lit(between), question, F.lit(after))


def cap_answer(answer: Column, n: int = settings.ANSWER_CHARS) -> Column:
    return F.when(F.length(answer) > n, F.concat(F.substring(answer, 1, n - 3), F.lit("..."))).otherwise(answer)


def answer_extractive(question: Column, context: Column) -> Column:
    """The first sentences of the context's ``Content:`` lines; three, or four for how/why/when/where.

    Only the line that starts a part counts: text after a line break inside a chunk is not read.
    """
    lines = F.filter(F.split(context, "\n"), lambda line: F.startswith(line, F.lit("Content:")))
    per_line = F.transform(lines, lambda line: F.split(F.substring(line, F.lit(9), F.length(line)), r"\."))
    sentences = F.filter(F.transform(F.flatten(per_line), strip_ws), lambda s: s != "")
    asked = F.lower(question)
    count = F.when(contains_any(asked, settings.DEFINITION_WORDS), 3).when(
        contains_any(asked, settings.EXPLANATION_WORDS), 4).otherwise(3)
    joined = F.nullif(F.array_join(F.slice(sentences, F.lit(1), count), ". "), F.lit(""))
    answer = _let(F.concat(joined, F.lit(".")), lambda text: F.coalesce(
        F.concat(F.lit(settings.ANSWER_PREFIX), cap_answer(text)), F.lit(settings.ANSWER_INSUFFICIENT)))
    return F.when(strip_ws(context) == "", F.lit(settings.ANSWER_NOT_FOUND)).otherwise(answer)


def _let(value: Column, body) -> Column:
    """``body(value)`` with the value computed once, however often the body uses it."""
    return F.get(F.transform(F.array(value), body), 0)
